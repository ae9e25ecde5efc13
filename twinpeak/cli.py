"""Command line: thin argument parsing over the jobs."""

from __future__ import annotations

import argparse
import json
import os

from .params import ExtractionSettings, PairThresholds, PeakPickSettings
from .session import build_session


def _extraction(args) -> ExtractionSettings:
    names = ExtractionSettings.__dataclass_fields__
    given = {n: getattr(args, n) for n in names if getattr(args, n, None) is not None}
    return ExtractionSettings(**given)


def _thresholds(args) -> PairThresholds:
    names = PairThresholds.__dataclass_fields__
    return PairThresholds(**{n: getattr(args, n) for n in names if getattr(args, n, None) is not None})


def _fields(parser, cls, skip=()):
    for name, field in cls.__dataclass_fields__.items():
        if name in skip:
            continue
        text = str(field.type)
        kind = float if "float" in text else int if "int" in text else str
        parser.add_argument("--" + name.replace("_", "-"), dest=name, type=kind)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="twinpeak")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name, *required, **optional):
        p = commands.add_parser(name)
        for r in required:
            p.add_argument("--" + r, required=True, dest=r.replace("-", "_"))
        for o, default in optional.items():
            flag = "--" + o.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, dest=o, action="store_true")
            else:
                p.add_argument(flag, dest=o, default=default, type=type(default) if default is not None else str)
        return p

    p = add("analyze", "peaklist", "output", mz_column="MZ", peak_a_column="Peak1", peak_b_column="Peak2", method_profile=None)
    p.add_argument("--raw", required=True, nargs="+")
    _fields(p, ExtractionSettings)
    _fields(p, PairThresholds)
    p = add("ms1-pick", "peaklist", "raw", "output", mz_column="MZ", config_json=None, review_output=None)
    add("report", "input", "output", max_spectra=0)
    add("export-review", "input", "output", sidecar=None, dataset_id="", method_profile=None)
    add("compare", "baseline", "candidate", "output", status_changes_only=False)
    p = add("sweep", "peaklist", "output", mz_column="MZ", peak_a_column="Peak1", peak_b_column="Peak2")
    p.add_argument("--raw", required=True, nargs="+")
    add("tune", "peaklist", "raw", "output", adaptive=False, mz_column="MZ", rt_tolerance_min=0.1)
    add("batch-prepare", "combined-peaklist", "raw-dir", "split-peaklist-dir", "result-dir", "manifest",
        group_column="Orginal Pooled Well", mz_column="MZ")
    add("batch-run", "manifest", "summary", no_resume=False)
    add("train-shadow", "input", "output", "final-batch", "source-sidecar", seed=20260129, specificity_target=0.95, bootstrap_iterations=1000)
    add("apply-shadow", "input", "output", "source-sidecar", model=None)
    add("shadow-review", "input", "output", model=None)
    add("package-shadow-review", "folder", "archive")
    return parser


def main(argv=None, spark=None) -> dict:
    from . import sinks
    from .operators import compare, shadow
    from .plans import contracts, jobs, training, tuning
    from .sources import rawscans, tables

    args = build_parser().parse_args(argv)
    if args.command == "package-shadow-review":
        return sinks.package_directory(args.folder, args.archive)
    spark = spark or build_session()
    name = args.command
    if name == "analyze":
        method = tables.read_json(args.method_profile) if args.method_profile else None
        return jobs.analyze_files(
            spark, args.peaklist, args.raw, args.output, _extraction(args), _thresholds(args),
            (args.mz_column, args.peak_a_column, args.peak_b_column), method,
        )
    if name == "ms1-pick":
        settings = PeakPickSettings()
        if args.config_json:
            with open(args.config_json, encoding="utf-8") as handle:
                settings = PeakPickSettings.from_json(handle.read())
        out = jobs.annotate_files(
            spark, args.peaklist, args.raw, args.output, settings, args.mz_column, args.review_output
        )
        return {"rows": out.count(), "output": args.output}
    if name == "report":
        rows = compare.annotate_results(tables.read_table(spark, args.input))
        return jobs.build_report(rows, args.output, max_spectra=args.max_spectra)
    if name == "export-review":
        side = tables.read_json(args.sidecar) if args.sidecar else {}
        method = tables.read_json(args.method_profile) if args.method_profile else side.get("method", {})
        windows = side.get("windows", {})
        t = {k: v for k, v in side.get("parameters", {}).items() if k in PairThresholds.__dataclass_fields__}
        rows = compare.annotate_results(tables.read_table(spark, args.input), PairThresholds(**t))
        context = {
            "dataset_id": args.dataset_id, "window_lower": windows.get("lower"), "window_upper": windows.get("upper"),
            "config_hash": training.canonical_sha256({"parameters": side.get("parameters", {}), "method": method})[:10],
            "method_profile_id": method.get("profile_id", ""),
        }
        manifest = jobs.review_manifest(rows, context)
        sinks.write_table(sinks.as_text_table(manifest), os.path.join(args.output, "target_manifest"))
        sinks.write_table(jobs.view_index(manifest), os.path.join(args.output, "view_index"))
        return {"output": args.output}
    if name == "compare":
        base, cand = (tables.read_table(spark, p) for p in (args.baseline, args.candidate))
        queue, summary = compare.compare_runs(base, cand, args.status_changes_only)
        sinks.write_table(sinks.as_text_table(queue), args.output)
        payload = summary.first().asDict()
        sinks.write_json(payload, args.output.rstrip("/") + ".summary.json")
        return payload
    if name == "sweep":
        run = jobs.ms2_run(jobs.durable(rawscans.read_raw(spark, args.raw)))
        table = tables.read_table(spark, args.peaklist)
        columns = (args.mz_column, args.peak_a_column, args.peak_b_column)
        targets = tables.to_targets(table, jobs.stem(args.raw[0]), *columns)
        rows = [r.asDict() for r in jobs.sensitivity_sweep(targets, run, jobs.sweep_settings()).collect()]
        sinks.write_json({"variants": rows}, args.output)
        return {"variants": len({(r["varied_parameter"], r["varied_value"]) for r in rows})}
    if name == "tune":
        table = tables.read_table(spark, args.peaklist)
        from pyspark.sql import functions as F

        from .functions.scalars import number

        targets = table.select(
            F.col("Compound_ID").alias("compound_id"), F.lit(jobs.stem(args.raw)).alias("raw_id"),
            number(F.col(args.mz_column)).alias("mz"), number(F.col("Peak1")).alias("peak1"), number(F.col("Peak2")).alias("peak2"),
        )
        run = jobs.ms1_run(jobs.durable(rawscans.read_raw(spark, [args.raw])))
        payload = tuning.tune(targets, run, args.adaptive, args.rt_tolerance_min)
        sinks.write_json(payload, args.output)
        return payload
    if name == "batch-prepare":
        rows, manifest = jobs.prepare_manifest(spark, args.combined_peaklist, args.raw_dir, args.group_column)
        sinks.write_table(rows.drop("row_no"), args.split_peaklist_dir, ["sample_id"])
        out = [
            {
                "sample_id": r.sample_id, "mode": r.mode,
                "peaklist": os.path.join(args.split_peaklist_dir, f"sample_id={r.sample_id}"), "raw": r.raw,
                "output": os.path.join(args.result_dir, r.sample_id), "mz_column": args.mz_column,
            }
            for r in manifest.collect()
        ]
        sinks.write_json({"jobs": out}, args.manifest)
        return {"prepared_jobs": len(out)}
    if name == "batch-run":
        jobs_ = (
            tables.read_json(args.manifest)["jobs"] if args.manifest.endswith(".json") else tables.read_manifest(spark, args.manifest)
        )
        results = jobs.run_batch(spark, jobs_, not args.no_resume)
        sinks.write_json({"results": results}, args.summary)
        return {"results": results}
    side = tables.read_json(args.source_sidecar) if getattr(args, "source_sidecar", None) else None
    if side is not None:
        contracts.validate_frozen_source(side)
    rows = tables.read_table(spark, args.input)
    if name == "train-shadow":
        model = training.train(
            shadow.training_examples(rows), args.final_batch, args.specificity_target, args.seed,
            args.bootstrap_iterations, {"source_sidecar_sha256": training.canonical_sha256(side)},
        )
        training.write_artifact(model, args.output)
        return {"model_id": model["trainable_decision"]["model_id"]}
    artifact = tables.read_json(args.model) if args.model else None
    if artifact is not None:
        contracts.validate_artifact(artifact)
    if name == "apply-shadow":
        out = shadow.as_text(shadow.apply_model(rows.drop("row_no"), artifact))
        sinks.write_table(out, args.output)
        sinks.write_json({**side, "shadow_inference": {"model": artifact is not None}}, args.output.rstrip("/") + ".metadata.json")
        return {"output": args.output}
    table = rows.drop("row_no")
    if not shadow.model_id_violations(table).isEmpty():
        raise ValueError("a prediction table must carry exactly one model id")
    if not shadow.prediction_violations(table, artifact).isEmpty():
        raise ValueError("stored predictions differ from the model")
    queue = shadow.disagreements(table)
    sinks.write_table(queue, os.path.join(args.output, "disagreements"))
    counts = {f"{r.v2_status}->{r.ml_status}": r.rows for r in shadow.transition_counts(table).collect()}
    sinks.write_json({"transition_counts": counts}, os.path.join(args.output, "shadow_summary.json"))
    return {"transition_counts": counts}


if __name__ == "__main__":
    print(json.dumps(main(), default=str))
