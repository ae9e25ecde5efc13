"""Runnable jobs over files: pair analysis, MS1 annotation, batches, sweeps, tuning, review."""

from __future__ import annotations

import os
import time
from dataclasses import fields, replace
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import rules
from ..functions.scalars import folder_component, source_label_meaning, target_uid_ms2
from ..operators import compare, dia, ms1
from ..params import ExtractionSettings, PairThresholds, PeakPickSettings
from ..session import durable
from ..sources import rawscans, tables
from . import analyze

# One-factor settings of the sensitivity sweep.
SWEEP = {
    "mz_tol": (2.5, 3.0, 5.0, 10.0),
    "precursor_eic_mz_tol": (3.0, 5.0),
    "fragment_eic_mz_tol": (3.0, 5.0),
    "rt_half_window_sec": (4.0, 8.0, 10.0, 12.0),
    "min_fragment_correlation": (0.7, 0.8, 0.9, 0.95),
    "consensus_scans": (1, 2, 3, 5),
    "fragment_mz_tol": (0.003, 0.005, 0.01),
}


def ms2_run(scans: DataFrame) -> dia.Ms2Run:
    return dia.run_from_scans(rawscans.ms2_scans(scans))


def ms1_run(scans: DataFrame) -> ms1.Ms1Run:
    return ms1.run_from_scans(rawscans.ms1_scans(scans))


def in_row_order(results: DataFrame) -> DataFrame:
    """Rows as the peak table has them, one raw file after the other; part files follow on."""
    return results.repartitionByRange("row_id").sortWithinPartitions("row_id")


def result_table(results: DataFrame) -> DataFrame:
    """Result rows as exchange text: typed helper columns dropped, spectra as text."""
    plain = analyze.with_spectrum_text(results).drop("mz", "peak_a_rt", "peak_b_rt")
    return sinks.as_text_table(tables.expand_source(plain))


def analyze_files(
    spark: SparkSession, peaklist: str, raws: list[str], output: str,
    settings: ExtractionSettings = ExtractionSettings(),
    thresholds: PairThresholds = PairThresholds(),
    columns: tuple[str, str, str] = ("MZ", "Peak1", "Peak2"), method: dict | None = None,
) -> dict:
    """One peak table against one or more raw files; writes the table and its sidecar."""
    started = time.perf_counter()
    scans = durable(rawscans.read_raw(spark, raws))
    run = ms2_run(scans)
    table = tables.read_table(spark, peaklist)
    frames = [tables.to_targets(table, stem(r), *columns) for r in raws]
    targets = frames[0]
    for i, more in enumerate(frames[1:], 1):
        targets = targets.unionByName(more.withColumn("row_id", F.col("row_id") + F.lit(i << 40)))
    results = durable(analyze.analyze_pairs(targets, run, settings, thresholds))
    shown = results.withColumn("raw_file", F.col("raw_id")) if len(raws) > 1 else results
    sinks.write_table(result_table(in_row_order(shown)), output)
    sidecar = sinks.run_sidecar(
        results, run.windows, settings, thresholds, rawscans.acquisition_attributes(spark, raws),
        method, sinks.file_fingerprints(spark, [peaklist, *raws]), time.perf_counter() - started,
    )
    sinks.write_json(sidecar, output.rstrip("/") + ".metadata.json")
    return sidecar


def annotate_files(
    spark: SparkSession, peaklist: str, raw: str, output: str,
    settings: PeakPickSettings = PeakPickSettings(), mz_column: str = "MZ", review_output: str | None = None,
) -> DataFrame:
    """MS1 automatic peak columns for one peak table; optional review subset."""
    table = tables.read_table(spark, peaklist)
    tables.require_columns(table, [mz_column])
    targets = table.select(
        F.col("row_no").alias("row_id"), F.lit(stem(raw)).alias("raw_id"),
        tables.number(F.col(f"`{mz_column}`")).alias("mz"),
        tables.source_struct(table),
    )
    run = ms1_run(rawscans.read_raw(spark, [raw]))
    out = durable(ms1.annotate_targets(targets, run, settings))
    text = sinks.as_text_table(tables.expand_source(in_row_order(out).drop("mz")))
    sinks.write_table(text, output)
    if review_output:
        sinks.write_table(text.where("auto_manual_review_required = 'true'"), review_output)
    return out


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def single_rt_fragments(
    targets: DataFrame, run: dia.Ms2Run, mz_tol: float, dia_iso_win: float
) -> DataFrame:
    """Older one-RT layout: +/-10 s around ``rt_min``, fractional tolerance, '0' when absent.

    Runs the two-sided extraction with both windows placed on disjoint copies of the row.
    """
    s = ExtractionSettings(mz_tol=mz_tol, mz_tol_unit="legacy_fraction", dia_iso_win=dia_iso_win)
    # A distant second RT keeps the half window at its full 10 s.
    pairs = targets.select(
        "row_id", "raw_id", "mz", F.col("rt_min").alias("peak_a_rt"),
        (F.col("rt_min") + 1.0e6).alias("peak_b_rt"),
    )
    sides = analyze.extract_window(pairs, run, s).where("side = 'peak_a'")
    found = F.when(
        F.col("f.win").isNotNull() & ~F.contains(F.col("quality_flags"), F.lit("invalid_apex_scan")),
        analyze.fragment_text(F.col("spectrum")),
    )
    return targets.join(sides.select("row_id", found.alias("MS2")), "row_id", "left").withColumn(
        "MS2", F.coalesce("MS2", F.lit("0"))
    )


def global_window_fragments(
    targets: DataFrame, run: dia.Ms2Run, window_a: tuple[float, float], window_b: tuple[float, float],
    mz_tol: float, mz_tol_unit: str = "legacy_fraction", dia_iso_win: float = 15.0,
) -> DataFrame:
    """Older layout with the same two RT windows (seconds) for every row: side evidence only."""
    s = ExtractionSettings(mz_tol=mz_tol, mz_tol_unit=mz_tol_unit, dia_iso_win=dia_iso_win)
    routed = dia.route_targets(targets.where(F.col("mz").isNotNull()), run.windows, dia_iso_win)
    sides = F.array(
        *[
            F.struct(F.lit(n).alias("side"), F.lit(float(w[0])).alias("start"), F.lit(float(w[1])).alias("end"))
            for n, w in (("peak_a", window_a), ("peak_b", window_b))
        ]
    )
    rows = analyze.open_sides(routed.withColumn("s", F.explode(sides)), s)
    return analyze.side_evidence(analyze.precursor_traces(rows, run, s), run, s)


# ---- batch ---------------------------------------------------------------------------


def prepare_manifest(
    spark: SparkSession, combined: str, raw_dir: str, group_column: str = "Orginal Pooled Well"
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``sample_id``, one manifest row per group with its unique raw file)."""
    table = tables.read_table(spark, combined)
    tables.require_columns(table, [group_column])
    rows = table.withColumn("sample_id", F.upper(F.trim(F.col(f"`{group_column}`")))).where("sample_id <> ''")
    raws = spark.createDataFrame([(stem(p), p) for p in tables.raw_files(raw_dir)], "raw_id string, raw string")
    matched = tables.match_by_token(rows.select("sample_id").distinct(), raws, "sample_id")
    manifest = matched.join(F.broadcast(raws), "raw_id")  # one row per raw file
    return rows, manifest.withColumn("mode", F.lit("full")).orderBy("sample_id")


def run_batch(spark: SparkSession, manifest: list[dict], resume: bool = True) -> list[dict]:
    """Run manifest jobs; rows that share mode and settings become one Spark job.

    Finished outputs are skipped, and a raw file that cannot be decoded fails only its
    own samples. Results come back in manifest order.
    """
    status: dict[int, dict] = {}
    pending: dict[tuple, list[int]] = {}
    for i, job in enumerate(manifest):
        mode = job["mode"].strip().lower()
        if mode not in ("ms1", "ms2", "full"):
            status[i] = _failed(job, f"unsupported batch mode {mode!r}")
        elif resume and os.path.exists(os.path.join(job["output"], "_SUCCESS")):
            status[i] = {"sample_id": job["sample_id"], "status": "skipped_existing", "output": job["output"]}
        elif not os.path.exists(job["raw"]) or not os.path.exists(job["peaklist"]):
            status[i] = _failed(job, "input file is missing")
        else:
            key = (
                mode, job.get("peak_config_json") or "", job.get("mz_column") or "MZ",
                job.get("peak_a_column") or "Peak1", job.get("peak_b_column") or "Peak2",
            )
            pending.setdefault(key, []).append(i)
    for key, members in pending.items():
        status.update(_run_group(spark, [(i, manifest[i]) for i in members], *key))
    return [status[i] for i in range(len(manifest))]


def _failed(job: dict, error: str) -> dict:
    return {"sample_id": job["sample_id"], "status": "failed", "error": error}


def _run_group(spark, jobs, mode, config_path, mz_column, peak_a, peak_b) -> dict:
    out: dict[int, dict] = {}
    raws = sorted({job["raw"] for _, job in jobs})
    scans = durable(rawscans.read_raw(spark, raws, on_error="record"))
    broken = {
        r.raw_id: r.error
        for r in scans.where("error IS NOT NULL").groupBy("raw_id").agg(F.min("error").alias("error")).collect()
    }
    scans = scans.where("error IS NULL").drop("error")
    settings = PeakPickSettings()
    if config_path:
        with open(config_path, encoding="utf-8") as handle:
            settings = PeakPickSettings.from_json(handle.read())
    targets = None
    for i, job in jobs:
        if stem(job["raw"]) in broken:
            out[i] = _failed(job, broken[stem(job["raw"])])
            continue
        try:
            table = tables.read_table(spark, job["peaklist"])
            mz = tables.number(F.col(f"`{tables.resolve_column(table, mz_column)}`"))
        except Exception as exc:  # noqa: BLE001 - one sample must not stop the others
            out[i] = _failed(job, f"{type(exc).__name__}: {exc}")
            continue
        typed = {"mz": mz}
        if mode == "ms2":
            typed["peak_a_rt"] = tables.number(F.col(f"`{tables.resolve_column(table, peak_a)}`"))
            typed["peak_b_rt"] = tables.number(F.col(f"`{tables.resolve_column(table, peak_b)}`"))
        rows = table.select(
            (F.col("row_no") + F.lit(i << 40)).alias("row_id"), F.lit(stem(job["raw"])).alias("raw_id"),
            F.lit(i).alias("job"), *[c.alias(n) for n, c in typed.items()],
            tables.source_struct(table),
        )
        targets = rows if targets is None else targets.unionByName(rows, allowMissingColumns=True)
    if targets is None:
        return out
    results = targets
    if mode in ("ms1", "full"):
        results = ms1.annotate_targets(results, ms1_run(scans), settings)
    if mode == "full":
        # The second stage starts from the six-digit text the first stage publishes.
        rounded = {
            f"peak_{s}_rt": sinks.text_g6(F.col(f"auto_peak{k}_rt_min")).try_cast("double")
            for s, k in (("a", 1), ("b", 2))
        }
        results = durable(results.withColumns(rounded))
    if mode in ("ms2", "full"):
        results = analyze.analyze_pairs(results, ms2_run(scans))
    results = durable(results)
    name = "enantiomer_pair_status" if mode != "ms1" else "auto_chromatographic_status"
    counts: dict[int, dict] = {}
    for r in results.groupBy("job", name).count().collect():
        counts.setdefault(r["job"], {})[r[name]] = r["count"]
    ordered = in_row_order(results)
    table = sinks.as_text_table(tables.expand_source(ordered.drop("mz"))) if mode == "ms1" else result_table(ordered)
    for i, job in jobs:
        if i in out:
            continue
        sinks.write_table(table.where(F.col("job") == str(i)).drop("job"), job["output"])
        out[i] = {
            "sample_id": job["sample_id"], "status": "completed", "output": job["output"],
            "row_count": sum(counts.get(i, {}).values()), "status_counts": counts.get(i, {}),
        }
    return out


# ---- sweep and tuning ----------------------------------------------------------------


def sweep_settings(base: ExtractionSettings = ExtractionSettings(), grid: dict = SWEEP) -> list[tuple]:
    """(parameter, value, settings) of each distinct one-factor variant."""
    out, seen = [], set()
    for name, values in grid.items():
        for value in values:
            varied = base.varied(**{name: value})
            # An unset specific tolerance is a different variant from the shared one.
            key = (repr(varied))
            if key not in seen:
                seen.add(key)
                out.append((name, value, varied))
    return out


#: Parameters that the sweep knows a stage for.
SWEPT = (*SWEEP, "precursor_eic_mz_tol_unit", "fragment_eic_mz_tol_unit", "mz_tol_unit")


def _trace_key(s: ExtractionSettings) -> tuple:
    """What the sides and precursor traces depend on."""
    return s.rt_unit, s.rt_half_window_sec, s.dia_iso_win, s.precursor_tolerance


def _point_key(s: ExtractionSettings) -> tuple:
    """What the candidate fragments' points depend on besides."""
    return *_trace_key(s), s.consensus_scans, s.fragment_eic_tolerance


def sensitivity_sweep(targets: DataFrame, run: dia.Ms2Run, variants: list[tuple]) -> DataFrame:
    """(parameter, value, status, rows, both_spectra) for every variant.

    Variants form a tree by the stage at which they first differ: those of equal windows and precursor
    tolerance share their traces, and those of equal consensus and fragment tolerance the fragment
    points too; both are stored once. What is left, the correlation and the comparison's tolerance,
    goes with the row key, so that one plan judges and compares the rows of all variants.
    Targets of equal m/z and times have equal evidence: one of them stands for all, with their number.
    """
    base = {f.name: getattr(variants[0][2], f.name) for f in fields(variants[0][2])}
    if any(getattr(s, n) != v for _, _, s in variants for n, v in base.items() if n not in SWEPT):
        raise ValueError(f"variants of one sweep may differ in {', '.join(SWEPT)} only")
    # The run is read by every branch; its tables are aggregated once.
    run = replace(run, **{f.name: durable(getattr(run, f.name)) for f in fields(run) if isinstance(getattr(run, f.name), DataFrame)})
    alike = targets.groupBy("raw_id", "mz", "peak_a_rt", "peak_b_rt")
    targets = durable(alike.agg(F.min("row_id").alias("row_id"), F.count("*").alias("n_targets")))
    traces, points, judged = {}, {}, None
    keys = [
        F.struct(F.lit(n).alias("variant"), F.lit(s.min_fragment_correlation).alias("correlation"), F.lit(s.fragment_mz_tol).alias("tolerance"), F.col("row_id"))
        for n, (_, _, s) in enumerate(variants)
    ]
    for key, (_, _, settings) in zip(keys, variants, strict=True):
        at, point = _trace_key(settings), _point_key(settings)
        if at not in traces:
            traces[at] = durable(analyze.precursor_traces(analyze.routed_sides(targets, run, settings), run, settings))
        if point not in points:
            points[point] = durable(analyze.fragment_points(traces[at], run, settings))
        some = points[point].withColumn("row_id", key)
        judged = some if judged is None else judged.unionByName(some)
    each = SimpleNamespace(**base | {"min_fragment_correlation": F.col("row_id.correlation"), "fragment_mz_tol": F.col("row_id.tolerance")})
    copies = targets.withColumn("row_id", F.explode(F.array(*keys)))
    results = analyze.compared_pairs(copies, analyze.judged_sides(judged, each), each)
    both = (F.size("peak_a_spectrum") > 0) & (F.size("peak_b_spectrum") > 0)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v, _ in variants])
    return (
        results.groupBy(F.col("row_id.variant").alias("variant"), "enantiomer_pair_status")
        .agg(F.sum("n_targets").alias("rows"), F.sum(F.when(both, F.col("n_targets")).otherwise(0)).alias("both_ms2_spectra"))
        .withColumn("named", names[F.col("variant")])
        .select(
            F.col("named.name").alias("varied_parameter"), F.col("named.value").alias("varied_value"),
            "enantiomer_pair_status", "rows", "both_ms2_spectra",
        )
    )


# ---- review products -----------------------------------------------------------------


def review_manifest(annotated: DataFrame, context: dict) -> DataFrame:
    """One manifest row per target with identity, evidence and its review views."""
    annotated, num = compare.with_numbers(durable(annotated), compare.VIEW_NUMBERS)
    text = compare.text_of(annotated)
    views = rules.ms2_views(text, num)
    lower, upper = context.get("window_lower"), context.get("window_upper")
    coverage = compare.coverage_view(
        text("ms2_issue_codes"), num("dia_window_match_count"), num("MZ"),
        F.lit(lower).cast("double"), F.lit(upper).cast("double"),
    )
    uid = target_uid_ms2(
        F.lit(context.get("dataset_id", "")), text("Compound_ID"), text("SGC ID for Pool"),
        text("MZ"), text("Peak1"), text("Peak2"),
    )
    label = text(context.get("label_column", "IG"))
    copied = [
        "ms1_reference_status", "ms2_diagnostic_status", "ms2_review_priority", "ms2_issue_codes",
        "ml_same_compound_probability", "ml_diagnostic_status", "ml_model_id", "ml_abstention_reason",
        "ml_review_flags", "ms2_cosine", "ms2_entropy_similarity", "ms2_matched_peaks",
        "peak_a_explained_intensity", "peak_b_explained_intensity", "peak_a_fragment_count",
        "peak_b_fragment_count", "peak_a_candidate_fragment_count", "peak_b_candidate_fragment_count",
        "peak_a_quality_flags", "peak_b_quality_flags", "dia_window_lower", "dia_window_upper",
        "dia_window_match_count",
    ]
    all_views = F.array_distinct(
        F.array_compact(F.concat(views, F.array(F.nullif(coverage, F.lit("")))))
    )
    manifest = annotated.select(
        uid.alias("target_uid"),
        F.lit(context.get("dataset_id", "")).alias("dataset_id"),
        F.lit(context.get("standard_id", "")).alias("standard_id"),
        F.lit(context.get("config_hash", "")).alias("config_hash"),
        F.col("review_row").alias("source_row"),
        text("Compound_ID").alias("compound_id"),
        num("MZ").alias("target_mz"),
        num("Peak1").alias("supplied_peak1_rt_min"),
        num("Peak2").alias("supplied_peak2_rt_min"),
        label.alias("source_machine_label"),
        source_label_meaning(label).alias("source_machine_interpretation"),
        text("SGC ID for Pool").alias("source_pool_id"),
        text("Pooled Well").alias("source_pooled_well"),
        rules.spectrum_availability(text("peak_a_MS2"), text("peak_b_MS2")).alias("spectrum_availability"),
        *[text(c).alias(c) for c in copied],
        F.lit(context.get("method_profile_id", "")).alias("method_profile_id"),
        F.lit("").alias("acquisition_reconciliation_status"),
        F.lit("").alias("acquisition_issue_codes"),
        F.lit(str(context.get("rt_half_window_sec", ""))).alias("rt_half_window_sec"),
        F.lit(context.get("fragment_correlation_mode", "")).alias("fragment_correlation_mode"),
        F.concat_ws("/", F.lit("svg"), F.concat(folder_component(text("Compound_ID")), F.lit("_"), uid, F.lit(".svg"))).alias("svg_asset_path"),
        all_views.alias("views"),
    )
    # Cut, so that no later step reasons over or copies the view expression.
    return durable(manifest)


def view_index(manifest: DataFrame) -> DataFrame:
    """(view, target_uid, svg path): a table instead of a tree of linked files."""
    rows = manifest.select(F.explode_outer("views").alias("view"), "target_uid", "svg_asset_path")
    return rows.where(F.col("view").isNotNull())


def build_report(annotated: DataFrame, output: str, title: str = "MS2 review", max_spectra: int = 0) -> dict:
    """Queue table, summary counts, status chart and a gallery split by priority."""
    annotated = durable(annotated)
    queue = compare.review_queue(annotated, max_spectra)
    sinks.write_table(sinks.as_text_table(queue), os.path.join(output, "review_queue"))
    summary = [r.asDict() for r in compare.review_summary(annotated).collect()]
    sinks.write_json({"counts": summary}, os.path.join(output, "review_summary.json"))
    from ..functions.spectra import parse_fragments

    drawn = sinks.mirror_svg(
        queue.repartition("review_row"), F.col("Compound_ID"), parse_fragments(F.col("peak_a_MS2")),
        parse_fragments(F.col("peak_b_MS2")),
    )
    card = F.concat(
        F.lit("<article><h2>"), sinks.escape_html(F.col("Compound_ID")), F.lit("</h2><p>"),
        sinks.escape_html(F.col("ms2_issue_codes")), F.lit("</p>"), F.col("svg"), F.lit("</article>"),
    )
    sinks.write_gallery(
        drawn.select("ms2_review_priority", card.alias("card")), os.path.join(output, "gallery"), "ms2_review_priority"
    )
    with open(os.path.join(output, "report.html"), "w", encoding="utf-8") as handle:
        handle.write(report_html(title, summary))
    return {"summary": summary, "output": output}


def report_html(title: str, summary: list[dict]) -> str:
    import html as h

    statuses = {s["name"]: s["rows"] for s in summary if s["section"] == "status"}
    top = max(statuses.values(), default=1)
    bars = "".join(
        f'<g transform="translate(0,{28 * i})"><text x="0" y="16">{h.escape(n)}</text>'
        f'<rect x="220" y="4" width="{360 * statuses[n] / top:.1f}" height="16" fill="#2563eb"/>'
        f'<text x="{226 + 360 * statuses[n] / top:.1f}" y="16">{statuses[n]}</text></g>'
        for i, n in enumerate(s for s in rules.DIAGNOSTIC_STATUSES if s in statuses)
    )
    rows = "".join(
        f"<tr><td>{h.escape(s['section'])}</td><td>{h.escape(s['name'])}</td><td>{s['rows']}</td></tr>"
        for s in sorted(summary, key=lambda s: (s["section"], s["name"]))
    )
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{h.escape(title)}</title></head><body>'
        f"<h1>{h.escape(title)}</h1><svg viewBox='0 0 660 160' width='660'>{bars}</svg>"
        f"<table><tr><th>section</th><th>name</th><th>rows</th></tr>{rows}</table></body></html>"
    )
