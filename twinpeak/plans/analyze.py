"""The flagship job: target pairs -> reconstructed fragment spectra -> layered diagnosis.

Shape of the physical plan, for any number of raw files:

1. targets join packed isolation windows on (raw_id, m/z bin); one row per target.
2. sides join scan headers and centroids on (raw_id, win, rt bin[, m/z bin]); one
   exchange on row_id collects each side's precursor trace.
3. consensus scans join stored spectra on (raw_id, win, scan) and fold to centroids.
4. fragment bands join centroids; a second exchange on row_id collects their traces.
5. both sides of a row are already together: pivot, compare, classify, join inputs.

A fragment trace travels as its non-zero points only, and the precursor trace rides on
one carrier row per side, so nothing is joined back to an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, spectra
from ..functions.scalars import fragment_text, let
from ..operators import chromatograms as xic
from ..operators.dia import (
    Ms2Run,
    band_join,
    clamped_band,
    mz_bin_width,
    route_targets,
    rt_join,
    rt_windows,
    unmatched_key,
)
from ..params import ExtractionSettings, PairThresholds
from ..session import durable, work_partitions

SIDES = ("peak_a", "peak_b")
SIDE_FIELDS = (
    "spectrum",
    "apex_rt",
    "apex_intensity",
    "area",
    "ms2_count",
    "consensus_scan_count",
    "candidate_fragment_count",
    "fragment_count",
    "quality_flags",
)


def routed_sides(targets: DataFrame, run: Ms2Run, s: ExtractionSettings) -> DataFrame:
    """One row per (target, side) that has two distinct RTs and a valid m/z.

    ``blocked`` names why a side cannot be extracted; NULL means it can.
    """
    ready = rt_windows(
        targets.select("row_id", "raw_id", "mz", "peak_a_rt", "peak_b_rt").where(
            F.col("mz").isNotNull()
            & F.col("peak_a_rt").isNotNull()
            & F.col("peak_b_rt").isNotNull()
            & (F.col("peak_a_rt") != F.col("peak_b_rt"))
        ),
        s,
    )
    routed = route_targets(ready, run.windows, s.dia_iso_win)
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.col(f"{side}_rt_window_start").alias("start"),
                F.col(f"{side}_rt_window_end").alias("end"),
            )
            for side in SIDES
        ]
    )
    return open_sides(routed.withColumn("s", F.explode(sides)), s)


def open_sides(routed: DataFrame, s: ExtractionSettings) -> DataFrame:
    """Clamp each routed row's RT window ``s`` and m/z band to its nearest DIA window."""
    hit = F.try_element_at("hits", F.lit(1))
    rows = routed.select("row_id", "raw_id", "mz", "match_count", hit.alias("hit"), "s")
    lo, hi = clamped_band(
        F.col("mz"), *s.precursor_tolerance, F.col("hit.mz_min"), F.col("hit.mz_max")
    )
    rows = (
        rows.withColumn("mz_lo", lo)
        .withColumn("mz_hi", hi)
        .withColumn("rt_lo", F.greatest("hit.rt_first", "s.start"))
        .withColumn("rt_hi", F.least("hit.rt_last", "s.end"))
    )
    blocked = (
        F.when(F.col("hit").isNull(), "no_matching_DIA_window")
        .when(F.coalesce(F.col("mz_lo") >= F.col("mz_hi"), F.lit(True)), "mz_out_of_range")
        .when(F.col("rt_lo") >= F.col("rt_hi"), "rt_window_out_of_range")
    )
    return rows.select(
        "row_id",
        F.col("s.side").alias("side"),
        "raw_id",
        "mz",
        "match_count",
        F.col("hit.win").alias("win"),
        F.col("hit.iso_lo").alias("iso_lo"),
        F.col("hit.iso_hi").alias("iso_hi"),
        F.col("hit.mz_min").alias("mz_min"),
        F.col("hit.mz_max").alias("mz_max"),
        "rt_lo",
        "rt_hi",
        "mz_lo",
        "mz_hi",
        blocked.alias("blocked"),
    )


def precursor_traces(sides: DataFrame, run: Ms2Run, s: ExtractionSettings) -> DataFrame:
    """Each side's attributes plus its precursor trace (empty when blocked)."""
    facts = F.struct(*[c for c in sides.columns if c not in ("row_id", "side")])
    open_sides = sides.where(F.col("blocked").isNull())
    carrier = sides.select(
        "row_id", "side", F.lit(None).cast("int").alias("scan"),
        F.lit(None).cast("double").alias("rt"), F.lit(None).cast("double").alias("it"),
        facts.alias("facts"),
    )
    no_facts = F.lit(None).cast(carrier.schema["facts"].dataType).alias("facts")
    spine = rt_join(
        open_sides.select("row_id", "side", "raw_id", "win", "rt_lo", "rt_hi"), run.headers
    ).select("row_id", "side", "scan", "rt", F.lit(0.0).alias("it"), no_facts)
    width = mz_bin_width(*s.precursor_tolerance)
    hits = (
        band_join(
            open_sides.select("row_id", "side", "raw_id", "win", "rt_lo", "rt_hi", "mz_lo", "mz_hi"),
            run.peaks,
            width,
        )
        .where(F.col("p_scan").isNotNull())
        .select(
            "row_id",
            "side",
            F.col("p_scan").alias("scan"),
            F.col("p_rt").alias("rt"),
            F.col("p_it").alias("it"),
            no_facts,
        )
    )
    points = (
        carrier.unionByName(spine)
        .unionByName(hits)
        .repartition(work_partitions(run.peaks.sparkSession), "row_id")
        .groupBy("row_id", "side", "scan", "rt")
        .agg(F.sum("it").alias("it"), F.first("facts", ignorenulls=True).alias("facts"))
    )
    point = F.when(F.col("scan").isNotNull(), F.struct("rt", "scan", "it"))
    return points.groupBy("row_id", "side").agg(
        F.sort_array(F.collect_list(point)).alias("trace"),
        F.first("facts", ignorenulls=True).alias("f"),
    )


def candidate_centres(traces: DataFrame, run: Ms2Run, s: ExtractionSettings) -> DataFrame:
    """Centroids of the consensus scans' fragments below the precursor, per side."""
    picked = traces.withColumn("chosen", xic.top_scans(F.col("trace"), s.consensus_scans))
    wanted = picked.select(
        "row_id",
        "side",
        "trace",
        "chosen",
        "f",
        F.col("f.raw_id").alias("raw_id"),
        F.col("f.win").alias("win"),
        F.explode_outer("chosen").alias("scan"),
    )
    wanted = wanted.withColumn("scan", F.coalesce("scan", unmatched_key().cast("int")))
    joined = wanted.join(run.spectra, ["raw_id", "win", "scan"], "left")
    below = F.filter(
        F.coalesce(F.col("peaks"), F.array().cast(spectra.SPECTRUM_TYPE)),
        lambda p: (p["mz"] < F.col("f.mz") - 10) & (p["it"] > 0),
    )
    if s.consensus_scans == 1:
        gathered = joined.select("row_id", "side", "trace", "chosen", "f", below.alias("cand"))
    else:
        gathered = (
            joined.withColumn("cand", below)
            .groupBy("row_id", "side")
            .agg(
                F.first("trace").alias("trace"),
                F.first("chosen").alias("chosen"),
                F.first("f").alias("f"),
                F.flatten(F.collect_list("cand")).alias("cand"),
            )
        )
    centres = spectra.merge_centroids(F.col("cand"), *s.fragment_eic_tolerance)
    return gathered.select("row_id", "side", "trace", "chosen", "f", centres.alias("centres"))


def _fragment_stats(s: ExtractionSettings) -> Column:
    """Kept fragments (mz, it) of one side, from its trace and fragment points."""
    trace = F.col("trace")
    x = F.transform(trace, lambda p: p["it"])
    scans = F.transform(trace, lambda p: p["scan"])

    def judged(ctx):
        n = F.size(ctx["x"])

        def full_window(frag):
            sums = F.aggregate(
                frag["pts"],
                F.struct(*[F.lit(0.0).alias(k) for k in ("sy", "syy", "sxy")]),
                lambda acc, p: F.struct(
                    (acc["sy"] + p["it"]).alias("sy"),
                    (acc["syy"] + p["it"] * p["it"]).alias("syy"),
                    (
                        acc["sxy"]
                        + p["it"]
                        * F.get(ctx["dx"], (F.array_position(ctx["scans"], p["scan"]) - 1).cast("int"))
                    ).alias("sxy"),
                ),
            )
            return let(
                sums,
                lambda t: F.coalesce(
                    F.try_divide(
                        t["sxy"],
                        F.sqrt(ctx["vx"])
                        * F.sqrt(F.greatest(t["syy"] - t["sy"] * t["sy"] / n, F.lit(0.0))),
                    ),
                    F.lit(0.0),
                ),
            )

        def active(frag):
            by_scan = F.map_from_entries(
                F.transform(frag["pts"], lambda p: F.struct(p["scan"], p["it"]))
            )
            dense = F.transform(
                ctx["scans"], lambda k: F.coalesce(F.try_element_at(by_scan, k), F.lit(0.0))
            )
            return xic.active_support_correlation(
                ctx["x"],
                dense,
                s.correlation_min_relative_intensity,
                s.min_correlation_scans,
                s.max_fragment_apex_offset_scans,
                s.min_consecutive_fragment_scans,
            )

        def varies(frag):
            its = F.transform(frag["pts"], lambda p: p["it"])
            return F.when(F.size(its) < n, F.array_max(its) > 0).otherwise(~xic.is_constant(its))

        correlate = full_window if s.fragment_correlation_mode == "full_window" else active
        eligible = F.filter(
            F.col("frags"),
            lambda g: varies(g) & (g["top"] >= float(s.min_fragment_intensity)),
        )
        kept = F.filter(
            eligible,
            lambda g: F.coalesce(correlate(g) > spectra.setting(s.min_fragment_correlation), F.lit(False)),
        )
        return F.when(
            ~xic.is_constant(ctx["x"]),
            F.transform(kept, lambda g: F.struct(g["centre"].alias("mz"), g["top"].alias("it"))),
        ).otherwise(F.array().cast(spectra.SPECTRUM_TYPE))

    context = let(
        F.struct(x.alias("x"), scans.alias("scans")),
        lambda t: let(
            xic.mean(t["x"]),
            lambda m: F.struct(
                t["x"].alias("x"),
                t["scans"].alias("scans"),
                F.transform(t["x"], lambda v: v - m).alias("dx"),
                spectra.total(F.transform(t["x"], lambda v: (v - m) * (v - m))).alias("vx"),
            ),
        ),
    )
    correlated = F.when(F.size(trace) > 0, let(context, judged)).otherwise(
        F.array().cast(spectra.SPECTRUM_TYPE)
    )
    relative = float(s.min_fragment_relative_intensity)
    if relative == 0:
        return correlated
    return let(
        correlated,
        lambda c: let(
            F.array_max(F.transform(c, lambda p: p["it"])),
            lambda top: F.filter(c, lambda p: p["it"] >= top * relative),
        ),
    )


def side_evidence(traces: DataFrame, run: Ms2Run, s: ExtractionSettings) -> DataFrame:
    """One row per (row_id, side) with summary, counts, spectrum and quality flags."""
    return judged_sides(fragment_points(traces, run, s), s)


def fragment_points(traces: DataFrame, run: Ms2Run, s: ExtractionSettings) -> DataFrame:
    """Each side's trace and its candidate fragments' points, before any of them is judged.

    Depends on the traces, the consensus scans and the fragment tolerance only.
    """
    tol, unit = s.fragment_eic_tolerance
    centres = candidate_centres(traces, run, s)
    none = F.lit(None).cast("double")
    carrier = F.struct(
        F.lit(-1).alias("idx"), none.alias("centre"), none.alias("mz_lo"), none.alias("mz_hi")
    )

    def band(c, i):
        lo, hi = clamped_band(c, tol, unit, F.col("f.mz_min"), F.col("f.mz_max"))
        return F.struct(i.alias("idx"), c.alias("centre"), lo.alias("mz_lo"), hi.alias("mz_hi"))

    bands = F.concat(
        F.array(carrier),
        F.filter(F.transform("centres", band), lambda b: b["mz_lo"] < b["mz_hi"]),
    )
    exploded = centres.select(
        "row_id", "side", "trace", "chosen", "f", F.size("centres").alias("n_centres"),
        # Outer, because the plain form re-evaluates the array in an inferred filter.
        F.explode_outer(bands).alias("b"),
    )
    first = F.col("b.idx") == -1
    keyed = exploded.select(
        "row_id",
        "side",
        F.when(first, F.struct("trace", "chosen", "f", "n_centres")).alias("side_row"),
        F.col("b.idx").alias("idx"),
        F.col("b.centre").alias("centre"),
        F.when(~first, F.col("f.raw_id")).alias("raw_id"),
        F.when(~first, F.col("f.win")).alias("win"),
        F.when(~first, F.col("f.rt_lo")).alias("rt_lo"),
        F.when(~first, F.col("f.rt_hi")).alias("rt_hi"),
        F.col("b.mz_lo").alias("mz_lo"),
        F.col("b.mz_hi").alias("mz_hi"),
    )
    points = (
        band_join(keyed, run.peaks, mz_bin_width(tol, unit))
        .where((F.col("idx") == -1) | F.col("p_scan").isNotNull())
        .repartition(work_partitions(run.peaks.sparkSession), "row_id")
        .groupBy("row_id", "side", "idx", "centre", "p_scan")
        .agg(F.sum("p_it").alias("it"), F.first("side_row", ignorenulls=True).alias("side_row"))
    )
    frags = points.groupBy("row_id", "side", "idx", "centre").agg(
        F.collect_list(F.struct(F.col("p_scan").alias("scan"), "it")).alias("pts"),
        F.max("it").alias("top"),
        F.first("side_row", ignorenulls=True).alias("side_row"),
    )
    frag = F.when(F.col("idx") >= 0, F.struct("idx", "centre", "top", "pts"))
    return (
        frags.groupBy("row_id", "side")
        .agg(
            F.sort_array(F.collect_list(frag)).alias("frags"),
            F.first("side_row", ignorenulls=True).alias("r"),
        )
        .select("row_id", "side", "frags", "r.trace", "r.chosen", "r.f", "r.n_centres")
    )


def judged_sides(gathered: DataFrame, s: ExtractionSettings) -> DataFrame:
    """Summary, spectrum of the co-eluting fragments and quality flags of each side."""
    scored = gathered.select(
        "row_id",
        "side",
        "f",
        "n_centres",
        F.size("trace").alias("n_scans"),
        F.size("chosen").alias("n_chosen"),
        xic.xic_summary(F.col("trace")).alias("x"),
        _fragment_stats(s).alias("spectrum"),
    )
    return scored.select("row_id", "side", "f", *_side_columns())


def _side_columns() -> list[Column]:
    blocked, n = F.col("f.blocked"), F.col("n_scans")
    open_side = blocked.isNull() & (n > 0)
    signal = open_side & (F.col("x.apex_intensity") > 0)
    found = signal & (F.col("n_centres") > 0)
    kept = F.size("spectrum")
    flags = F.concat_ws(
        ";",
        rules.codes(
            (blocked.isNull() & (n < 1), "no_ms2_scans"),
            (open_side & (F.col("x.flag") != "ok"), "insufficient_points"),
            (open_side & ~signal, "no_precursor_signal"),
            (signal & ~found, "no_candidate_fragments"),
            (found & (kept == 0), "no_fragments"),
        ),
    )
    none = F.array().cast(spectra.SPECTRUM_TYPE)
    return [
        F.when(found, F.col("spectrum")).otherwise(none).alias("spectrum"),
        F.when(open_side, F.col("x.apex_rt")).alias("apex_rt"),
        F.when(open_side, F.col("x.apex_intensity")).alias("apex_intensity"),
        F.when(open_side, F.col("x.area")).alias("area"),
        F.when(blocked.isNull(), n).alias("ms2_count"),
        F.when(signal, F.col("n_chosen")).alias("consensus_scan_count"),
        F.when(found, F.col("n_centres")).alias("candidate_fragment_count"),
        F.when(found, kept).alias("fragment_count"),
        F.coalesce(blocked, F.when(flags == "", "ok").otherwise(flags)).alias("quality_flags"),
    ]


def extract_window(
    targets: DataFrame, run: Ms2Run, s: ExtractionSettings = ExtractionSettings()
) -> DataFrame:
    """Side evidence only, for targets already carrying their own two RT windows."""
    return side_evidence(precursor_traces(routed_sides(targets, run, s), run, s), run, s)


def analyze_pairs(
    targets: DataFrame,
    run: Ms2Run,
    settings: ExtractionSettings = ExtractionSettings(),
    thresholds: PairThresholds = PairThresholds(),
    issue_thresholds: PairThresholds = PairThresholds(),
) -> DataFrame:
    """Full result table: input columns, both sides, scores and layered statuses.

    ``targets``: row_id (unique), raw_id, mz, peak_a_rt, peak_b_rt and any extra columns.
    """
    evidence = extract_window(targets, run, settings)
    return compared_pairs(targets, evidence, settings, thresholds, issue_thresholds)


def compared_pairs(
    targets: DataFrame,
    evidence: DataFrame,
    settings: ExtractionSettings,
    thresholds: PairThresholds = PairThresholds(),
    issue_thresholds: PairThresholds = PairThresholds(),
) -> DataFrame:
    """The result table from both sides' evidence: comparison, diagnosis and statuses."""
    s = settings
    pivot = evidence.groupBy("row_id").agg(
        F.first("f", ignorenulls=True).alias("f"),
        *[
            F.first(
                F.when(F.col("side") == side, F.struct(*SIDE_FIELDS)), ignorenulls=True
            ).alias(side)
            for side in SIDES
        ],
    )
    sim = spectra.similarity(
        F.col("peak_a.spectrum"),
        F.col("peak_b.spectrum"),
        s.fragment_mz_tol,
        s.fragment_mz_tol_unit,
        s.min_relative_intensity,
    )
    no_window = F.col("f.win").isNull()
    pair = pivot.withColumn("sim", F.when(~no_window, sim)).withColumn(
        "ps", F.when(~no_window, rules.pair_status(F.col("sim"), thresholds))
    )
    # Scored pairs are small and everything after is cheap rules. Cutting here keeps a
    # filter on a result column from being pushed down with copies of the comparison.
    pair = durable(pair)
    joined = rt_windows(targets, s).join(pair, "row_id", "left")
    one_rt = F.col("peak_a_rt").isNull() | F.col("peak_b_rt").isNull()
    any_rt = F.col("peak_a_rt").isNotNull() | F.col("peak_b_rt").isNotNull()
    verdict = (
        F.when(one_rt, _verdict("not_evaluated", "two_peak_retention_times_required"))
        .when(F.col("mz").isNull(), _verdict("not_evaluable", "invalid_precursor_mz"))
        .when(
            F.col("rt_separation_sec") == 0,
            _verdict("not_evaluable", "peak_retention_times_are_identical"),
        )
        .when(
            F.coalesce(no_window, F.lit(True)),
            _verdict("not_evaluable", "precursor_outside_acquired_DIA_windows"),
        )
        .otherwise(F.col("ps"))
    )
    diagnosis = rules.ms2_diagnosis(
        F.col("sim"),
        F.col("v.status"),
        F.col("v.reason"),
        F.col("peak_a.quality_flags"),
        F.col("peak_b.quality_flags"),
        F.when(~no_window, F.col("f.match_count")),
        issue_thresholds,
    )
    ref = rules.ms1_reference(F.col("peak_a_rt"), F.col("peak_b_rt"))
    full = (
        joined.withColumn("v", verdict).withColumn("d", diagnosis).withColumn("ref", ref)
    )
    measurable = ~one_rt & F.col("mz").isNotNull()
    windowed = measurable & (F.col("rt_separation_sec") != 0)
    sided = []
    for side, n in (("peak_a", "count_a"), ("peak_b", "count_b")):
        for name in SIDE_FIELDS:
            c = F.col(f"{side}.{name}")
            if name == "fragment_count":
                c = F.coalesce(F.col(f"sim.{n}"), c)
            sided.append(c.alias(f"{side}_{name}"))
    return full.select(
        *targets.columns,
        *sided,
        *[
            F.when(windowed, F.col(f"{side}_rt_window_{end}")).alias(f"{side}_rt_window_{end}")
            for side in SIDES
            for end in ("start", "end")
        ],
        F.when(measurable, F.col("rt_separation_sec")).alias("rt_separation_sec"),
        F.col("f.win").alias("dia_window_center"),
        F.when(~no_window, F.col("f.iso_lo")).alias("dia_window_lower"),
        F.when(~no_window, F.col("f.iso_hi")).alias("dia_window_upper"),
        F.when(~no_window, F.col("f.match_count")).alias("dia_window_match_count"),
        F.col("sim.cosine").alias("ms2_cosine"),
        F.col("sim.entropy").alias("ms2_entropy_similarity"),
        F.col("sim.matched").alias("ms2_matched_peaks"),
        F.col("sim.explained_a").alias("peak_a_explained_intensity"),
        F.col("sim.explained_b").alias("peak_b_explained_intensity"),
        F.col("ref.status").alias("ms1_reference_status"),
        F.col("ref.issue").alias("ms1_reference_issue_codes"),
        F.col("d.status").alias("ms2_diagnostic_status"),
        F.concat_ws(";", "d.issues").alias("ms2_issue_codes"),
        F.col("d.priority").alias("ms2_review_priority"),
        F.col("v.status").alias("enantiomer_pair_status"),
        F.col("v.reason").alias("enantiomer_pair_reason"),
        F.when(~one_rt, "input_double_peak")
        .when(any_rt, "input_single_peak")
        .otherwise("input_no_peak")
        .alias("chromatographic_status"),
        *[c.alias(name) for name, c in rules.status_layers(F.col("v.status")).items()],
    )


def _verdict(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def with_spectrum_text(results: DataFrame) -> DataFrame:
    """Replace spectrum arrays by their ``mz,intensity;…`` text, for table sinks."""
    out = results
    for side in SIDES:
        out = out.withColumn(f"{side}_MS2", fragment_text(F.col(f"{side}_spectrum"))).drop(
            f"{side}_spectrum"
        )
    return out
