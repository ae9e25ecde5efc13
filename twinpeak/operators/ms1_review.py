"""MS1 review layer: several picking configurations side by side, with diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import trace as tr
from ..functions.scalars import source_label_meaning
from ..params import PeakPickSettings
from . import ms1


def rts_min(peaks: Column) -> Column:
    return F.transform(F.coalesce(peaks, F.array()), lambda p: p["rt"] / 60)


def parameter_stability(
    status_a: Column, rts_a: Column, status_b: Column, rts_b: Column, tolerance_min: float = 0.05
) -> Column:
    """Whether two configurations agree on class and on every RT."""
    same_place = (F.size(rts_a) == F.size(rts_b)) & F.forall(
        F.zip_with(rts_a, rts_b, lambda a, b: F.abs(a - b) <= tolerance_min),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    return (
        F.when(~status_a.eqNullSafe(status_b), "unstable_class_across_smoothing")
        .when(status_a == "ambiguous", "ambiguous_in_both_models")
        .when(~same_place, "unstable_rt_across_smoothing")
        .otherwise("stable_class_and_rt")
    )


def candidates_cover(cands: Column, first: Column, second: Column, tolerance_min: float) -> Column:
    """Two different candidates sit at both reference RTs, in order."""
    def near(c, rt):
        return F.abs(c["rt"] / 60 - rt) <= tolerance_min

    return F.coalesce(
        F.exists(
            cands,
            lambda a: near(a, first)
            & F.exists(cands, lambda b: (a["scan"] != b["scan"]) & near(b, second)),
        ),
        F.lit(False),
    )


def double_rts_match(p: Column, q: Column, tolerance_min: float) -> Column:
    """Two predicted RTs match two reviewed RTs directly or swapped."""
    def gap(i, j):
        return F.abs(F.get(p, F.lit(i)) - F.get(q, F.lit(j)))

    direct = F.greatest(gap(0, 0), gap(1, 1))
    swapped = F.greatest(gap(0, 1), gap(1, 0))
    return (F.size(p) == 2) & (F.least(direct, swapped) <= tolerance_min)


def scan_intervals(axes: DataFrame) -> DataFrame:
    """Median time between consecutive scans of each raw file."""
    steps = F.transform(
        F.slice("rts", 2, F.greatest(F.size("rts") - 1, F.lit(0))),
        lambda t, i: t - F.get(F.col("rts"), i),
    )
    return axes.select(
        "raw_id", F.when(F.size("rts") > 1, tr.median(steps)).alias("scan_interval_sec")
    )


def ms2_status_lookup(results: DataFrame) -> DataFrame:
    """Last row wins per compound; status falls back through three columns.

    ``results``: compound_id, row_no and the status columns.
    """
    def filled(name):
        return F.when(F.trim(F.col(name)) != "", F.col(name))

    names = ("ms2_diagnostic_status", "enantiomer_pair_status", "status")
    status = F.coalesce(*[filled(n) for n in names if n in results.columns], F.lit(""))
    return results.groupBy("compound_id").agg(F.max_by(status, "row_no").alias("ms2_status"))


def review_table(
    targets: DataFrame,
    run: ms1.Ms1Run,
    baseline: PeakPickSettings,
    experimental: PeakPickSettings,
    high_recall: PeakPickSettings,
    rt_tolerance_min: float = 0.1,
) -> DataFrame:
    """Review manifest rows: calls of both models, diagnostics, background, views.

    ``targets``: raw_id, mz, peak1, peak2 (minutes, nullable), source_machine_id,
    source_machine_label and any id columns. Each distinct trace is analysed once.
    """
    traced = ms1.traces(targets, run, baseline.eic_ppm)
    base = ms1.pick_peaks(traced, baseline)
    fields = F.struct(*ms1.CALL_FIELDS)
    both = ms1.pick_peaks(
        base.select(*traced.columns, fields.alias("base")), experimental
    ).select(*traced.columns, "base", fields.alias("expt"))
    calls = ms1.enumerate_candidates(both, high_recall)
    rows = targets.join(calls, ["raw_id", "mz"], "left")
    known = F.array_compact(F.array("peak1", "peak2"))
    base_rts, expt_rts = rts_min(F.col("base.peaks")), rts_min(F.col("expt.peaks"))
    protected = F.when(F.size(known) > 0, known).otherwise(base_rts)
    rows = (
        rows.withColumn("background", tr.background(F.col("rts"), F.col("y"), protected))
        .withColumn("reference_status", rules.reference_class(F.col("peak1"), F.col("peak2")))
        .withColumn("baseline_status", F.col("base.chromatographic_status"))
        .withColumn("experimental_status", F.col("expt.chromatographic_status"))
        .withColumn(
            "baseline_diagnostic",
            rules.ms1_prediction_diagnostic(
                F.col("peak1"), F.col("peak2"), F.col("baseline_status"), base_rts, rt_tolerance_min
            ),
        )
        .withColumn(
            "experimental_diagnostic",
            rules.ms1_prediction_diagnostic(
                F.col("peak1"), F.col("peak2"), F.col("experimental_status"), expt_rts,
                rt_tolerance_min,
            ),
        )
        .withColumn(
            "parameter_stability",
            parameter_stability(
                F.col("baseline_status"), base_rts, F.col("experimental_status"), expt_rts
            ),
        )
        .withColumn(
            "candidate_pair_covers_reference",
            candidates_cover(
                F.col("candidates"), F.col("peak1"), F.col("peak2"), rt_tolerance_min
            ),
        )
        .withColumn("source_interpretation", source_label_meaning(F.col("source_machine_label")))
    )
    view_cols = {
        name: F.col(name)
        for name in (
            "reference_status", "baseline_status", "baseline_diagnostic",
            "experimental_diagnostic", "parameter_stability", "source_machine_id",
            "source_machine_label", "source_interpretation", "peak1", "peak2",
        )
    }
    view_cols["low_clean_candidate"] = F.col("background.low_clean_candidate")
    views = F.array_distinct(F.concat(rules.ms1_views(view_cols), exporter_views()))
    return rows.withColumn("views", views).select(
        *targets.columns,
        *[n for n in view_cols if n not in targets.columns and n != "low_clean_candidate"],
        "experimental_status",
        "candidate_pair_covers_reference",
        F.size("candidates").alias("review_candidate_count"),
        "background.*",
        F.col("base.resolution").alias("baseline_resolution"),
        F.col("base.valley_ratio").alias("baseline_valley_ratio"),
        F.array_max("y").alias("max_intensity"),
        "views",
    )


def exporter_views() -> Column:
    """Views that depend on pair quality, intensity range and candidate count."""
    top = F.array_max("y")

    def when(cond, name):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(name))

    return F.array_compact(
        F.array(
            when(F.col("base.resolution") < 1, "review_queues/low_resolution_fwhm_lt1"),
            when(F.col("base.height_ratio") < 0.1, "review_queues/weak_second_peak_ratio_lt0.1"),
            when(
                F.array_contains("base.review_reasons", "shallow_valley"),
                "review_queues/shallow_valley",
            ),
            when((top >= 200_000) & (top < 500_000), "audit/intensity_0.2_to_0.5M"),
            when((top >= 500_000) & (top < 1_000_000), "audit/intensity_0.5_to_1M"),
            when(
                F.size("candidates") >= 12, "review_queues/high_recall_candidate_explosion"
            ),
        )
    )
