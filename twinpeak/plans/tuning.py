"""Peak-picker tuning on reviewed targets, as one job over all settings.

Detection settings are a column: traces are smoothed once for each window, every setting of that window
picks from the same smoothed row, and what it calls is joined to the reviewed targets. Calls are then
counted by the quality thresholds that they reach, so that the quality grid is summed over a few cells
and not over calls. The best of all settings is a maximum over the grid.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict, fields, replace
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trace as tr
from ..functions.scalars import hash_bucket, safe_divide
from ..operators import ms1
from ..operators.ms1_review import double_rts_match, rts_min
from ..operators.ordered import distinct_totals, running_totals
from ..params import PeakPickSettings
from ..session import durable

# Detection and quality grids of the two tuning modes.
LEGACY_CORE = {"sg_window": (5, 7, 9), "min_height": (100_000.0, 200_000.0, 500_000.0), "min_distance_scans": (15, 20, 25, 30)}
LEGACY_QUALITY = ((0.5, 0.7, 0.85, 1.0), (0.0, 0.5, 1.0), (0.05, 0.1, 0.2, 0.3))
ADAPTIVE_CORE = {
    "sg_window": (3, 5, 7), "min_height": (None, 100_000.0, 200_000.0), "min_prominence_ratio": (0.03, 0.1, 0.25),
    "min_support_scans": (2, 3), "min_distance_sec": (6.0, 12.0), "close_peak_max_valley_ratio": (0.85, 1.0),
}
ADAPTIVE_QUALITY = ((0.7, 0.85, 0.95, 1.0), (0.0,), (0.02, 0.05, 0.1, 0.2))
CLOSE_DOUBLE_SEC = 12.0
CLASSES = ("no_peak", "single_peak", "double_peak")
# What settings are ranked by, most important first.
LEGACY_ORDER = ("balanced_accuracy", "precision", "recall")
ADAPTIVE_ORDER = ("macro_recall", "accuracy", "close_double_recall", "double_peak_recall", "single_peak_recall", "no_peak_recall")


def core_settings(adaptive: bool) -> list[PeakPickSettings]:
    grid = ADAPTIVE_CORE if adaptive else LEGACY_CORE
    fixed = {"rank_by_prominence": True} if adaptive else {}
    return [
        PeakPickSettings(**dict(zip(grid, values)), **fixed) for values in itertools.product(*grid.values())
    ]


def with_quality(picks: DataFrame, quality) -> DataFrame:
    """Repeat each call over the fixed quality grid (max_valley, min_resolution, min_second)."""
    combos = [
        F.struct(
            F.lit(n).alias("order"), F.lit(v).alias("max_valley_ratio"),
            F.lit(r).alias("min_resolution"), F.lit(s).alias("min_second_peak_ratio"),
        )
        for n, (v, r, s) in enumerate(itertools.product(*quality))
    ]
    return picks.withColumn("q", F.explode(F.array(*combos)))


def double_call() -> Column:
    """The quality-gated double call of one (pick, quality) row."""
    resolved = (F.col("q.min_resolution") <= 0) | F.coalesce(
        F.col("resolution") >= F.col("q.min_resolution"), F.lit(False)
    )
    return F.coalesce(
        (F.col("chromatographic_status") == "double_peak")
        & (F.size("peaks") >= 2)
        & (F.col("valley_ratio") <= F.col("q.max_valley_ratio"))
        & resolved
        & (F.col("height_ratio") >= F.col("q.min_second_peak_ratio")),
        F.lit(False),
    )


_Q = ("q.order", "q.max_valley_ratio", "q.min_resolution", "q.min_second_peak_ratio")


def two_class_metrics(rows: DataFrame) -> DataFrame:
    """Double / not-double confusion per quality setting; truth is a reviewed second peak."""
    call, truth = double_call(), F.col("peak2").isNotNull()
    out = rows.groupBy(*_Q).agg(
        F.count_if(call & truth).alias("tp"), F.count_if(call & ~truth).alias("fp"),
        F.count_if(~call & ~truth).alias("tn"), F.count_if(~call & truth).alias("fn"),
    )
    return out.withColumns(_two_class_rates())


def _two_class_rates() -> dict[str, Column]:
    recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = safe_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return {
        "precision": safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": recall,
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2,
    }


def _rt_aware_rates() -> dict[str, Column]:
    recalls = {f"{c}_recall": safe_divide(F.col(f"{c}_ok"), F.col(f"{c}_rows")) for c in CLASSES}
    supported = sum(F.when(F.col(f"{c}_rows") > 0, 1).otherwise(0) for c in CLASSES)
    return {
        **recalls,
        "accuracy": safe_divide(F.col("correct"), F.col("rows")),
        "close_double_recall": safe_divide(F.col("close_ok"), F.col("close_double_rows")),
        "macro_recall": safe_divide(sum(recalls.values()), supported),
    }


def rt_aware_metrics(rows: DataFrame, tolerance_min: float = 0.1) -> DataFrame:
    """None/single/double accuracy where a right class at the wrong RT counts as wrong."""
    p1, p2 = F.col("peak1"), F.col("peak2")
    bad = p1.isNull() & p2.isNotNull()
    truth = (
        F.when(bad, F.raise_error("Peak2 reviewed without Peak1"))
        .when(p1.isNull(), "no_peak").when(p2.isNull(), "single_peak").otherwise("double_peak")
    )
    called = (
        F.when(double_call(), "double_peak")
        .when((F.col("chromatographic_status") == "single_peak") & (F.size("peaks") == 1), "single_peak")
        .when(F.size("peaks") == 0, "no_peak").otherwise("ambiguous")
    )
    rts = rts_min(F.slice("peaks", 1, 2))
    judged = rows.withColumn("truth", truth).withColumn("called", called).withColumn("rts", rts)
    same = F.col("truth") == F.col("called")
    placed = F.coalesce(
        F.when(F.col("truth") == "no_peak", F.lit(True))
        .when(F.col("truth") == "single_peak", F.abs(F.get("rts", F.lit(0)) - p1) <= tolerance_min)
        .otherwise(double_rts_match(F.col("rts"), F.array(p1, p2), tolerance_min)),
        F.lit(False),
    )
    ok = same & placed
    close = F.coalesce((F.col("truth") == "double_peak") & (F.abs(p2 - p1) * 60 <= CLOSE_DOUBLE_SEC), F.lit(False))
    aggs = [
        F.count("*").alias("rows"), F.count_if(ok).alias("correct"),
        F.count_if(same & ~placed).alias("mislocalized"),
        F.count_if(close).alias("close_double_rows"), F.count_if(close & ok).alias("close_ok"),
    ]
    for c in CLASSES:
        aggs += [F.count_if(F.col("truth") == c).alias(f"{c}_rows"), F.count_if(ok & (F.col("truth") == c)).alias(f"{c}_ok")]
    return judged.groupBy(*_Q).agg(*aggs).withColumns(_rt_aware_rates())


def rt_error_summary(rows: DataFrame, by=()) -> DataFrame:
    """Worst RT error of called doubles: counts, and nearest-rank median and p90, per group of ``by``."""
    worst = F.greatest(
        F.abs(F.get(rts_min(F.col("peaks")), F.lit(0)) - F.col("peak1")),
        F.abs(F.get(rts_min(F.col("peaks")), F.lit(1)) - F.col("peak2")),
    )
    errors = rows.where(F.col("peak2").isNotNull()).select(*by, F.when(double_call(), worst).alias("e"))
    counted = durable(errors.groupBy(*by, "e").agg(F.count("*").alias("n")))
    run = running_totals(distinct_totals(counted, F.col("e"), by, n=F.col("n")), ["n"], by=by)
    median_at = F.floor(F.col("all_n") / 2)
    p90_at = F.floor(0.9 * (F.col("all_n") - 1))
    summary = run.groupBy(*by).agg(
        F.max("all_n").alias("predicted_double_rows"),
        F.sum(F.when(F.col("k") <= 0.1, F.col("n"))).alias("both_rt_within_0_1_min"),
        F.min(F.when(F.col("cum_n") > median_at, F.col("k"))).alias("median_worst_rt_error_min"),
        F.min(F.when(F.col("cum_n") > p90_at, F.col("k"))).alias("p90_worst_rt_error_min"),
    )
    positives = counted.groupBy(*by).agg(F.sum("n").alias("positive_rows"))
    if by:
        zero = {"predicted_double_rows": 0, "both_rt_within_0_1_min": 0}
        return positives.join(summary, list(by), "left").fillna(zero)
    return positives.select(F.coalesce("positive_rows", F.lit(0)).alias("positive_rows")).crossJoin(F.broadcast(summary))  # one row each


def reviewed_rows(targets: DataFrame, traced: DataFrame, c: PeakPickSettings) -> DataFrame:
    """Targets joined with the calls of their own trace under one detection setting."""
    calls = ms1.pick_peaks(traced, c).select("raw_id", "mz", *ms1.CALL_FIELDS)
    return targets.join(calls, ["raw_id", "mz"])


def setting_columns(core: list[PeakPickSettings]) -> SimpleNamespace:
    """The settings as columns of the struct ``core``; what all share stays a constant."""
    if len({c.adaptive for c in core}) != 1 or any(c.sg_polyorder != core[0].sg_polyorder for c in core):
        raise ValueError("settings of one job must be of one mode and polynomial order")
    values = {f.name: getattr(core[0], f.name) for f in fields(core[0])}
    varied = {n: F.col(f"core.{n}") for n in values if len({getattr(c, n) for c in core}) > 1 and n != "sg_window"}
    return SimpleNamespace(**(values | varied), adaptive=core[0].adaptive)


def _setting(order: int, c: PeakPickSettings) -> Column:
    whole = ("sg_window", "min_distance_scans", "min_support_scans")
    names = ("sg_window", "min_height", "min_distance_scans", "min_prominence_ratio", "min_support_scans", "min_distance_sec", "close_peak_max_valley_ratio")
    cells = [F.lit(getattr(c, n)).cast("int" if n in whole else "double").alias(n) for n in names]
    return F.struct(F.lit(order).alias("order"), *cells)


def picked_grid(traced: DataFrame, core: list[PeakPickSettings]) -> DataFrame:
    """(raw_id, mz, core, call fields): every trace picked under every detection setting."""
    rows = None
    for window in sorted({c.sg_window for c in core}):
        settings = [_setting(i, c) for i, c in enumerate(core) if c.sg_window == window]
        some = traced.withColumn("s", ms1.smoothed(F.col("y"), window, core[0].sg_polyorder))
        if core[0].adaptive:
            some = some.withColumn("measured", tr.measured_maxima(F.col("s.smooth"), F.col("s.baseline"), None))
        some = some.withColumn("core", F.explode(F.array(*settings)))
        rows = some if rows is None else rows.unionByName(some)
    return ms1.pick_peaks(rows, setting_columns(core)).select("raw_id", "mz", "core", *ms1.CALL_FIELDS)


def _judged(rows: DataFrame, tolerance_min: float) -> DataFrame:
    """Truth, the class called where the double is refused, and whether RTs fit, of each call."""
    p1, p2 = F.col("peak1"), F.col("peak2")
    truth = (
        F.when(p1.isNull() & p2.isNotNull(), F.raise_error("Peak2 reviewed without Peak1"))
        .when(p1.isNull(), "no_peak").when(p2.isNull(), "single_peak").otherwise("double_peak")
    )
    refused = (
        F.when((F.col("chromatographic_status") == "single_peak") & (F.size("peaks") == 1), "single_peak")
        .when(F.size("peaks") == 0, "no_peak").otherwise("ambiguous")
    )
    rts = rts_min(F.slice("peaks", 1, 2))
    placed = F.coalesce(
        F.when(F.col("truth") == "no_peak", F.lit(True))
        .when(F.col("truth") == "single_peak", F.abs(F.get("rts", F.lit(0)) - p1) <= tolerance_min)
        .otherwise(double_rts_match(F.col("rts"), F.array(p1, p2), tolerance_min)),
        F.lit(False),
    )
    close = F.coalesce((F.col("truth") == "double_peak") & (F.abs(p2 - p1) * 60 <= CLOSE_DOUBLE_SEC), F.lit(False))
    return rows.withColumns({"truth": truth, "refused": refused, "rts": rts}).withColumns({"placed": placed, "close": close})


def quality_cells(rows: DataFrame, quality, tolerance_min: float = 0.1) -> DataFrame:
    """Calls counted by setting, judgement and how far up each quality axis they get.

    valley: thresholds below the call's ratio, which refuse it; resolution and second: thresholds that
    it reaches. No double, or an unknown value, gets nowhere.
    """
    valleys, resolutions, seconds = (sorted(axis) for axis in quality)
    double = F.coalesce((F.col("chromatographic_status") == "double_peak") & (F.size("peaks") >= 2), F.lit(False))
    many = lambda tests: sum((F.when(t, 1).otherwise(0) for t in tests[1:]), F.when(tests[0], 1).otherwise(0))
    refuses = [~F.coalesce(F.col("valley_ratio") <= v, F.lit(False)) for v in valleys]
    reaches = [F.lit(r <= 0) | F.coalesce(F.col("resolution") >= r, F.lit(False)) for r in resolutions]
    strong = [F.coalesce(F.col("height_ratio") >= h, F.lit(False)) for h in seconds]
    return (
        _judged(rows, tolerance_min)
        .groupBy(
            "core", "truth", "refused", "placed", "close",
            F.when(double, many(refuses)).otherwise(len(valleys)).alias("valley"),
            many(reaches).alias("resolution"), many(strong).alias("second"),
        )
        .agg(F.count("*").alias("n"))
    )


def grid_metrics(cells: DataFrame, quality, adaptive: bool) -> DataFrame:
    """Metrics of every detection setting under every quality setting, from the counted cells."""
    axes = [sorted(axis) for axis in quality]
    combos = [
        F.struct(
            F.lit(n).alias("order"), F.lit(v).alias("max_valley_ratio"), F.lit(r).alias("min_resolution"), F.lit(s).alias("min_second_peak_ratio"),
            F.lit(axes[0].index(v)).alias("v"), F.lit(axes[1].index(r)).alias("r"), F.lit(axes[2].index(s)).alias("s"),
        )
        for n, (v, r, s) in enumerate(itertools.product(*quality))
    ]
    rows = cells.withColumn("q", F.explode(F.array(*combos)))
    call = (F.col("valley") <= F.col("q.v")) & (F.col("resolution") > F.col("q.r")) & (F.col("second") > F.col("q.s"))
    rows = rows.withColumn("call", call).withColumn("same", F.when(call, "double_peak").otherwise(F.col("refused")) == F.col("truth"))
    ok, call = F.col("same") & F.col("placed"), F.col("call")
    count = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    group = rows.groupBy("core", *[F.col(f"q.{n}") for n in ("order", "max_valley_ratio", "min_resolution", "min_second_peak_ratio")])
    if not adaptive:
        truth = F.col("truth") == "double_peak"
        out = group.agg(count(call & truth, "tp"), count(call & ~truth, "fp"), count(~call & ~truth, "tn"), count(~call & truth, "fn"))
        return out.withColumns(_two_class_rates())
    aggs = [
        F.sum("n").alias("rows"), count(ok, "correct"), count(F.col("same") & ~F.col("placed"), "mislocalized"),
        count(F.col("close"), "close_double_rows"), count(F.col("close") & ok, "close_ok"),
    ]
    for c in CLASSES:
        aggs += [count(F.col("truth") == c, f"{c}_rows"), count(ok & (F.col("truth") == c), f"{c}_ok")]
    return group.agg(*aggs).withColumns(_rt_aware_rates())


def best_setting(metrics: DataFrame, adaptive: bool) -> DataFrame:
    """The one row of all settings that comes first: by the metrics, then the smallest window and distance."""
    order = ADAPTIVE_ORDER if adaptive else LEGACY_ORDER
    last = F.coalesce("core.min_support_scans", F.lit(0)) if adaptive else F.col("core.min_distance_scans")
    # Ties go to the setting that the grids list first.
    rank = F.struct(*order, (-F.col("core.sg_window")).alias("w"), (-last).alias("l"), (-F.col("core.order")).alias("c"), (-F.col("order")).alias("q"))
    row = F.struct(*metrics.columns)
    return metrics.agg(F.max_by(row, rank).alias("best")).select("best.*")


def tune(targets: DataFrame, run: ms1.Ms1Run, adaptive: bool = False, rt_tolerance_min: float = 0.1, core=None) -> dict:
    """Choose settings on the calibration split, then judge them once on the test split.

    ``targets``: compound_id, raw_id, mz, peak1, peak2. Traces are extracted once; test
    rows are not picked before the settings are fixed.
    """
    targets = targets.where(F.col("mz").isNotNull()).withColumn("split", hash_bucket(F.col("compound_id")) == 0)
    calibration, test = targets.where(~F.col("split")), targets.where(F.col("split"))
    if calibration.isEmpty() or test.isEmpty():
        raise ValueError("the deterministic split must leave both calibration and test rows")
    core = list(core or core_settings(adaptive))
    quality = ADAPTIVE_QUALITY if adaptive else LEGACY_QUALITY
    traced = durable(ms1.traces(calibration, run, 3.0))
    cells = quality_cells(calibration.join(picked_grid(traced, core), ["raw_id", "mz"]), quality, rt_tolerance_min)
    metrics = best_setting(grid_metrics(cells, quality, adaptive), adaptive).first().asDict()
    c = core[metrics.pop("core")["order"]]
    chosen = {k: metrics[k] for k in ("max_valley_ratio", "min_resolution", "min_second_peak_ratio")}
    final = replace(c, **chosen) if adaptive else c
    held = with_quality(
        reviewed_rows(test, ms1.traces(test, run, 3.0), final), tuple((v,) for v in chosen.values())
    )
    measured = rt_aware_metrics(held, rt_tolerance_min) if adaptive else two_class_metrics(held)
    out = {
        "method": "deterministic_compound_holdout_80_20" + ("_rt_aware_adaptive" if adaptive else ""),
        "calibration_rows": calibration.count(),
        "test_rows": test.count(),
        "peak_picking_config": asdict(final),
        "quality_thresholds": chosen,
        "calibration_metrics": metrics,
        "test_metrics": measured.first().asDict(),
    }
    if not adaptive:
        out["test_rt_validation"] = rt_error_summary(held).first().asDict()
    return out
