"""Extracted-ion chromatograms and their summaries, per (row_id, side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..functions.spectra import total
from .dia import Ms2Run, band_join, rt_join

KEY = ["row_id", "side"]


def sum_eic(bands: DataFrame, run: Ms2Run, width: float) -> DataFrame:
    """(row_id, side, scan, rt, it): summed intensity for every scan of the RT window.

    Scans without a centroid in the band stay with zero intensity. Spine and matches
    meet in one group-by, so no join re-aligns them.
    """
    spine = rt_join(bands.select(*KEY, "raw_id", "win", "rt_lo", "rt_hi"), run.headers).select(
        *KEY, "scan", "rt", F.lit(0.0).alias("it")
    )
    hits = (
        band_join(
            bands.select(*KEY, "raw_id", "win", "rt_lo", "rt_hi", "mz_lo", "mz_hi"),
            run.peaks,
            width,
        )
        .where(F.col("p_scan").isNotNull())
        .select(
            *KEY, F.col("p_scan").alias("scan"), F.col("p_rt").alias("rt"), F.col("p_it").alias("it")
        )
    )
    return spine.unionByName(hits).groupBy(*KEY, "scan", "rt").agg(F.sum("it").alias("it"))


def trace_array() -> Column:
    """Sorted ``array<struct<rt,scan,it>>`` aggregate of one RT window's scans.

    Bounded by the scans an RT window can hold, whatever the size of the run.
    """
    return F.sort_array(F.collect_list(F.struct("rt", "scan", "it")))


def apex(trace: Column) -> Column:
    """First point of maximal intensity, or NULL for an empty trace."""
    ranked = F.transform(
        trace,
        lambda p, i: F.struct(p["it"].alias("it"), (-i).alias("neg"), p["rt"].alias("rt"), p["scan"].alias("scan")),
    )
    return F.array_max(ranked)


def trapezoid(trace: Column) -> Column:
    """Area under (rt, it) points; NULL with fewer than two points."""
    def step(acc, p):
        piece = (p["rt"] - acc["rt"]) * (acc["it"] + p["it"]) / 2
        return F.struct(
            p["rt"].alias("rt"),
            p["it"].alias("it"),
            (acc["area"] + F.coalesce(piece, F.lit(0.0))).alias("area"),
        )

    none = F.lit(None).cast("double")
    start = F.struct(none.alias("rt"), none.alias("it"), F.lit(0.0).alias("area"))
    return F.when(F.size(trace) >= 2, F.aggregate(trace, start, step, lambda acc: acc["area"]))


def xic_summary(trace: Column) -> Column:
    """Struct(apex_rt, apex_intensity, area, flag) of one trace."""
    return let(
        apex(trace),
        lambda top: F.struct(
            top["rt"].alias("apex_rt"),
            top["it"].alias("apex_intensity"),
            trapezoid(trace).alias("area"),
            F.when(F.size(trace) == 0, "empty_xic")
            .when(F.size(trace) < 2, "insufficient_points")
            .otherwise("ok")
            .alias("flag"),
        ),
    )


def top_scans(trace: Column, k: int) -> Column:
    """Up to ``k`` scans of highest positive intensity, earliest first on ties."""
    ranked = F.sort_array(
        F.transform(
            F.filter(trace, lambda p: p["it"] > 0),
            lambda p: F.struct((-p["it"]).alias("neg"), p["scan"].alias("scan")),
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda r: r["scan"])


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def is_constant(values: Column) -> Column:
    return F.array_max(values) == F.array_min(values)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two equal-length arrays; 0 below two points or without variance."""
    def scored(m):
        dx = F.transform(x, lambda v: v - m["x"])
        dy = F.transform(y, lambda v: v - m["y"])

        def ratio(d):
            def dot(a, b):
                return total(F.zip_with(a, b, lambda p, q: p * q))

            return F.coalesce(
                F.try_divide(
                    dot(d["x"], d["y"]), F.sqrt(dot(d["x"], d["x"])) * F.sqrt(dot(d["y"], d["y"]))
                ),
                F.lit(0.0),
            )

        return let(F.struct(dx.alias("x"), dy.alias("y")), ratio)

    usable = (F.size(x) >= 2) & ~is_constant(x) & ~is_constant(y)
    means = F.struct(mean(x).alias("x"), mean(y).alias("y"))
    return F.when(usable, let(means, scored)).otherwise(F.lit(0.0))


def longest_run(flags: Column) -> Column:
    """Longest stretch of TRUE in a boolean array."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, f):
        def grown(n):
            return F.struct(n.alias("now"), F.greatest(acc["best"], n).alias("best"))

        return let(F.when(f, acc["now"] + 1).otherwise(F.lit(0)), grown)

    return F.aggregate(flags, start, step, lambda acc: acc["best"])


def active_support_correlation(
    x: Column, y: Column, min_relative: float, min_scans: int, max_offset: int, min_run: int
) -> Column:
    """Correlation inside the precursor's active scans, NULL when support is too thin."""
    def judge(m):
        keep_x = F.transform(x, lambda v: v >= m["x"] * min_relative)
        apex_gap = F.abs(F.array_position(x, m["x"]) - F.array_position(y, m["y"]))
        both = F.zip_with(
            keep_x, F.transform(y, lambda v: v >= m["y"] * min_relative), lambda a, b: a & b
        )
        support_x = F.filter(x, lambda v: v >= m["x"] * min_relative)
        support_y = F.filter(y, lambda v, i: F.get(keep_x, i))
        ok = (
            (m["x"] > 0)
            & (m["y"] > 0)
            & (apex_gap <= max_offset)
            & (F.size(support_x) >= min_scans)
            & (longest_run(both) >= min_run)
        )
        return F.when(ok, pearson(support_x, support_y))

    return let(F.struct(F.array_max(x).alias("x"), F.array_max(y).alias("y")), judge)
