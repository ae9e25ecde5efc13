"""Isolation-window index, target routing, and the run tables joins read from.

Joins over m/z or RT bands are equi-joins on integer bins plus the exact residual, so
they hash (and split on skew) instead of becoming nested loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mz_bounds
from ..params import ExtractionSettings

RT_BIN_SEC = 30.0
WINDOW_BIN_MZ = 10.0


@dataclass(frozen=True)
class Ms2Run:
    """MS2 data of any number of raw files.

    headers: raw_id, win, scan, rt                      one row per scan
    peaks:   raw_id, win, scan, rt, mz, it              one row per centroid
    spectra: raw_id, win, scan, peaks array<struct>     one row per scan
    windows: raw_id, win, iso_lo, iso_hi, mz_min, mz_max, rt_first, rt_last, n_scans
    """

    headers: DataFrame
    peaks: DataFrame
    spectra: DataFrame
    windows: DataFrame


def bins(lo: Column, hi: Column, width: float) -> Column:
    """Every bin a closed band touches; empty for a reversed band."""
    first, last = F.floor(lo / width), F.floor(hi / width)
    return F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )


def mz_bin_width(tol: float, unit: str) -> float:
    """At least one full band wide at m/z 2000, so a band touches two bins at most."""
    half = {"Da": tol, "ppm": 2000.0 * tol / 1e6, "legacy_fraction": 2000.0 * tol}[unit]
    return max(0.05, 2.0 * half)


def window_index(peaks: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per (raw, exact centre) from centroid rows carrying isolation bounds."""
    stats = peaks.groupBy("raw_id", "win").agg(
        F.min("iso_lo").alias("iso_lo"),
        F.max("iso_hi").alias("iso_hi"),
        F.min("mz").alias("mz_min"),
        F.max("mz").alias("mz_max"),
        F.min("rt").alias("rt_first"),
        F.max("rt").alias("rt_last"),
        F.countDistinct("scan").alias("n_scans"),
    )
    if headers is None:
        return stats
    spans = headers.groupBy("raw_id", "win").agg(
        F.min("rt").alias("rt_first"), F.max("rt").alias("rt_last"), F.count("*").alias("n_scans")
    )
    return stats.drop("rt_first", "rt_last", "n_scans").join(spans, ["raw_id", "win"], "right")


def run_from_peaks(peaks: DataFrame) -> Ms2Run:
    """Run tables from centroid rows; every scan holds at least one centroid."""
    keys = ["raw_id", "win", "scan"]
    return Ms2Run(
        headers=peaks.select(*keys, "rt").distinct(),
        peaks=peaks.select(*keys, "rt", "mz", "it"),
        spectra=peaks.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("mz", "it"))).alias("peaks")
        ),
        windows=window_index(peaks),
    )


def run_from_scans(scans: DataFrame) -> Ms2Run:
    """Run tables from stored scans (raw_id, win, scan, rt, iso_lo, iso_hi, peaks)."""
    keys = ["raw_id", "win", "scan"]
    mzs = F.transform("peaks", lambda p: p["mz"])
    windows = scans.groupBy("raw_id", "win").agg(
        F.min("iso_lo").alias("iso_lo"),
        F.max("iso_hi").alias("iso_hi"),
        F.min(F.array_min(mzs)).alias("mz_min"),
        F.max(F.array_max(mzs)).alias("mz_max"),
        F.min("rt").alias("rt_first"),
        F.max("rt").alias("rt_last"),
        F.count("*").alias("n_scans"),
    )
    return Ms2Run(
        headers=scans.select(*keys, "rt"),
        peaks=scans.select(*keys, "rt", F.explode("peaks").alias("p")).select(
            *keys, "rt", "p.mz", "p.it"
        ),
        spectra=scans.select(*keys, "peaks"),
        windows=windows,
    )


def window_centres(scans: DataFrame) -> DataFrame:
    """Distinct centres with their first-seen rank inside each raw file."""
    return scans.groupBy("raw_id", "win").agg(F.min("scan_no").alias("first_scan_no"))


def acquired_bounds(windows: DataFrame, fallback_width: float) -> DataFrame:
    """Isolation bounds used for routing: recorded ones, or centre +/- half the fallback."""
    known = F.col("iso_lo").isNotNull() & F.col("iso_hi").isNotNull()
    half = float(fallback_width) / 2
    return windows.withColumn(
        "route_lo", F.when(known, F.col("iso_lo")).otherwise(F.col("win") - half)
    ).withColumn("route_hi", F.when(known, F.col("iso_hi")).otherwise(F.col("win") + half))


def _windows_by_bin(windows: DataFrame, fallback_width: float) -> DataFrame:
    """Windows packed per (raw, m/z bin): one short array for each bin."""
    packed = F.struct(
        "win", "iso_lo", "iso_hi", "mz_min", "mz_max", "rt_first", "rt_last", "route_lo", "route_hi"
    )
    return (
        acquired_bounds(windows, fallback_width)
        .withColumn("bin", F.explode(bins(F.col("route_lo"), F.col("route_hi"), WINDOW_BIN_MZ)))
        .groupBy("raw_id", "bin")
        .agg(F.collect_list(packed).alias("near"))
    )


def interval_join(targets: DataFrame, windows: DataFrame, fallback_width: float = 15.0) -> DataFrame:
    """Every (target, covering window) row, with the number of covering windows."""
    routed = route_targets(targets, windows, fallback_width)
    return routed.withColumn("hit", F.explode("hits")).select(
        *targets.columns, "match_count", F.col("hit.win").alias("win"), F.col("hit.dist").alias("dist")
    )


def route_targets(targets: DataFrame, windows: DataFrame, fallback_width: float = 15.0) -> DataFrame:
    """Attach covering windows as ``hits`` (nearest first) and ``match_count``.

    A target reads exactly one bin, so it stays one row: no regrouping, and targets
    without a window keep an empty ``hits``.
    """
    near = _windows_by_bin(windows, fallback_width)
    joined = targets.withColumn("bin", F.floor(F.col("mz") / WINDOW_BIN_MZ)).join(
        near, ["raw_id", "bin"], "left"
    )
    covering = F.filter(
        F.coalesce(F.col("near"), F.array()),
        lambda w: (w["route_lo"] <= F.col("mz")) & (F.col("mz") <= w["route_hi"]),
    )
    ranked = F.sort_array(
        F.transform(
            covering,
            lambda w: F.struct(
                F.abs(w["win"] - F.col("mz")).alias("dist"),
                w["win"].alias("win"),
                w["iso_lo"].alias("iso_lo"),
                w["iso_hi"].alias("iso_hi"),
                w["mz_min"].alias("mz_min"),
                w["mz_max"].alias("mz_max"),
                w["rt_first"].alias("rt_first"),
                w["rt_last"].alias("rt_last"),
            ),
        )
    )
    return joined.select(*targets.columns, ranked.alias("hits")).withColumn(
        "match_count", F.size("hits")
    )


def rt_windows(targets: DataFrame, settings: ExtractionSettings) -> DataFrame:
    """RT coordinates in seconds and half widths that leave a gap between close peaks."""
    factor = 60.0 if settings.rt_unit == "min" else 1.0
    a, b = F.col("peak_a_rt") * factor, F.col("peak_b_rt") * factor
    gap = F.abs(b - a)
    half = F.when(gap.isNotNull(), F.least(F.lit(float(settings.rt_half_window_sec)), gap * 0.4))
    return (
        targets.withColumn("rt_separation_sec", gap)
        .withColumn("peak_a_rt_window_start", a - half)
        .withColumn("peak_a_rt_window_end", a + half)
        .withColumn("peak_b_rt_window_start", b - half)
        .withColumn("peak_b_rt_window_end", b + half)
    )


def clamped_band(
    mz: Column, tol: float, unit: str, mz_min: Column, mz_max: Column
) -> tuple[Column, Column]:
    lo, hi = mz_bounds(mz, tol, unit)
    return F.greatest(mz_min, lo), F.least(mz_max, hi)


def unmatched_key() -> Column:
    """A negative key spread by (row_id, side): real bins and scans are never negative.

    Outer-join rows without a key would otherwise all hash to one partition.
    """
    return -1 - F.pmod(F.xxhash64("row_id", "side"), F.lit(4096))


def band_join(bands: DataFrame, peaks: DataFrame, width: float) -> DataFrame:
    """Join (raw_id, win, mz_lo, mz_hi, rt_lo, rt_hi, …) bands to centroids in them.

    Rows with ``mz_lo`` NULL are carried through unmatched, under a salted key.
    """
    keyed = bands.withColumn(
        "rt_bin", F.explode_outer(bins(F.col("rt_lo"), F.col("rt_hi"), RT_BIN_SEC))
    ).withColumn("mz_bin", F.explode_outer(bins(F.col("mz_lo"), F.col("mz_hi"), width)))
    keyed = keyed.withColumn("mz_bin", F.coalesce("mz_bin", unmatched_key()))
    p = peaks.select(
        "raw_id",
        "win",
        F.col("scan").alias("p_scan"),
        F.col("rt").alias("p_rt"),
        F.col("mz").alias("p_mz"),
        F.col("it").alias("p_it"),
        F.floor(F.col("rt") / RT_BIN_SEC).alias("rt_bin"),
        F.floor(F.col("mz") / width).alias("mz_bin"),
    ).alias("p")
    k = keyed.alias("k")
    keys = ["raw_id", "win", "rt_bin", "mz_bin"]
    exact = (
        F.col("p.p_mz").between(F.col("k.mz_lo"), F.col("k.mz_hi"))
        & F.col("p.p_rt").between(F.col("k.rt_lo"), F.col("k.rt_hi"))
    )
    on = exact
    for key in keys:
        on = on & (F.col(f"k.{key}") == F.col(f"p.{key}"))
    return k.join(p, on, "left").select(
        *[F.col(f"k.{c}") for c in bands.columns], "p.p_scan", "p.p_rt", "p.p_it"
    )


def rt_join(bands: DataFrame, headers: DataFrame) -> DataFrame:
    """Join (raw_id, win, rt_lo, rt_hi, …) windows to the scans inside them."""
    k = bands.withColumn(
        "rt_bin", F.explode(bins(F.col("rt_lo"), F.col("rt_hi"), RT_BIN_SEC))
    ).alias("k")
    h = headers.select(
        "raw_id", "win", "scan", "rt", F.floor(F.col("rt") / RT_BIN_SEC).alias("rt_bin")
    ).alias("h")
    on = F.col("h.rt").between(F.col("k.rt_lo"), F.col("k.rt_hi"))
    for key in ("raw_id", "win", "rt_bin"):
        on = on & (F.col(f"k.{key}") == F.col(f"h.{key}"))
    return k.join(h, on).select(*[F.col(f"k.{c}") for c in bands.columns], "h.scan", "h.rt")
