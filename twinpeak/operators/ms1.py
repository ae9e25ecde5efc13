"""MS1 max-EIC extraction and peak picking for any number of raw files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trace as tr
from ..functions.scalars import let, mz_bounds
from ..params import PeakPickSettings
from ..session import durable, work_partitions
from .dia import bins, mz_bin_width


@dataclass(frozen=True)
class Ms1Run:
    """MS1 data: peaks (raw_id, scan, mz, it) and axes (raw_id, rts array in scan order)."""

    peaks: DataFrame
    axes: DataFrame


def run_from_peaks(peaks: DataFrame) -> Ms1Run:
    """Build from centroid rows (raw_id, scan, rt, mz, it); scan numbers may have holes."""
    scans = peaks.select("raw_id", "scan", "rt").distinct()
    return Ms1Run(peaks.select("raw_id", "scan", "mz", "it"), axes_of(scans))


def run_from_scans(scans: DataFrame) -> Ms1Run:
    """Build from stored scans (raw_id, scan, rt, peaks array)."""
    peaks = scans.select("raw_id", "scan", F.explode("peaks").alias("p")).select(
        "raw_id", "scan", "p.mz", "p.it"
    )
    return Ms1Run(peaks, axes_of(scans.select("raw_id", "scan", "rt")))


def axes_of(scans: DataFrame) -> DataFrame:
    """One row per raw file: scan numbers and RTs in acquisition order."""
    points = F.sort_array(F.collect_list(F.struct("rt", "scan")))
    return scans.groupBy("raw_id").agg(points.alias("axis")).select(
        "raw_id",
        F.transform("axis", lambda p: p["scan"]).alias("scans"),
        F.transform("axis", lambda p: p["rt"]).alias("rts"),
    )


def max_eic_points(targets: DataFrame, run: Ms1Run, ppm: float) -> DataFrame:
    """(raw_id, mz, scan, it): largest intensity in band for scans that have one."""
    width = mz_bin_width(ppm, "ppm")
    lo, hi = mz_bounds(F.col("mz"), ppm, "ppm")
    bands = (
        targets.select("raw_id", "mz")
        .where(F.col("mz").isNotNull())
        .distinct()
        .withColumn("lo", lo)
        .withColumn("hi", hi)
        .withColumn("bin", F.explode(bins(F.col("lo"), F.col("hi"), width)))
        .alias("t")
    )
    p = run.peaks.withColumn("bin", F.floor(F.col("mz") / width)).alias("p")
    on = (
        (F.col("t.raw_id") == F.col("p.raw_id"))
        & (F.col("t.bin") == F.col("p.bin"))
        & F.col("p.mz").between(F.col("t.lo"), F.col("t.hi"))
    )
    return (
        p.join(bands, on)
        .groupBy(F.col("t.raw_id").alias("raw_id"), F.col("t.mz").alias("mz"), F.col("p.scan").alias("scan"))
        .agg(F.max("p.it").alias("it"))
        # Stored traces are 32-bit in the raw formats' own precision.
        .withColumn("it", F.col("it").cast("float").cast("double"))
    )


def traces(targets: DataFrame, run: Ms1Run, ppm: float = 3.0) -> DataFrame:
    """Distinct (raw_id, mz) with dense ``y`` over every scan and the run's ``rts``.

    Points travel sparse; zero runs are filled in per row from the gaps between scans.
    """
    wanted = targets.select("raw_id", "mz").where(F.col("mz").isNotNull()).distinct()
    sparse = (
        max_eic_points(targets, run, ppm)
        .groupBy("raw_id", "mz")
        .agg(F.sort_array(F.collect_list(F.struct("scan", "it"))).alias("pts"))
    )
    rows = wanted.join(sparse, ["raw_id", "mz"], "left").join(run.axes, "raw_id", "left")
    rows = rows.repartition(work_partitions(rows.sparkSession), "raw_id", "mz")
    return rows.select("raw_id", "mz", "rts", densify(F.col("pts"), F.col("scans")).alias("y"))


def densify(points: Column, scans: Column) -> Column:
    """Dense intensities over ``scans`` from sorted sparse (scan, it) points."""
    def filled(pts):
        first, n = F.get(scans, F.lit(0)), F.size(scans)
        unbroken = F.get(scans, n - 1) - first == n - 1

        def at(i):
            scan = F.get(pts, i)["scan"]
            return F.when(unbroken, scan - first).otherwise(
                (F.array_position(scans, scan) - 1).cast("int")
            )

        def piece(p, i):
            here = at(i)
            before = F.when(i == 0, here).otherwise(here - at(i - 1) - 1)
            return F.concat(F.array_repeat(F.lit(0.0), before), F.array(p["it"]))

        tail = F.size(scans) - 1 - at(F.size(pts) - 1)
        return F.concat(
            F.flatten(F.transform(pts, piece)), F.array_repeat(F.lit(0.0), tail)
        )

    zeros = F.array_repeat(F.lit(0.0), F.coalesce(F.size(scans), F.lit(0)))
    return F.when(F.size(F.coalesce(points, F.array())) > 0, let(points, filled)).otherwise(zeros)


def _eligible(c: PeakPickSettings) -> Column:
    y = F.col("y")
    ok = (F.size(y) >= c.min_scan_points) & (F.size(y) == F.size("rts"))
    return F.coalesce(ok & tr.above_floor(F.array_max(y), c.min_height), F.lit(False))


def smoothed(y: Column, window: int, polyorder: int) -> Column:
    return F.struct(tr.savgol(y, window, polyorder).alias("smooth"), tr.median(y).alias("baseline"))


def refined_peaks(traced: DataFrame, c: PeakPickSettings) -> DataFrame:
    """Add ``smooth``, ``baseline``, ``eligible`` and every refined candidate.

    Columns ``s`` of both and ``measured`` of all maxima, where there are any, are taken as they are:
    many settings share a smoothing.
    """
    base = traced.withColumn("eligible", _eligible(c))
    empty = F.array().cast("array<double>")
    ready = F.when(
        F.col("eligible"),
        F.col("s") if "s" in traced.columns else smoothed(F.col("y"), c.sg_window, c.sg_polyorder),
    ).otherwise(F.struct(empty.alias("smooth"), F.lit(0.0).alias("baseline")))
    base = base.withColumn("s", ready)
    smooth, level = F.col("s.smooth"), F.col("s.baseline")
    if c.adaptive:
        if "measured" in traced.columns:
            # Measured for all settings of one smoothing: a floor only takes maxima away.
            high = F.filter("measured", lambda m: tr.above_floor(F.get(smooth, m["idx"]), c.min_height))
            base = base.withColumn("measured", F.when(F.col("eligible"), high).otherwise(F.slice("measured", 1, 0)))
        else:
            base = base.withColumn("measured", tr.measured_maxima(smooth, level, c.min_height))
        accepted = tr.adaptive_candidates(
            F.col("s.smooth"), F.col("rts"), level, F.col("measured"), c
        )
        refined = tr.refine_in_basins(F.col("y"), smooth, accepted, c.refine_radius_scans)
        return base.withColumn("refined", refined).drop("measured")

    def legacy(v):
        maxima = tr.local_maxima(v, c.min_height)
        accepted = tr.suppress_by_distance(v, maxima, c.min_distance_scans)
        return let(accepted, lambda a: tr.refine_apices(F.col("y"), a, c.refine_radius_scans))

    return base.withColumn("refined", tr.plain_refined(let(smooth, legacy)))


def pick_peaks(traced: DataFrame, c: PeakPickSettings = PeakPickSettings()) -> DataFrame:
    """Peak calls of dense traces: statuses, reasons, ``peaks`` array and pair quality."""
    refined = refined_peaks(traced, c)
    raw, rts, level = F.col("y"), F.col("rts"), F.col("s.baseline")

    def call(r):
        kept = tr.keep_top(raw, r, c)
        return let(
            tr.measure_peaks(rts, raw, kept, level),
            lambda p: let(
                F.struct(p.alias("peaks"), tr.pair_quality(raw, p).alias("quality")),
                lambda q: F.struct(
                    q["peaks"].alias("peaks"),
                    q["quality"].alias("quality"),
                    tr.pick_result(
                        raw, F.size(r), q["peaks"], q["quality"], level, F.col("eligible"), c
                    ).alias("verdict"),
                ),
            ),
        )

    called = refined.withColumn("call", let(F.col("refined"), call))
    keep = [n for n in traced.columns if n not in ("s", "measured")]
    return called.select(
        *keep,
        "eligible",
        F.col("call.verdict.signal_status").alias("signal_status"),
        F.col("call.verdict.chromatographic_status").alias("chromatographic_status"),
        F.col("call.verdict.review_reasons").alias("review_reasons"),
        F.when(F.col("eligible"), F.col("call.peaks")).otherwise(F.slice("call.peaks", 1, 0)).alias("peaks"),
        F.col("call.quality.resolution").alias("resolution"),
        F.col("call.quality.valley_ratio").alias("valley_ratio"),
        F.col("call.quality.height_ratio").alias("height_ratio"),
        F.col("call.quality.separation_sec").alias("separation_sec"),
        F.array_max("y").alias("max_intensity"),
        F.size("refined").alias("n_candidates"),
    )


def enumerate_candidates(traced: DataFrame, c: PeakPickSettings) -> DataFrame:
    """Every refined candidate before top-k: (raw_id, mz, candidates array)."""
    refined = refined_peaks(traced, c)
    rows = F.transform(
        F.sort_array("refined"),
        lambda r: F.struct(
            r["apex"].alias("scan"),
            F.get(F.col("rts"), r["apex"]).alias("rt"),
            F.get(F.col("y"), r["apex"]).alias("it"),
            r["prominence"].alias("prominence"),
            r["ratio"].alias("prominence_ratio"),
            r["support"].alias("support_scans"),
        ),
    )
    return refined.select(*traced.columns, rows.alias("candidates"))


def auto_columns(call: str = "call") -> dict[str, Column]:
    """The automatic MS1 columns from a struct column of ``pick_peaks`` output."""
    def f(name):
        return F.col(f"{call}.{name}")

    def peak(i, name):
        return F.try_element_at(f("peaks"), F.lit(i))[name]

    a1 = F.coalesce(peak(1, "area"), F.lit(0.0))
    total = a1 + F.coalesce(peak(2, "area"), F.lit(0.0))
    reasons = F.coalesce(f("review_reasons"), F.array().cast("array<string>"))
    out = {
        "auto_signal_status": F.coalesce(f("signal_status"), F.lit("no_signal")),
        "auto_chromatographic_status": F.coalesce(f("chromatographic_status"), F.lit("not_evaluable")),
        "auto_peak1_rt_min": peak(1, "rt") / 60,
        "auto_peak2_rt_min": peak(2, "rt") / 60,
    }
    for label, name in (
        ("intensity", "it"),
        ("width_sec", "width"),
        ("area_fwhm", "area"),
        ("snr", "snr"),
        ("prominence", "prominence"),
        ("prominence_ratio", "prominence_ratio"),
    ):
        for i in (1, 2):
            out[f"auto_peak{i}_{label}"] = peak(i, name)
    out["auto_peak1_area_fraction"] = F.when(
        (F.size(f("peaks")) > 0) & (total > 0), a1 / total
    )
    out["auto_peak_resolution"] = f("resolution")
    out["auto_peak_separation_sec"] = f("separation_sec")
    out["auto_valley_ratio"] = f("valley_ratio")
    out["auto_max_intensity"] = f("max_intensity")
    out["auto_manual_review_required"] = F.size(reasons) > 0
    out["auto_review_reasons"] = F.concat_ws(";", reasons)
    return out


CALL_FIELDS = (
    "signal_status",
    "chromatographic_status",
    "review_reasons",
    "peaks",
    "resolution",
    "valley_ratio",
    "height_ratio",
    "separation_sec",
    "max_intensity",
    "n_candidates",
)


def annotate_targets(
    targets: DataFrame, run: Ms1Run, c: PeakPickSettings = PeakPickSettings()
) -> DataFrame:
    """Target rows plus automatic MS1 columns; each distinct (raw, m/z) is picked once.

    The calls are cut off before use: a filter on an automatic column would otherwise be
    pushed down with a copy of the whole picking expression.
    """
    calls = durable(
        pick_peaks(traces(targets, run, c.eic_ppm), c).select(
            "raw_id", "mz", F.struct(*CALL_FIELDS).alias("call")
        )
    )
    joined = targets.join(calls, ["raw_id", "mz"], "left")
    return joined.select(*targets.columns, *[v.alias(k) for k, v in auto_columns().items()])
