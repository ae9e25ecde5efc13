"""MS1 trace analysis on dense intensity arrays (one row per target trace).

A trace has one value per scan of its run, so its length is fixed by the acquisition.
Everything is array expressions; the stack of contour prominence is a fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import PeakPickSettings
from .scalars import let, resolution_fwhm, resolution_passes
from .spectra import total

PROMINENCE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("idx", T.IntegerType()),
            T.StructField("prominence", T.DoubleType()),
            T.StructField("ratio", T.DoubleType()),
            T.StructField("support", T.IntegerType()),
        ]
    )
)


def savgol_weights(window: int, polyorder: int) -> list[float]:
    """Least-squares weights of the window centre for a polynomial fit."""
    offsets = np.arange(window) - window // 2
    design = np.vander(offsets.astype(float), polyorder + 1, increasing=True)
    return [float(w) for w in np.linalg.pinv(design)[0]]


def _smooth_with(y: Column, window: int, polyorder: int) -> Column:
    radius = window // 2
    weights = savgol_weights(window, min(polyorder, window - 1))

    def at(v, i):
        value = F.lit(0.0)
        for k, w in enumerate(weights):
            value = value + F.lit(w) * F.get(y, i + (k - radius))
        return F.when((i >= radius) & (i < F.size(y) - radius), value).otherwise(v)

    return F.transform(y, at)


def savgol(y: Column, window: int, polyorder: int) -> Column:
    """Smoothed trace; edges keep raw values and short traces use a smaller odd window."""
    out = F.when(F.size(y) >= window, _smooth_with(y, window, polyorder))
    for smaller in range(window - 2, 2, -2):
        out = out.when(F.size(y) >= smaller, _smooth_with(y, smaller, polyorder))
    return out.otherwise(y)


def median(values: Column) -> Column:
    def middle(s):
        n = F.size(s)
        lower = F.get(s, F.floor((n - 1) / 2).cast("int"))
        upper = F.get(s, F.floor(n / 2).cast("int"))
        return (lower + upper) / 2

    return let(F.sort_array(values), middle)


def quantile(values: Column, p: float) -> Column:
    """Linearly interpolated order statistic; an empty array gives 0."""
    def interpolate(s):
        position = (F.size(s) - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        a, b = F.get(s, low.cast("int")), F.get(s, high.cast("int"))
        fraction = position - low
        return F.when(low == high, a).otherwise(a * (1 - fraction) + b * fraction)

    return F.when(F.size(values) > 0, let(F.sort_array(values), interpolate)).otherwise(F.lit(0.0))


def mad(values: Column, centre: Column) -> Column:
    return median(F.transform(values, lambda v: F.abs(v - centre)))


def _number(value) -> Column:
    """A setting: a number, or a column when one job runs many settings."""
    return value if isinstance(value, Column) else F.lit(value)


def above_floor(value: Column, floor) -> Column:
    """No floor (None, or NULL in a column) lets everything pass."""
    return F.lit(True) if floor is None else F.coalesce(value >= _number(floor), F.lit(True))


def _interior(y: Column) -> Column:
    return F.when(F.size(y) >= 3, F.sequence(F.lit(1), F.size(y) - 2)).otherwise(
        F.array().cast("array<int>")
    )


def local_maxima(y: Column, min_height) -> Column:
    """Interior indices rising from the left and not exceeded on the right."""
    def rising(i):
        v = F.get(y, i)
        peak = (v > F.get(y, i - 1)) & (v >= F.get(y, i + 1))
        return peak & above_floor(v, min_height)

    return F.filter(_interior(y), rising)


def suppress_by_distance(y: Column, candidates: Column, min_distance) -> Column:
    """Keep higher peaks first (earlier on ties) at least ``min_distance`` scans apart."""
    ranked = F.sort_array(
        F.transform(candidates, lambda i: F.struct((-F.get(y, i)).alias("h"), i.alias("i")))
    )
    kept = F.aggregate(
        ranked,
        F.array().cast("array<int>"),
        lambda acc, c: F.when(
            F.forall(acc, lambda o: F.abs(o - c["i"]) >= _number(min_distance)), F.array_append(acc, c["i"])
        ).otherwise(acc),
    )
    return F.sort_array(kept)


def argmax_between(y: Column, first: Column, last: Column) -> Column:
    """Index of the first maximum in [first, last]."""
    part = F.slice(y, first + 1, last - first + 1)
    return let(part, lambda s: (first + F.array_position(s, F.array_max(s)) - 1).cast("int"))


def argmin_between(y: Column, first: Column, last: Column) -> Column:
    part = F.slice(y, first + 1, last - first + 1)
    return let(part, lambda s: (first + F.array_position(s, F.array_min(s)) - 1).cast("int"))


def refine_apices(raw: Column, candidates: Column, radius: int) -> Column:
    """Raw apex within ``radius`` scans of each candidate, repeats dropped."""
    return F.array_distinct(
        F.transform(
            candidates,
            lambda c: argmax_between(
                raw,
                F.greatest(c - radius, F.lit(0)),
                F.least(c + radius, F.size(raw) - 1),
            ),
        )
    )


def _crests(y: Column) -> Column:
    """Indices that rise from the left (or begin the trace) and are not exceeded on the right.

    Whatever is higher than a value and nearest to it on one side, walking on uphill from there meets
    one of these before the trace falls, so only they need to be on a stack.
    """
    def crest(i):
        v = F.get(y, i)
        return ((i == 0) | (v > F.get(y, i - 1))) & ((i == F.size(y) - 1) | (v >= F.get(y, i + 1)))

    places = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, crest)


_STACK = "array<struct<h:double,low:double,far:int>>"


def _reaches(crests: Column) -> Column:
    """For each (h, low, far) in walking order: the least value and the last index before something higher.

    A monotonic stack as a fold: its heights fall from bottom to top, so the entries that a crest
    overtops are the ones not above it, and their least value and reach become the crest's.
    """
    def step(acc, c):
        def push(under):
            item = F.struct(
                c["h"].alias("h"),
                F.coalesce(F.least(c["low"], F.array_min(F.transform(under, lambda u: u["low"]))), c["low"]).alias("low"),
                F.when(F.size(under) > 0, F.get(under, F.lit(0))["far"]).otherwise(c["far"]).alias("far"),
            )
            above = F.filter(acc["stack"], lambda u: u["h"] > c["h"])
            return let(item, lambda i: F.struct(F.array_append(above, i).alias("stack"), F.array_append(acc["out"], i).alias("out")))

        return let(F.filter(acc["stack"], lambda u: u["h"] <= c["h"]), push)

    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_STACK).alias("out"))
    return F.aggregate(crests, start, step, lambda acc: acc["out"])


def measured_maxima(y: Column, baseline: Column, min_height) -> Column:
    """Prominence, ratio and half-prominence support of each local maximum, in scan order."""
    def walked(v, ids):
        """Crests with the least value since the one before, and the first index after that one."""
        def entry(i, k):
            before = F.coalesce(F.get(ids, k - 1), F.lit(-1))
            return F.struct(F.get(v, i).alias("h"), F.array_min(F.slice(v, before + 2, i - before)).alias("low"), (before + 1).alias("far"))

        return F.transform(ids, entry)

    def measured(v, ids, left, right):
        n = F.size(v)

        def one(i, k):
            # The walk from the right ran over the mirrored trace.
            from_left, from_right = F.get(left, k), F.get(right, F.size(ids) - 1 - k)
            height = F.get(v, i)
            prominence = F.greatest(F.lit(0.0), height - F.greatest(baseline, from_left["low"], from_right["low"]))

            def parts(p):
                above = height - baseline
                ratio = F.when(above > 0, F.least(F.lit(1.0), p / above)).otherwise(F.lit(0.0))
                # Both sides fall below half the prominence before something higher comes.
                floor = height - p / 2
                first, last = from_left["far"], n - 1 - from_right["far"]
                down = F.reverse(F.slice(v, first + 1, i - first))
                up = F.slice(v, i + 2, last - i)

                def reach(side, most):
                    found = F.array_position(F.transform(side, lambda x: x < floor), F.lit(True))
                    return let(found, lambda r: F.when(r > 0, r - 1).otherwise(most))

                support = F.when(p > 0, reach(down, i - first) + reach(up, last - i) + 1).otherwise(F.lit(0)).cast("int")
                return F.struct(i.alias("idx"), p.alias("prominence"), ratio.alias("ratio"), support.alias("support"))

            return let(prominence, parts)

        return F.transform(ids, one)

    def is_peak(v):
        def test(m):
            i = m["idx"]
            return (i > 0) & (i < F.size(v) - 1) & above_floor(F.get(v, i), min_height)

        return test

    def over(v):
        def with_ids(ids):
            def mirrored(r):
                back = F.transform(F.reverse(ids), lambda i: F.size(v) - 1 - i)
                left, right = _reaches(walked(v, ids)), _reaches(walked(r, back))
                return let(F.struct(left.alias("l"), right.alias("r")), lambda w: measured(v, ids, w["l"], w["r"]))

            return let(F.reverse(v), mirrored)

        return F.filter(let(_crests(v), with_ids), is_peak(v))

    return let(y, over)


def adaptive_candidates(
    smooth: Column, rts: Column, baseline: Column, measured: Column, c: PeakPickSettings
) -> Column:
    """Gate measured maxima, then accept in rank order with the valley exception."""
    def passes(m):
        ok = F.lit(True)
        if c.min_prominence_ratio is not None:
            ok = ok & (m["ratio"] >= _number(c.min_prominence_ratio))
        if c.min_support_scans is not None:
            ok = ok & (m["support"] >= _number(c.min_support_scans))
        return ok

    def rank(m):
        return m["prominence"] if c.rank_by_prominence else F.get(smooth, m["idx"])

    ranked = F.sort_array(
        F.transform(
            F.filter(measured, passes),
            lambda m: F.struct(
                (-rank(m)).alias("r"),
                m["idx"].alias("idx"),
                m["prominence"].alias("prominence"),
                m["ratio"].alias("ratio"),
                m["support"].alias("support"),
            ),
        )
    )

    def too_close(a, b):
        if c.min_distance_sec is not None:
            return F.abs(F.get(rts, a) - F.get(rts, b)) < _number(c.min_distance_sec)
        return F.abs(a - b) < _number(c.min_distance_scans)

    def valley_ratio(a, b):
        left, right = F.least(a, b), F.greatest(a, b)
        valley = F.array_min(F.slice(smooth, left + 1, right - left + 1))
        lower = F.least(F.get(smooth, a), F.get(smooth, b)) - baseline
        return F.when(lower > 0, F.greatest(F.lit(0.0), valley - baseline) / lower).otherwise(
            F.lit(float("inf"))
        )

    def accept(acc, m):
        if c.close_peak_max_valley_ratio is None:
            clash = F.exists(acc, lambda o: too_close(m["idx"], o["idx"]))
        else:
            limit = _number(c.close_peak_max_valley_ratio)
            clash = F.exists(
                acc,
                lambda o: too_close(m["idx"], o["idx"])
                & (valley_ratio(m["idx"], o["idx"]) > limit),
            )
        item = F.struct(
            m["idx"].alias("idx"),
            m["prominence"].alias("prominence"),
            m["ratio"].alias("ratio"),
            m["support"].alias("support"),
        )
        return F.when(clash, acc).otherwise(F.array_append(acc, item))

    return F.sort_array(F.aggregate(ranked, F.array().cast(PROMINENCE_TYPE), accept))


def refine_in_basins(raw: Column, smooth: Column, candidates: Column, radius: int) -> Column:
    """Raw apex per accepted candidate, never crossing the smoothed valley to a neighbour."""
    def build(cand):
        ids = F.transform(cand, lambda m: m["idx"])

        def valley(k):
            return argmin_between(smooth, F.get(ids, k) + 1, F.get(ids, k + 1) - 1)

        def one(m, k):
            first = F.greatest(m["idx"] - radius, F.lit(0))
            last = F.least(m["idx"] + radius, F.size(raw) - 1)
            first = F.when(k > 0, F.greatest(first, valley(k - 1) + 1)).otherwise(first)
            last = F.when(k < F.size(ids) - 1, F.least(last, valley(k))).otherwise(last)
            apex = F.when(first > last, m["idx"]).otherwise(argmax_between(raw, first, last))
            return F.struct(
                apex.alias("apex"),
                m["idx"].alias("idx"),
                m["prominence"].alias("prominence"),
                m["ratio"].alias("ratio"),
                m["support"].alias("support"),
            )

        return F.transform(cand, one)

    return let(candidates, build)


def plain_refined(apices: Column) -> Column:
    none = F.lit(None)
    return F.transform(
        apices,
        lambda a: F.struct(
            a.alias("apex"),
            a.alias("idx"),
            none.cast("double").alias("prominence"),
            none.cast("double").alias("ratio"),
            none.cast("int").alias("support"),
        ),
    )


def keep_top(raw: Column, refined: Column, c: PeakPickSettings) -> Column:
    """The ``top_k`` strongest refined peaks, back in scan order."""
    by_prominence = c.adaptive and c.rank_by_prominence
    ranked = F.sort_array(
        F.transform(
            refined,
            lambda r, k: F.struct(
                (-(r["prominence"] if by_prominence else F.get(raw, r["apex"]))).alias("h"),
                k.alias("k"),
                r.alias("r"),
            ),
        )
    )
    return F.sort_array(F.transform(F.slice(ranked, 1, c.top_k), lambda x: x["r"]))


def half_height_bounds(y: Column, apex: Column, baseline: Column) -> Column:
    """Struct(left, right): first scans below half height, or the trace ends.

    NULL when the walk cannot move on both sides.
    """
    half = baseline + (F.get(y, apex) - baseline) / 2
    positions = F.sequence(F.lit(0), F.size(y) - 1)

    def found(h):
        below = F.filter(positions, lambda j: F.get(y, j) < h)
        left = F.array_max(F.filter(below, lambda j: j < apex))
        right = F.array_min(F.filter(below, lambda j: j > apex))
        bounds = F.struct(
            F.coalesce(left, F.lit(0)).alias("left"),
            F.coalesce(right, F.size(y) - 1).alias("right"),
        )
        moved = (F.get(y, apex) >= h) & (apex > 0) & (apex < F.size(y) - 1)
        return F.when(moved, bounds)

    return let(half, found)


def area_above(rts: Column, y: Column, bounds: Column, baseline: Column) -> Column:
    """Baseline-corrected trapezoid between two scans."""
    def level(j):
        return F.greatest(F.lit(0.0), F.get(y, j) - baseline)

    steps = F.sequence(bounds["left"], bounds["right"] - 1)
    return total(
        F.transform(
            steps,
            lambda j: (F.get(rts, j + 1) - F.get(rts, j)) * (level(j) + level(j + 1)) / 2,
        )
    )


def measure_peaks(rts: Column, raw: Column, kept: Column, baseline: Column) -> Column:
    """RT, height, FWHM, area, SNR and prominence of each kept peak."""
    def measured(noise):
        def one(r):
            def with_bounds(b):
                return F.struct(
                    r["apex"].alias("scan"),
                    F.get(rts, r["apex"]).alias("rt"),
                    F.get(raw, r["apex"]).alias("it"),
                    F.when(
                        b.isNotNull(), F.get(rts, b["right"]) - F.get(rts, b["left"])
                    ).alias("width"),
                    F.when(b.isNotNull(), area_above(rts, raw, b, baseline)).alias("area"),
                    F.when(
                        noise != 0,
                        F.greatest(F.lit(0.0), (F.get(raw, r["apex"]) - baseline) / noise),
                    ).alias("snr"),
                    r["prominence"].alias("prominence"),
                    r["ratio"].alias("prominence_ratio"),
                )

            return let(half_height_bounds(raw, r["apex"], baseline), with_bounds)

        return F.transform(kept, one)

    return let(mad(raw, baseline) * 1.4826, measured)


def pair_quality(raw: Column, peaks: Column) -> Column:
    """Struct(resolution, valley_ratio, height_ratio, separation) of the first two peaks."""
    a, b = F.get(peaks, F.lit(0)), F.get(peaks, F.lit(1))
    low, high = F.least(a["it"], b["it"]), F.greatest(a["it"], b["it"])
    valley = F.array_min(F.slice(raw, a["scan"] + 1, b["scan"] - a["scan"] + 1))
    return F.when(
        F.size(peaks) >= 2,
        F.struct(
            resolution_fwhm(a["rt"], b["rt"], a["width"], b["width"]).alias("resolution"),
            F.try_divide(valley, low).alias("valley_ratio"),
            F.try_divide(low, high).alias("height_ratio"),
            (b["rt"] - a["rt"]).alias("separation_sec"),
        ),
    )


def quality_gate(quality: Column, c: PeakPickSettings) -> Column:
    valley_ok = (
        F.lit(True)
        if c.max_valley_ratio is None
        else F.coalesce(quality["valley_ratio"] <= float(c.max_valley_ratio), F.lit(False))
    )
    return (
        valley_ok
        & resolution_passes(quality["resolution"], c.min_resolution)
        & F.coalesce(quality["height_ratio"] >= float(c.min_second_peak_ratio), F.lit(False))
    )


def pick_result(
    raw: Column, n_candidates: Column, peaks: Column, quality: Column, baseline: Column,
    eligible: Column, c: PeakPickSettings,
) -> Column:
    """Struct(signal_status, chromatographic_status, review_reasons)."""
    def verdict(signal, status, reasons):
        return F.struct(
            F.lit(signal).alias("signal_status"),
            (status if isinstance(status, Column) else F.lit(status)).alias("chromatographic_status"),
            reasons.alias("review_reasons"),
        )

    def listed(*rules):
        return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))

    none = F.array().cast("array<string>")
    no_floor = F.lit(True) if c.min_height is None else _number(c.min_height).isNull()
    a, b = F.get(peaks, F.lit(0)), F.get(peaks, F.lit(1))
    if c.min_distance_sec is not None:
        close = quality["separation_sec"] <= 2 * _number(c.min_distance_sec)
    else:
        close = F.abs(b["scan"] - a["scan"]) < _number(c.min_distance_scans)
    shallow = (
        F.lit(False)
        if c.max_valley_ratio is None
        else quality["valley_ratio"] > float(c.max_valley_ratio)
    )
    flat = F.lit(c.adaptive) & (F.array_max(raw) <= baseline)
    status = F.when((a["rt"] < b["rt"]) & quality_gate(quality, c), "double_peak").otherwise(
        "ambiguous"
    )
    return (
        F.when(~eligible, verdict("no_signal", "not_evaluable", none))
        .when((n_candidates == 0) & flat, verdict("no_signal", "not_evaluable", none))
        .when(
            n_candidates == 0,
            verdict(
                "detected",
                "ambiguous",
                listed(
                    (F.lit(True), "no_qualified_peak_candidate"),
                    (no_floor, "absolute_height_disabled"),
                ),
            ),
        )
        .when(
            F.size(peaks) < 2,
            verdict("detected", "single_peak", listed((no_floor, "absolute_height_disabled"))),
        )
        .otherwise(
            verdict(
                "detected",
                status,
                listed(
                    (no_floor, "absolute_height_disabled"),
                    (close, "close_peak_pair"),
                    (shallow, "shallow_valley"),
                    (
                        ~resolution_passes(quality["resolution"], c.min_resolution),
                        "resolution_below_threshold",
                    ),
                    (
                        quality["height_ratio"] < float(c.min_second_peak_ratio),
                        "weak_second_peak",
                    ),
                ),
            )
        )
    )


def background(
    rts: Column,
    intensities: Column,
    protected_min: Column,
    exclusion_sec: float = 20.0,
    height_floor: float = 200_000.0,
) -> Column:
    """Struct of background statistics away from protected RTs and the low-clean flag."""
    raw = F.transform(intensities, lambda v: F.greatest(F.lit(0.0), v))

    def outside(y):
        pts = F.zip_with(rts, y, lambda t, v: F.struct(t.alias("t"), v.alias("v")))
        away = F.filter(
            pts,
            lambda p: F.forall(protected_min, lambda m: F.abs(p["t"] - m * 60) > exclusion_sec),
        )
        values = F.transform(away, lambda p: p["v"])
        return F.when(F.size(values) > 0, values).otherwise(y)

    def stats(ctx):
        y, bg = ctx["y"], ctx["bg"]
        top = F.coalesce(F.array_max(y), F.lit(0.0))
        nonzero = F.size(F.filter(bg, lambda v: v > 0)) / F.greatest(F.size(bg), F.lit(1))

        def finish(s):
            support = half_height_support(y)
            low_clean = (
                (top > 0)
                & (top < height_floor)
                & (s["p99"] <= F.greatest(F.lit(1.0), top * 0.05))
                & (nonzero <= 0.15)
                & (support >= 3)
            )
            return F.struct(
                s["median"].alias("background_median"),
                mad(bg, s["median"]).alias("background_mad"),
                quantile(bg, 0.95).alias("background_p95"),
                s["p99"].alias("background_p99"),
                nonzero.alias("background_nonzero_fraction"),
                (top / F.greatest(s["p99"], F.lit(1.0))).alias("peak_to_background_p99"),
                support.alias("max_half_height_support_scans"),
                low_clean.alias("low_clean_candidate"),
            )

        return let(F.struct(median(bg).alias("median"), quantile(bg, 0.99).alias("p99")), finish)

    return let(
        raw, lambda y: let(F.struct(y.alias("y"), outside(y).alias("bg")), stats)
    )


def half_height_support(y: Column) -> Column:
    """Consecutive scans at or above half of the global maximum around its first apex."""
    def walk(ctx):
        apex, half = ctx["apex"], ctx["half"]
        positions = F.sequence(F.lit(0), F.size(y) - 1)
        below = F.filter(positions, lambda j: F.get(y, j) < half)
        left = F.coalesce(F.array_max(F.filter(below, lambda j: j < apex)) + 1, F.lit(0))
        right = F.coalesce(F.array_min(F.filter(below, lambda j: j > apex)) - 1, F.size(y) - 1)
        return right - left + 1

    context = F.struct(
        (F.array_position(y, F.array_max(y)) - 1).cast("int").alias("apex"),
        (F.array_max(y) / 2).alias("half"),
    )
    return F.when(F.array_max(y) > 0, let(context, walk)).otherwise(F.lit(0))


def envelope(y: Column, max_bins: int) -> Column:
    """Low and high point of each equal-width bin, in scan order, for drawing."""
    width = F.greatest(F.ceil(F.size(y) / max_bins).cast("int"), F.lit(1))

    def points(w):
        starts = F.sequence(F.lit(0), F.size(y) - 1, w)

        def pick(s):
            last = F.least(s + w - 1, F.size(y) - 1)
            return F.sort_array(
                F.array_distinct(F.array(argmin_between(y, s, last), argmax_between(y, s, last)))
            )

        return F.flatten(F.transform(starts, pick))

    return F.when(F.size(y) > 0, let(width, points)).otherwise(F.array().cast("array<int>"))
