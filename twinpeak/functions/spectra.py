"""Fragment-spectrum algebra on ``array<struct<mz:double,it:double>>`` columns.

All of it is per-row higher-order-function work: no shuffle and no Python.
Spectra are filtered fragment lists (tens of peaks), never raw scans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, number

SPECTRUM_TYPE = "array<struct<mz:double,it:double>>"
MATCH_TYPE = "array<struct<i:int,j:int>>"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _usable(peaks: Column) -> Column:
    inf = float("inf")
    return F.filter(
        peaks,
        lambda p: (p["mz"] > 0) & (p["it"] > 0) & (p["mz"] < inf) & (p["it"] < inf)
        & ~F.isnan(p["mz"]) & ~F.isnan(p["it"]),
    )


def parse_fragments(text: Column) -> Column:
    """``mz,intensity;…`` text to a sorted spectrum, silently dropping bad tokens."""
    tokens = F.split(F.coalesce(text, F.lit("")), ";")
    fields = F.filter(F.transform(tokens, lambda t: F.split(t, ",")), lambda f: F.size(f) == 2)
    peaks = F.transform(
        fields, lambda f: F.struct(number(f[0]).alias("mz"), number(f[1]).alias("it"))
    )
    return F.sort_array(_usable(peaks))


def prepare(peaks: Column, min_relative: float) -> Column:
    """Clean, sort by m/z and keep peaks at or above a share of the base peak."""
    def keep(clean):
        cutoff = F.array_max(F.transform(clean, lambda p: p["it"])) * float(min_relative)
        return let(cutoff, lambda c: F.filter(clean, lambda p: p["it"] >= c))

    return let(F.sort_array(_usable(peaks)), keep)


CANDIDATE_TYPE = "array<struct<err:double,neg:double,i:int,j:int>>"
_TAGGED_TYPE = "array<struct<mz:double,it:double,k:int,side:int>>"


def setting(value) -> Column:
    """A setting: a number, or a column when one plan runs many settings."""
    return value if isinstance(value, Column) else F.lit(float(value))


def candidate_matches(a: Column, b: Column, tol: float, unit: str) -> Column:
    """All in-tolerance peak pairs, ordered by the greedy rule.

    Error first, larger intensity product second, then position, so ties are total.
    One pass over both spectra merged by m/z keeps only the peaks still within reach of
    the current one, so the cost follows the number of near pairs, not n * m.
    """
    def tagged(peaks, side):
        return F.transform(
            peaks,
            lambda p, k: F.struct(
                p["mz"].alias("mz"), p["it"].alias("it"), k.alias("k"), F.lit(side).alias("side")
            ),
        )

    def within(x, y):
        allowed = setting(tol) if unit == "Da" else (x["mz"] + y["mz"]) / 2 * setting(tol) / 1e6
        return F.abs(x["mz"] - y["mz"]) <= allowed

    def pair(x, y):
        from_a = x["side"] == 0
        return F.struct(
            F.abs(x["mz"] - y["mz"]).alias("err"),
            (-(x["it"] * y["it"])).alias("neg"),
            F.when(from_a, x["k"]).otherwise(y["k"]).alias("i"),
            F.when(from_a, y["k"]).otherwise(x["k"]).alias("j"),
        )

    def step(acc, x):
        def extend(near):
            other = F.filter(near, lambda y: y["side"] != x["side"])
            return F.struct(
                F.array_append(near, x).alias("near"),
                F.concat(acc["out"], F.transform(other, lambda y: pair(x, y))).alias("out"),
            )

        return let(F.filter(acc["near"], lambda y: within(x, y)), extend)

    start = F.struct(
        F.array().cast(_TAGGED_TYPE).alias("near"), F.array().cast(CANDIDATE_TYPE).alias("out")
    )
    merged = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    return F.sort_array(F.aggregate(merged, start, step, lambda acc: acc["out"]))


def exclusive_matches(a: Column, b: Column, tol: float, unit: str) -> Column:
    """Greedy one-to-one matches as ``array<struct<i,j>>`` in acceptance order."""
    ints = "array<int>"
    start = F.struct(F.array().cast(ints).alias("i"), F.array().cast(ints).alias("j"))

    def accept(acc, c):
        clash = F.array_contains(acc["i"], c["i"]) | F.array_contains(acc["j"], c["j"])
        grown = F.struct(
            F.array_append(acc["i"], c["i"]).alias("i"), F.array_append(acc["j"], c["j"]).alias("j")
        )
        return F.when(clash, acc).otherwise(grown)

    return F.aggregate(
        candidate_matches(a, b, tol, unit),
        start,
        accept,
        lambda acc: F.zip_with(
            acc["i"], acc["j"], lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        ),
    )


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def shannon(probabilities: Column) -> Column:
    return -total(F.transform(probabilities, _plogp))


def entropy_weights(intensities: Column) -> Column:
    """Normalised intensities; low-entropy spectra are flattened by their own entropy."""
    def normalise(values):
        return let(total(values), lambda t: F.transform(values, lambda v: v / t))

    def flatten(p):
        def powered(h):
            return normalise(F.transform(p, lambda v: F.pow(v, 0.25 * (1 + h))))

        return let(shannon(p), lambda h: F.when(h < 3, powered(h)).otherwise(p))

    return let(normalise(intensities), flatten)


def entropy_similarity(wa: Column, wb: Column, matches: Column) -> Column:
    """1 minus the scaled divergence of two weighted spectra on one alignment.

    The mixture entropy is the all-unmatched value corrected once per match.
    """
    def correction(m):
        pa, pb = F.get(wa, m["i"]), F.get(wb, m["j"])
        return _plogp((pa + pb) / 2) - _plogp(pa / 2) - _plogp(pb / 2)

    unmatched = total(F.transform(F.concat(wa, wb), lambda p: _plogp(p / 2)))
    mixture = -(unmatched + total(F.transform(matches, correction)))
    divergence = 2 * mixture - shannon(wa) - shannon(wb)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - divergence / math.log(4)))


def _metrics(a: Column, b: Column, matches: Column, power: float) -> Column:
    ia = F.transform(a, lambda p: p["it"])
    ib = F.transform(b, lambda p: p["it"])

    def weight(c):
        return F.pow(c, float(power))

    def norm(values):
        return F.sqrt(total(F.transform(values, lambda v: weight(v) * weight(v))))

    def build(s):
        va, vb, m = s["va"], s["vb"], s["m"]
        dot = total(
            F.transform(m, lambda k: weight(F.get(va, k["i"])) * weight(F.get(vb, k["j"])))
        )
        cosine = dot / (norm(va) * norm(vb))
        entropy = let(
            F.struct(entropy_weights(va).alias("wa"), entropy_weights(vb).alias("wb")),
            lambda w: entropy_similarity(w["wa"], w["wb"], m),
        )
        filled = (F.size(va) > 0) & (F.size(vb) > 0)
        return F.struct(
            F.when(filled, F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))).alias("cosine"),
            F.size(m).alias("matched"),
            F.size(va).alias("count_a"),
            F.size(vb).alias("count_b"),
            F.when(
                filled, total(F.transform(m, lambda k: F.get(va, k["i"]))) / total(va)
            ).alias("explained_a"),
            F.when(
                filled, total(F.transform(m, lambda k: F.get(vb, k["j"]))) / total(vb)
            ).alias("explained_b"),
            F.when(filled, entropy).alias("entropy"),
            m.alias("matches"),
            s["a"].alias("peaks_a"),
            s["b"].alias("peaks_b"),
        )

    return let(
        F.struct(
            ia.alias("va"), ib.alias("vb"), matches.alias("m"), a.alias("a"), b.alias("b")
        ),
        build,
    )


def similarity(
    spectrum_a: Column,
    spectrum_b: Column,
    tol: float = 0.01,
    unit: str = "Da",
    min_relative: float = 0.01,
    power: float = 0.5,
) -> Column:
    """Full comparison of two spectra as one struct.

    Empty input gives NULL scores (not evaluable), never a low score.
    """
    if unit not in ("Da", "ppm"):
        raise ValueError("fragment tolerance unit must be 'Da' or 'ppm'")
    if not isinstance(tol, Column) and not (tol >= 0 and math.isfinite(tol)):
        raise ValueError("fragment tolerance must be finite and non-negative")
    if not 0 <= min_relative <= 1:
        raise ValueError("min_relative must be between 0 and 1")
    if not (power > 0 and math.isfinite(power)):
        raise ValueError("intensity power must be finite and positive")
    none = F.array().cast(SPECTRUM_TYPE)
    ready = F.struct(
        prepare(F.coalesce(spectrum_a, none), min_relative).alias("a"),
        prepare(F.coalesce(spectrum_b, none), min_relative).alias("b"),
    )
    return let(
        ready,
        lambda s: _metrics(s["a"], s["b"], exclusive_matches(s["a"], s["b"], tol, unit), power),
    )


def similarity_features(sim: Column) -> dict[str, Column]:
    """The six ordered model features; all NULL when the pair is not evaluable."""
    larger = F.greatest(sim["count_a"], sim["count_b"])
    smaller = F.least(sim["count_a"], sim["count_b"])
    ok = sim["cosine"].isNotNull()
    values = {
        "cosine": sim["cosine"],
        "entropy_similarity": sim["entropy"],
        "log1p_matched_peaks": F.log1p(sim["matched"].cast("double")),
        "min_explained_intensity": F.least(sim["explained_a"], sim["explained_b"]),
        "explained_intensity_asymmetry": F.abs(sim["explained_a"] - sim["explained_b"]),
        "fragment_count_balance": smaller / larger,
    }
    return {name: F.when(ok, value) for name, value in values.items()}


def merge_centroids(peaks: Column, tol: float, unit: str) -> Column:
    """Intensity-weighted centroid clusters of one candidate peak list, ascending.

    A peak joins the open cluster while it lies in the tolerance band around the
    cluster's current weighted centre.
    """
    from .scalars import mz_bounds

    start = F.struct(
        F.array().cast("array<double>").alias("done"),
        F.lit(0.0).alias("w"),
        F.lit(0.0).alias("m"),
    )

    def step(acc, p):
        centre = acc["m"] / acc["w"]
        lo, hi = mz_bounds(centre, tol, unit)
        joins = (acc["w"] == 0) | ((p["mz"] >= lo) & (p["mz"] <= hi))
        grown = F.struct(
            acc["done"].alias("done"),
            (acc["w"] + p["it"]).alias("w"),
            (acc["m"] + p["mz"] * p["it"]).alias("m"),
        )
        fresh = F.struct(
            F.array_append(acc["done"], centre).alias("done"),
            p["it"].alias("w"),
            (p["mz"] * p["it"]).alias("m"),
        )
        return F.when(joins, grown).otherwise(fresh)

    def close(acc):
        return F.when(acc["w"] > 0, F.array_append(acc["done"], acc["m"] / acc["w"])).otherwise(
            acc["done"]
        )

    return F.aggregate(F.sort_array(peaks), start, step, close)
