"""Scalar Column expressions shared by every plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import check_tolerance

# Text accepted as a decimal number, before blanks and '_' are removed.
NUMBER_PATTERN = (
    r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
)
# Colour labels written by the source instrument software.
SOURCE_LABELS = {
    "GREEN": "expected_double_peak",
    "YELLOW": "expected_single_peak",
    "RED": "unusable_no_peak_or_multiple_peak",
    "CHECK": "manual_review_needed",
}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(c: Column) -> Column:
    """NULL out NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(c: Column) -> Column:
    """Lenient text to finite double; anything else is NULL."""
    text = F.regexp_replace(c, r"[\s_]", "")
    return F.when(c.rlike(NUMBER_PATTERN), finite(text.try_cast("double")))


def has_value(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def mz_delta(mz: Column, tol: float, unit: str) -> Column:
    check_tolerance(tol, unit)
    if unit == "Da":
        return F.lit(float(tol))
    if unit == "ppm":
        return mz * F.lit(float(tol)) / F.lit(1_000_000.0)
    return mz * F.lit(float(tol))


def mz_bounds(mz: Column, tol: float, unit: str) -> tuple[Column, Column]:
    """Closed tolerance band around ``mz``."""
    delta = mz_delta(mz, tol, unit)
    return mz - delta, mz + delta


def safe_divide(a: Column, b: Column) -> Column:
    """x / 0 is 0 for every reported rate."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_half(precision: Column, recall: Column) -> Column:
    return safe_divide(1.25 * precision * recall, 0.25 * precision + recall)


def folder_component(c: Column, default: str = "unknown") -> Column:
    """Keep letters, digits, '-' and '_' (any script); bound the length to 80."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    text = F.substring(text, 1, 80)
    return F.when(text == "", F.lit(default)).otherwise(text)


def source_label_meaning(c: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in SOURCE_LABELS.items() for v in pair])
    meaning = F.try_element_at(known, F.upper(F.trim(F.coalesce(c, F.lit("")))))
    return F.coalesce(meaning, F.lit("unrecognised_or_unlabelled"))


def duration_seconds(c: Column) -> Column:
    """``PT#H#M#S`` to seconds; malformed text is NULL and a bare ``PT`` is zero."""
    pattern = (
        r"^PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?$"
    )
    total = F.lit(0.0)
    for group, factor in ((1, 3600.0), (2, 60.0), (3, 1.0)):
        part = F.regexp_extract(c, pattern, group).try_cast("double")
        total = total + F.coalesce(part, F.lit(0.0)) * factor
    return F.when(c.rlike(pattern), total)


def hash_bucket(c: Column, modulus: int = 5) -> Column:
    """First SHA-256 byte modulo ``modulus``: a split that never moves a row."""
    byte = F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 2), 16, 10)
    return byte.cast("int") % modulus


def short_hash(parts: list[Column], length: int = 12) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def target_uid_ms1(dataset, compound, pool, mz, peak1, peak2) -> Column:
    return short_hash([dataset, compound, pool, F.format_string("%.8f", mz), peak1, peak2])


def target_uid_ms2(dataset, compound, pool, mz_text, peak1, peak2) -> Column:
    return short_hash([dataset, compound, pool, mz_text, peak1, peak2])


def sigmoid(z: Column) -> Column:
    """Stable on both tails."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def log_loss(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - label * logit + F.log1p(F.exp(-F.abs(logit)))


def resolution_fwhm(rt1: Column, rt2: Column, w1: Column, w2: Column) -> Column:
    """Gaussian-equivalent resolution; NULL when a width is missing or zero."""
    ok = (w1 != 0) & (w2 != 0) & (rt2 > rt1)
    return F.when(ok, 1.17741 * (rt2 - rt1) / (w1 + w2))


def resolution_passes(resolution: Column, threshold: float | None) -> Column:
    if threshold is None or threshold <= 0:
        return F.lit(True)
    return F.coalesce(resolution >= threshold, F.lit(False))


def _significant(digits: int):
    def render(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: "" if pd.isna(v) or v in (float("inf"), float("-inf")) else f"{v:.{digits}g}"
        )

    return render


@F.pandas_udf(T.StringType())
def text_g6(values: pd.Series) -> pd.Series:
    """Six significant digits, used only where a table leaves as text."""
    return _significant(6)(values)


@F.pandas_udf(T.StringType())
def text_g12(values: pd.Series) -> pd.Series:
    return _significant(12)(values)


@F.pandas_udf(T.StringType())
def fragment_text(spectra: pd.Series) -> pd.Series:
    """``mz,intensity;mz,intensity`` with twelve significant digits, sink only."""

    def one(peaks):
        if peaks is None:
            return ""
        return ";".join(f"{p['mz']:.12g},{p['it']:.12g}" for p in peaks)

    return spectra.map(one)
