"""Effect sizes, replicate summaries and multiple-testing adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import distinct_totals, running_min_from_right, running_totals


def checked(c: Column, name: str, minimum: float | None = 0.0) -> Column:
    """Fail the job on a NaN, infinite or too small value; NULL passes through."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    if minimum is not None:
        bad = bad | (c < minimum)
    return F.when(c.isNotNull() & bad, F.raise_error(f"{name} must be finite and valid")).otherwise(c)


def check_pseudocount(value: float, positive: bool = False) -> float:
    if not (value >= 0 and value < float("inf")) or (positive and value == 0):
        raise ValueError("pseudocount must be finite and non-negative (positive for log ratios)")
    return float(value)


def enrichment_fold(target: Column, control_mean: Column, pseudocount: float = 0.0) -> Column:
    """(target + p) / (mean of controls + p); NULL without controls or at zero."""
    p = check_pseudocount(pseudocount)
    return F.try_divide(checked(target, "target") + p, checked(control_mean, "controls") + p)


def recovery_fold(input_value: Column, eluate: Column, pseudocount: float = 0.0) -> Column:
    p = check_pseudocount(pseudocount)
    return F.try_divide(checked(eluate, "eluate") + p, checked(input_value, "input") + p)


def enantiomer_fraction(area1: Column, area2: Column, pseudocount: float = 0.0) -> Column:
    """Share of the first area, scaled first so very large areas cannot overflow."""
    p = check_pseudocount(pseudocount)
    a, b = checked(area1, "area_1") + p, checked(area2, "area_2") + p
    scale = F.nullif(F.greatest(a, b), F.lit(0.0))
    return (a / scale) / (a / scale + b / scale)


def fraction_shift(in1, in2, out1, out2, pseudocount: float = 0.0) -> Column:
    return enantiomer_fraction(out1, out2, pseudocount) - enantiomer_fraction(in1, in2, pseudocount)


def log2_ratio_shift(in1, in2, out1, out2, pseudocount: float) -> Column:
    """Change of log2(first / second) from input to eluate, as a difference of logs."""
    p = check_pseudocount(pseudocount, positive=True)

    def lg(c, name):
        return F.log2(checked(c, name) + p)

    return (lg(out1, "eluate_area_1") - lg(out2, "eluate_area_2")) - (
        lg(in1, "input_area_1") - lg(in2, "input_area_2")
    )


def replicate_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample SD (two or more replicates) and CV of each group."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return out.withColumn(
        "cv", F.when(F.col("mean") != 0, F.try_divide(F.col("sd"), F.abs("mean")))
    )


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "p_adjusted") -> DataFrame:
    """FDR adjustment of external p-values; NULL p-values stay NULL.

    Tied p-values share one adjusted value, so the work runs on distinct values: rank and
    running minimum come from bucketed prefix scans, then join back on the value.
    """
    value = F.col(p)
    bad = value.isNotNull() & (F.isnan(value) | (value < 0) | (value > 1))
    valid = F.when(bad, F.raise_error("p-values must be between 0 and 1")).otherwise(value)
    totals = distinct_totals(df, valid, n=F.lit(1))
    ranked = running_totals(totals, ["n"]).withColumn(
        "raw", F.col("k") * F.col("all_n") / F.col("cum_n")
    )
    adjusted = running_min_from_right(ranked, "raw").select(
        F.col("k").alias("_p"), F.least(F.col("suffix_min"), F.lit(1.0)).alias(out)
    )
    keyed = df.withColumn("_p", value.cast("double"))
    return keyed.join(adjusted, "_p", "left").drop("_p")
