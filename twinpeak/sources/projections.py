"""Deterministic mass-spectrometry projections of the relational test tables.

Each one is a plain projection or a partially aggregated group-by, so its work grows
with the table and no group is collected unless its size is fixed by the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, work_partitions

# Isolation-window centre assigned to each event type.
WINDOW_CENTRES = {"click": 312.0, "error": 324.0, "purchase": 336.0, "signup": 348.0, "view": 360.0}
WINDOW_HALF_WIDTH = 7.0
PAIR_OFFSETS = (1, 2, 3, 4)
# Least intensity of a strong component.
STRONG = 2000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> one fragment spectrum per vector (vec_id, label, peaks).

    Every fifth vector keeps its strong components only, so that spectra differ in length.
    """
    vec = F.col("vec_id")
    dims = F.col("embedding").cast("array<double>")
    floor = F.when(vec % 5 == 0, F.lit(STRONG)).otherwise(F.lit(0.0))

    def peak(e, i):
        shift = F.when((vec % 4).isin(1, 2), (vec * (i + 1)) % 7).otherwise(F.lit(0))
        mz = (
            F.lit(100.0)
            + F.floor(i / 2) * F.lit(2.0)
            + (i % 2) * F.lit(0.006)
            + shift * F.lit(0.0021)
        )
        return F.struct(mz.alias("mz"), (1000.0 * F.pow(10.0 * F.abs(e), 2.0)).alias("it"))

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.filter(F.transform(dims, peak), lambda p: p["it"] >= floor).alias("peaks")
    )


def spectrum_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring spectra (a, b = a+1..a+4); ``same`` tells whether labels agree."""
    s = spectra(spark, sf_dir)
    left = s.select(
        F.col("vec_id").alias("a"),
        F.col("label").alias("label_a"),
        F.col("peaks").alias("peaks_a"),
        F.explode(F.array(*[F.lit(k) for k in PAIR_OFFSETS])).alias("gap"),
    ).withColumn("b", F.col("a") + F.col("gap"))
    # The join key's own partitioning: free under a shuffled join, and it spreads the
    # comparison work when the other side is small enough to be broadcast.
    left = left.repartition(work_partitions(spark), "b")
    right = s.select(
        F.col("vec_id").alias("b"),
        F.col("label").alias("label_b"),
        F.col("peaks").alias("peaks_b"),
    )
    return left.join(right, "b").select(
        "a",
        "b",
        F.when(F.col("label_a") == F.col("label_b"), 1).otherwise(0).alias("same"),
        "peaks_a",
        "peaks_b",
    )


def ms2_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> centroids (raw_id, win, scan, rt, mz, it), one row per distinct m/z.

    Equal m/z values of one scan are summed first: sums and centroid clusters are
    unchanged, and a hot scan shrinks to its distinct m/z values before any join.
    """
    centres = F.create_map(*[F.lit(v) for kv in WINDOW_CENTRES.items() for v in kv])
    e = table(spark, sf_dir, "events").select(
        F.try_element_at(centres, F.col("event_type")).alias("win"),
        (
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 4
            + F.floor(F.hour("ts") / 6).cast("int")
        ).alias("scan"),
        F.col("user_id"),
        F.col("event_id"),
        F.col("value"),
    )
    mz = F.when(
        F.col("user_id") % 10 >= 6, F.col("win") + (F.col("event_id") % 3) * F.lit(0.0005)
    ).otherwise(
        F.lit(100.0)
        + F.lit(20.0) * (F.col("user_id") % 10)
        + (F.col("event_id") % 5) * F.lit(0.0004)
    )
    return (
        e.where(F.col("win").isNotNull())
        .groupBy("win", "scan", mz.alias("mz"))
        .agg(F.sum(F.col("value") * 1000.0).alias("it"))
        .select(
            F.lit("events").alias("raw_id"),
            "win",
            "scan",
            (F.col("scan") * F.lit(6.0)).alias("rt"),
            "mz",
            "it",
            (F.col("win") - WINDOW_HALF_WIDTH).alias("iso_lo"),
            (F.col("win") + WINDOW_HALF_WIDTH).alias("iso_hi"),
        )
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> target rows with precursor m/z and up to two RTs in minutes."""
    k = F.col("c_custkey")
    mz = F.when(k % 2 == 0, F.lit(312.0) + F.lit(12.0) * (k % 5)).otherwise(
        F.lit(290.0) + (k % 800) / F.lit(10.0)
    )
    peak1 = (k % 60) / F.lit(6.0)
    peak2 = F.when((k % 5 != 0) | (k % 7 == 0), peak1 + (k % 17) / F.lit(20.0))
    return table(spark, sf_dir, "customer").select(
        k.alias("row_id"),
        F.lit("events").alias("raw_id"),
        F.col("c_name").alias("compound_id"),
        F.col("c_mktsegment").alias("pool"),
        mz.alias("mz"),
        peak1.alias("peak_a_rt"),
        peak2.alias("peak_b_rt"),
    )


def ms1_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> MS1 centroids, keeping the largest intensity per (scan, m/z)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 10)
            .cast("int")
            .alias("scan"),
            (F.lit(100.0) + (F.col("l_partkey") % 2000) * F.lit(0.25)).alias("mz"),
        )
        .agg(F.max("l_extendedprice").alias("it"))
        .select(
            F.lit("lineitem").alias("raw_id"),
            "scan",
            (F.col("scan") * F.lit(6.0)).alias("rt"),
            "mz",
            "it",
        )
    )


def ms1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> distinct target m/z with the smallest part key as its id."""
    mz = F.lit(100.0) + (F.col("p_partkey") % 2000) * F.lit(0.25)
    return (
        table(spark, sf_dir, "part")
        .groupBy(mz.alias("mz"))
        .agg(F.min("p_partkey").alias("target_id"))
        .select("target_id", F.lit("lineitem").alias("raw_id"), "mz")
    )


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> external p-values with ties and NULLs."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("test_id"),
        F.when(k % 11 != 0, ((k * 37) % 1000) / F.lit(1000.0)).alias("p"),
    )


def result_expressions(variant: int) -> dict[str, str]:
    """SQL expressions (any dialect) that turn an ``orders`` row into a result-table row.

    Two variants stand for two processing runs: every seventh row changes status and
    every sixth changes its first spectrum. Customers repeat, so target keys repeat.
    """
    k, g = "o_orderkey", "o_custkey"
    h = f"({k} + CASE WHEN {variant} = 1 AND {k} % 7 = 0 THEN 1 ELSE 0 END)"
    m = f"({k} + CASE WHEN {variant} = 1 AND {k} % 6 = 0 THEN 1 ELSE 0 END)"
    scored = f"{h} % 5 < 3"

    def text(expr: str) -> str:
        return f"concat('', {expr})"

    def when_scored(expr: str) -> str:
        return f"CASE WHEN {scored} THEN {text(expr)} ELSE '' END"

    def choice(*values: str) -> str:
        arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {h} % 5 {arms} END"

    return {
        "row_no": k,
        "Compound_ID": text(f"'C', {g} % 700"),
        "SGC ID for Component": text(f"'S', {g} % 50"),
        "SGC ID for Pool": text(f"'P', {g} % 10"),
        "MZ": text(f"280 + {g} % 120"),
        "Peak1": f"CASE WHEN {g} % 13 = 0 THEN '' ELSE {text(f'{g} % 40')} END",
        "Peak2": f"CASE WHEN {g} % 6 = 0 THEN '' ELSE {text(f'{g} % 40 + 1 + {g} % 3')} END",
        "enantiomer_pair_status": choice(
            "candidate_enantiomer_pair", "ms2_not_similar", "insufficient_ms2_evidence",
            "not_evaluable", "not_evaluated",
        ),
        "enantiomer_pair_reason": choice(
            "similar", "cosine<0.7", "matched_peaks<6", "one_or_both_ms2_spectra_are_empty",
            "two_peak_retention_times_required",
        ),
        "ms2_diagnostic_status": choice(
            "supported_same_compound", "conflicting_spectra", "insufficient_evidence",
            "not_evaluable", "not_attempted",
        ),
        "ms2_issue_codes": f"CASE WHEN {k} % 10 = 3 THEN 'NO_ACQUIRED_DIA_WINDOW' ELSE '' END",
        "ms2_cosine": when_scored(f"({h} * 7) % 101 / 100.0e0"),
        "ms2_entropy_similarity": when_scored(f"({h} * 3) % 101 / 100.0e0"),
        "ms2_matched_peaks": when_scored(f"({h} * 3) % 15"),
        "peak_a_fragment_count": when_scored(f"({h} * 5) % 20 + 1"),
        "peak_b_fragment_count": when_scored(f"({h} * 11) % 20 + 1"),
        "peak_a_candidate_fragment_count": text(f"100 + {k} % 50"),
        "peak_b_candidate_fragment_count": text(f"100 + {k} % 30"),
        "peak_a_explained_intensity": when_scored(f"({h} * 13) % 100 / 100.0e0"),
        "peak_b_explained_intensity": when_scored(f"({h} * 17) % 100 / 100.0e0"),
        "peak_a_MS2": f"CASE WHEN {h} % 5 = 4 OR ({h} % 5 = 3 AND {k} % 2 = 0) THEN '' "
        f"ELSE {text(f'{chr(39)}100,{chr(39)}, 1 + {m} % 9')} END",
        "peak_b_MS2": f"CASE WHEN {h} % 5 >= 3 THEN '' ELSE {text(f'{chr(39)}100,{chr(39)}, 1 + {k} % 8')} END",
        "peak_a_quality_flags": f"CASE {k} % 9 WHEN 0 THEN 'no_precursor_signal' WHEN 1 THEN 'no_fragments' ELSE 'ok' END",
        "peak_b_quality_flags": "'ok'",
        "dia_window_match_count": f"CASE WHEN {k} % 10 = 3 THEN '' WHEN {k} % 4 = 0 THEN '2' ELSE '1' END",
        "dia_window_center": text(f"300 + 12 * ({g} % 5)"),
        "rt_separation_sec": text(f"{g} % 60"),
        "peak_a_apex_rt": text(f"({g} % 40) * 60 + {k} % 9 - 2"),
        "peak_a_rt_window_start": text(f"({g} % 40) * 60 - 10"),
        "peak_a_rt_window_end": text(f"({g} % 40) * 60 + 10"),
        "peak_b_apex_rt": text(f"({g} % 40 + 1 + {g} % 3) * 60 + {k} % 11 - 10"),
        "peak_b_rt_window_start": text(f"({g} % 40 + 1 + {g} % 3) * 60 - 10"),
        "peak_b_rt_window_end": text(f"({g} % 40 + 1 + {g} % 3) * 60 + 10"),
        "ml_diagnostic_status": f"CASE {k} % 4 WHEN 0 THEN 'supported_same_compound' "
        f"WHEN 1 THEN 'conflicting_spectra' WHEN 2 THEN 'insufficient_evidence' ELSE 'not_evaluable' END",
    }


def result_rows(spark: SparkSession, sf_dir: str, variant: int = 0) -> DataFrame:
    """orders -> a text result table, as a result CSV would be read."""
    exprs = result_expressions(variant)
    keys = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return keys.selectExpr(*[f"{e} AS `{n}`" for n, e in exprs.items()])
