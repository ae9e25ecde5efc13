"""Ordered prefix sums over a whole table without a single-task window.

Rows are first collapsed to distinct values, then split at approximate quantiles. Each
bucket is scanned on its own; bucket totals (a few rows, by the number of distinct values) give
the offsets. A heavy value is one row after the collapse, so it cannot make a heavy bucket.
Every function takes ``by``: independent groups, each with its own buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

#: Distinct values that a bucket holds about, and the most buckets that one list of cuts has.
PER_BUCKET, MOST_CUTS = 4096, 1 << 16


def _over(by, *order) -> W:
    window = W.partitionBy(*by) if by else W.partitionBy()
    return window.orderBy(*order) if order else window


def distinct_totals(df: DataFrame, key: Column, by=(), **measures: Column) -> DataFrame:
    """(by…, k, measures…) summed per distinct key value; NULL keys are dropped."""
    return (
        df.select(*by, key.cast("double").alias("k"), *[m.alias(n) for n, m in measures.items()])
        .where(F.col("k").isNotNull())
        .groupBy(*by, "k")
        .agg(*[F.sum(n).alias(n) for n in measures])
    )


def bucketed(totals: DataFrame, by=(), buckets: int | None = None) -> DataFrame:
    """Add ``bucket``: how many of the group's quantile cuts lie at or below ``k``.

    The collapsed table is read several times from here on, so it is cut off first.
    """
    totals = durable(totals)
    if buckets is None:
        buckets = min(MOST_CUTS, max(2, totals.count() // PER_BUCKET))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = F.percentile_approx("k", probs, 10_000).alias("cuts")
    if by:
        joined = totals.join(totals.groupBy(*by).agg(cuts), list(by))
    else:
        joined = totals.crossJoin(F.broadcast(totals.agg(cuts)))  # exactly one row
    return joined.withColumn(
        "bucket", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("k"))), F.lit(0))
    ).drop("cuts")


def _attach(rows: DataFrame, small: DataFrame, by) -> DataFrame:
    """Join a per-bucket table; broadcast it when its size is fixed by the bucket count."""
    return rows.join(small if by else F.broadcast(small), [*by, "bucket"])


def running_totals(
    totals: DataFrame, measures: list[str], descending: bool = False, by=(), buckets: int | None = None
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sums in key order) and ``all_<m>`` (group totals)."""
    rows = bucketed(totals, by, buckets)
    order = F.col("bucket").desc() if descending else F.col("bucket")
    before = _over(by, order).rowsBetween(W.unboundedPreceding, -1)
    whole = _over(by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = (
        rows.groupBy(*by, "bucket")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *by,
            "bucket",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
        )
    )
    key = F.col("k").desc() if descending else F.col("k")
    inside = _over([*by, "bucket"], key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _attach(rows, offsets, by)
        .withColumns({f"cum_{m}": F.col(f"off_{m}") + F.sum(m).over(inside) for m in measures})
        .drop(*[f"off_{m}" for m in measures])
    )


def running_min_from_right(rows: DataFrame, value: str, by=()) -> DataFrame:
    """Add ``suffix_min``: the least ``value`` at this key or any larger one.

    ``rows`` must already carry ``bucket`` and ``k``.
    """
    after = _over(by, F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = rows.groupBy(*by, "bucket").agg(F.min(value).alias("m")).select(
        *by, "bucket", F.min("m").over(after).alias("later")
    )
    inside = _over([*by, "bucket"], F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        _attach(rows, later, by)
        .withColumn("suffix_min", F.least(F.min(value).over(inside), F.col("later")))
        .drop("later")
    )


def previous_in_order(
    rows: DataFrame, columns: list[str], descending: bool = False, by=()
) -> DataFrame:
    """Add ``prev_<c>`` of the preceding key, also across bucket borders."""
    key = F.col("k").desc() if descending else F.col("k")
    order = F.col("bucket").desc() if descending else F.col("bucket")
    edge = (F.min if descending else F.max)(F.struct("k", *columns))
    last = rows.groupBy(*by, "bucket").agg(edge.alias("e")).select(
        *by, "bucket", F.lag("e").over(_over(by, order)).alias("e")
    )
    inside = _over([*by, "bucket"], key)
    return (
        _attach(rows, last, by)
        .withColumns(
            {f"prev_{c}": F.coalesce(F.lag(c).over(inside), F.col(f"e.{c}")) for c in columns}
        )
        .drop("e")
    )


def dense_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in the order of unique rows: range partitions, each counted on its own."""
    ranged = durable(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + within).drop("part", "start")
