"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the smallest node that edges reach, for nodes with an edge.

    Each round hangs every node's larger neighbours under its smallest one, then its smaller
    neighbours; rounds end when the edges stay as they are. Only counts reach the driver.
    """
    links = stored(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free sum over the rows: equal for equal edge sets."""
    mixed = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed.cast("decimal(38,0)")), F.sum(F.xxhash64(mixed, F.lit(7)).cast("decimal(38,0)"))).first())
