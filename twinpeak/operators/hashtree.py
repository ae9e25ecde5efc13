"""Canonical digests of tables by hash trees, and what differs between two of them.

A row's digest covers its fields in the given order, NULL as empty text. Equal rows are one digest with
a count. A leaf is all digests that begin with the same hexadecimal digits, taken in sorted order; a
node joins the nodes that begin alike with one digit less; the root is the table. Digests and not
partitions decide who shares a leaf, so the root is the same for any partitioning and order of rows, and
leaves are of even size whatever the data. Two trees of one depth are compared from the root downwards,
and only below nodes that differ.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, work_partitions
from .reconcile import fingerprint, text

#: Distinct rows that a leaf holds about.
PER_LEAF = 1024
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def depth_for(rows: int) -> int:
    """Levels below the root for a table of so many rows; both sides of a comparison take one depth."""
    return max(1, math.ceil(math.log(max(1, rows / PER_LEAF), 16)))


def row_digests(table: DataFrame, fields: list[str], by=(), depth: int | None = None) -> DataFrame:
    """(by…, digest, n): distinct rows of each group, with how often they occur.

    With a depth also ``prefix``: digests are dealt by their leaf, in bytes, and not moved again for the tree.
    """
    digest = fingerprint([text(F.col(f"`{f}`")) for f in fields])
    if depth is None:
        return table.select(*by, digest.alias("digest")).groupBy(*by, "digest").agg(F.count("*").alias("n"))
    packed = table.select(*by, F.unhex(digest).alias("packed"))
    dealt = packed.withColumn("prefix", F.substring(F.lower(F.hex(F.substring("packed", 1, (depth + 1) // 2))), 1, depth))
    dealt = dealt.repartition(work_partitions(table.sparkSession), *by, "prefix")
    counted = dealt.groupBy(*by, "prefix", "packed").agg(F.count("*").alias("n"))
    return counted.select(*by, "prefix", F.lower(F.hex("packed")).alias("digest"), "n")


def tree(digests: DataFrame, depth: int, by=()) -> DataFrame:
    """(by…, level, prefix, hash) of every node; level 0 is the root."""
    if "prefix" not in digests.columns:
        digests = digests.withColumn("prefix", F.substring("digest", 1, depth))
    cell = F.concat("digest", F.lit(":"), F.col("n").cast("string"))
    joined = lambda cells: F.sha2(F.array_join(F.array_sort(F.collect_list(cells)), ","), 256).alias("hash")
    level = digests.groupBy(*by, "prefix").agg(joined(cell))
    level = durable(level)
    nodes = level.withColumn("level", F.lit(depth))
    for up in range(depth - 1, -1, -1):
        parent = F.substring("prefix", 1, up) if up else F.lit("")
        level = level.groupBy(*by, parent.alias("p")).agg(joined(F.concat("prefix", F.lit(":"), "hash"))).withColumnRenamed("p", "prefix")
        nodes = nodes.unionByName(level.withColumn("level", F.lit(up)))
    return nodes.select(*by, "level", "prefix", "hash")


def table_digest(table: DataFrame, fields: list[str], by=(), depth: int | None = None) -> DataFrame:
    """(by…, sha256): one digest of each group's rows."""
    if depth is None:
        depth = depth_for(table.count())
    roots = tree(row_digests(table, fields, by, depth), depth, by).where("level = 0")
    return roots.select(*by, F.col("hash").alias("sha256"))


def differing_leaves(left: DataFrame, right: DataFrame, depth: int, by=()) -> DataFrame:
    """(by…, prefix) of leaves that two trees don't share; a level is read below differing nodes only."""
    left, right = durable(left), durable(right)
    keys = [*by, "prefix"]
    above = None
    for level in range(depth + 1):
        a = left.where(F.col("level") == level).select(*keys, F.col("hash").alias("h"))
        b = right.where(F.col("level") == level).select(*keys, F.col("hash").alias("g"))
        if above is not None:
            a, b = (_below(side, above, level, by) for side in (a, b))
        above = a.join(b, keys, "full_outer").where(~F.col("h").eqNullSafe(F.col("g"))).select(*keys)
    return above


def _below(nodes: DataFrame, above: DataFrame, level: int, by) -> DataFrame:
    up = F.substring("prefix", 1, level - 1) if level > 1 else F.lit("")
    return nodes.withColumn("up", up).join(above.withColumnRenamed("prefix", "up"), [*by, "up"], "left_semi").drop("up")


def row_changes(stated: DataFrame, found: DataFrame, key: list[str], fields: list[str], by=(), depth: int | None = None) -> DataFrame:
    """(by…, key…, fault): rows of ``stated`` that ``found`` lacks (missing), has besides (extra) or has otherwise (changed).

    Rows are found again only in leaves that differ. Several rows of one key are one fault; a key whose
    rows differ in their number alone is changed.
    """
    if depth is None:
        depth = depth_for(max(stated.count(), found.count()))
    sides = [durable(row_digests(t, fields, by)) for t in (stated, found)]
    leaves = durable(differing_leaves(*[tree(s, depth, by) for s in sides], depth, by))
    inside = [s.withColumn("prefix", F.substring("digest", 1, depth)).join(leaves, [*by, "prefix"], "left_semi").drop("prefix") for s in sides]
    odd = (
        inside[0].select(*by, "digest", F.col("n").alias("m"))
        .unionByName(inside[1].select(*by, "digest", (-F.col("n")).alias("m")))
        .groupBy(*by, "digest").agg(F.sum("m").alias("m")).where("m != 0").select(*by, "digest")
    )
    odd = durable(odd)
    digest = fingerprint([text(F.col(f"`{f}`")) for f in fields]).alias("digest")
    rows = [t.select(*by, *key, digest).join(odd, [*by, "digest"], "left_semi").select(*by, *key, F.lit(bit).alias("bit")) for t, bit in ((stated, 1), (found, 2))]
    both = rows[0].unionByName(rows[1]).groupBy(*by, *key).agg(F.bit_or("bit").alias("bit"))
    fault = F.when(F.col("bit") == 1, "missing").when(F.col("bit") == 2, "extra").otherwise("changed")
    return both.select(*by, *key, fault.alias("fault"))


def source_cover(stated: DataFrame, eligible: DataFrame, batch: str, fields: list[str], depth: int | None = None) -> DataFrame:
    """(batch, fault): batches that the manifest's (batch, sha256) rows lack, add or state another digest for.

    Batch names are compared as text. A manifest that names a batch twice, or states no digest for it,
    is at fault there too (repeated, unstated); an exact cover gives no rows.
    """
    name = text(F.col(f"`{batch}`")).alias("batch")
    actual = table_digest(eligible.select(name, *fields), fields, ("batch",), depth).select("batch", F.col("sha256").alias("actual"))
    listed = stated.select(name, text(F.col("sha256")).alias("sha256")).groupBy("batch").agg(F.count("*").alias("n"), F.max("sha256").alias("stated"))
    both = actual.join(listed, "batch", "full_outer")
    fault = (
        F.when(F.col("n").isNull(), "missing").when(F.col("actual").isNull(), "extra").when(F.col("n") > 1, "repeated")
        .when(F.col("stated") == "", "unstated").when(F.col("stated") != F.col("actual"), "changed")
    )
    return both.select("batch", fault.alias("fault")).where("fault IS NOT NULL")
