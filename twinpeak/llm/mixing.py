"""Mixing sources to target weights by capped water-filling.

Sources weigh 5, 2, 1, repeating, by code point (null last). A total is shared by weight; a
source's target stops at `max_epochs` times its size, and the excess is reshared by weight until
none is above. Water-filling in one pass: in ascending order of cap per weight, a source is
clamped while the level that the others would get lies above its own.

Sampling: a source's epochs are target / size. The whole epochs take every document so often; the
fraction takes documents once more, in a seeded order, until their words meet the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, carried, documents, numbered, stored, word_count

#: The weights of the contract.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share_percent: int = 150, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Exact integer sums, one division.

    Sources may be many: their order and running sums go through range partitions.
    """
    keyed = sizes.select(F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_name"), "source", "source_size")
    ranked = numbered(keyed, ["_last", "_name"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    caps = ranked.select(
        "source", "source_size", "_rank", weight.cast("long").alias("_weight"), (F.col("source_size") * max_epochs).alias("_cap")
    )
    caps = numbered(caps.withColumn("_ratio", F.col("_cap") / F.col("_weight")), ["_ratio", "_rank"], "_at")
    caps = stored(caps.withColumn("_bin", F.floor(F.col("_at") / 4096)))
    bins = caps.groupBy("_bin").agg(F.sum("_cap").alias("c"), F.sum("_weight").alias("w"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = bins.select("_bin", F.coalesce(F.sum("c").over(before), zero).alias("_c0"), F.coalesce(F.sum("w").over(before), zero).alias("_w0"))
    totals = caps.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_weights"))
    within = Window.partitionBy("_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") * share_percent / 100.0 - F.col("_c")) / (F.col("_weights") - F.col("_w"))
    levels = (
        caps.join(starts, "_bin")
        .crossJoin(F.broadcast(totals))  # one row
        .withColumn("_c", F.col("_c0") + F.coalesce(F.sum("_cap").over(within), zero))
        .withColumn("_w", F.col("_w0") + F.coalesce(F.sum("_weight").over(within), zero))
        .withColumn("_level", level)
    )
    levels = stored(levels)
    # the first source that isn't clamped sets the level for it and all after it
    free = levels.filter("_level < _ratio").agg(F.min(F.struct("_at", "_level")).alias("_free"))
    open_level = F.when(F.col("_at") >= F.col("_free._at"), F.col("_free._level") * F.col("_weight"))
    target = F.coalesce(open_level, F.col("_cap").cast("double"))
    return levels.crossJoin(F.broadcast(free)).select("source", "source_size", target.alias("target"))


def _order(id_col: Column, seed: int) -> Column:
    """A document's place in the seeded order: hex digits, equal in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
                share_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, repeats.

    size is the number of words; null text has none. A null source is a source of its own. Rows
    that repeat are drawn one by one. Extra columns aren't read. An empty table gives no rows.

    The seeded order is cut into about sqrt(rows) buckets per source, so that neither the sums by
    bucket nor the one bucket in which the fraction ends grows faster than that.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        _order(F.col(id_col), seed).alias("_order"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_print"),
    )
    rows = stored(rows)
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    plan = source_targets(sizes.select("source", "source_size"), share_percent, max_epochs).drop("source_size")
    plan = stored(_null_join(sizes, plan))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("_whole", epochs).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    place = F.conv(F.substring("_order", 1, 12), 16, 10).cast("long") / float(1 << 48)
    joined = _null_join(rows, plan).withColumn("_bucket", F.floor(place * F.ceil(F.sqrt("_rows"))))
    sums = joined.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"), F.first("_part").alias("_part"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    # in every bucket before the crossing one all documents are taken, in those after it none
    crossing = sums.filter("_before <= _part and _before + _words > _part").select("source", F.col("_bucket").alias("_cross"), "_before")
    joined = stored(_null_join(joined, stored(crossing), "left"))
    run = Window.partitionBy("source").orderBy("_order", "size", "doc_id", "_print").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter("_bucket = _cross").withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    edge = edge.withColumn("_more", F.when(F.col("_at") + F.col("size") / 2 <= F.col("_part"), 1).otherwise(0))
    clear = joined.filter("_cross is null or _bucket != _cross").withColumn(
        "_more", F.when(F.col("_part") <= 0, 0).when(F.col("_cross").isNull() | (F.col("_bucket") < F.col("_cross")), 1).otherwise(0)
    )
    names = ["doc_id", "size", "source", "source_size", "target", "_print"]
    repeats = F.least(F.col("_whole") + F.col("_more"), F.lit(max_epochs)).cast("long").alias("repeats")
    return clear.select(*names, repeats).unionByName(edge.select(*names, repeats))


def _null_join(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source with null equal to null; the side by source is left to Spark's size check."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return rows.withColumn("_key", key).join(by_source.withColumn("_key", key).drop("source"), "_key", how).drop("_key")


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each input row as often as it is taken, with all its columns."""
    keys = ["_id", "_source", "_print"]
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    taken = (
        repetitions(docs, id_col, text_col, source_col, seed)
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), source.alias("_source"), "_print", "repeats")
        .groupBy(*keys)
        .agg(F.sum("repeats").alias("_sum"), F.count(F.lit(1)).alias("_alike"))
    )
    keyed = carried(
        docs,
        _id=F.coalesce(F.col(id_col), F.lit(NO_ID)),
        _source=F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
        _print=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    )
    # rows alike in id, source and text share what they were given
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    times = F.floor(F.col("_sum") / F.col("_alike")) + F.when(place <= F.col("_sum") % F.col("_alike"), 1).otherwise(0)
    return (
        keyed.join(taken, keys)
        .withColumn("_times", times)
        .filter("_times > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select("_doc.*")
    )


def op2(spark, sf_dir):
    return repetitions(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


SQL = """
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
c AS (SELECT *, 2 * source_size / weight::DOUBLE AS ratio, sum(source_size) OVER ()::BIGINT AS al, sum(weight) OVER ()::BIGINT AS ws,
             coalesce(sum(2 * source_size) OVER b, 0)::BIGINT AS cb, coalesce(sum(weight) OVER b, 0)::BIGINT AS wb
      FROM w WINDOW b AS (ORDER BY 2 * source_size / weight::DOUBLE, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (al * 150 / 100.0::DOUBLE - cb) / (ws - wb)::DOUBLE AS lvl FROM c),
f AS (SELECT ratio AS fr, rnk AS fk, lvl AS fl FROM l WHERE lvl < ratio ORDER BY ratio, rnk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fr IS NOT NULL AND (ratio, rnk) >= (fr, fk) THEN fl * weight ELSE (2 * source_size)::DOUBLE END AS target
      FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS part,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN part > 0 AND at_ + size / 2.0 <= part THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM q
"""
