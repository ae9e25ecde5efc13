"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks. Distinct blocks are sorted into integer names, and
adjacent names are named in pairs until one name is left per document. Names are given by
equality of content alone, so an identity can't collide: equal block count and equal last name
mean equal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, documents, hot_keys, lower_ascii, numbered, stored

KEY = ["_id", "_len", "_hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Normalised text with a row key that holds for repeated and missing ids as well."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id", "_text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
        F.length("_text").alias("_len"), F.xxhash64("_text").alias("_hash"),
    )


def _blocks(block_chars: int) -> Column:
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.col("_len") <= block_chars, F.array("_text")).otherwise(cut)


def _identified(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """doc_id, text_sha256, _blocks and _name of each row: the last two identify its text."""
    rows = _keyed(docs, id_col, text_col)
    cut = _blocks(block_chars)
    narrow = stored(rows.select("doc_id", *KEY, F.sha2("_text", 256).alias("text_sha256"), F.transform(cut, lambda b: F.xxhash64(b)).alias("_prints")))
    hot = hot_keys(narrow.select(F.explode("_prints").alias("_print")), "_print")
    blocks = rows.select(*KEY, F.posexplode(cut).alias("_pos", "_block")).withColumn("_print", F.xxhash64("_block"))
    # a block's first place stands for it from then on
    firsts = blocks.groupBy("_print", "_block").agg(F.min(F.struct(*KEY, "_pos")).alias("_first"))
    # names of hot blocks (HOT_SHARE fingerprints at most) come to their rows, which then travel
    # without content and anywhere; the join reads the grouped side where grouping left it
    known = F.broadcast(firsts.join(F.broadcast(hot), "_print", "left_semi").withColumnRenamed("_first", "_known"))
    found = blocks.join(known, ["_print", "_block"], "left").select(
        *KEY, "_pos", "_known",
        F.when(F.col("_known").isNull(), F.col("_block")).alias("_block"),
        F.when(F.col("_known").isNull(), F.col("_print")).otherwise(F.xxhash64(*KEY, "_pos")).alias("_print"),
    )
    placed = found.join(firsts, ["_print", "_block"], "left").select(*KEY, "_pos", F.coalesce("_known", "_first").alias("_first"))
    names = _names(stored(placed.distinct()))
    return narrow.select("doc_id", *KEY, "text_sha256").join(names, KEY).select("doc_id", "text_sha256", "_blocks", "_name")


def _names(placed: DataFrame) -> DataFrame:
    """One row per row key: _blocks and _name, from the blocks' first places."""
    flat = placed.select(*KEY, "_pos", *[F.col(f"_first.{c}").alias(f"f{c}") for c in (*KEY, "_pos")])
    names = numbered(flat.select("f_id", "f_len", "f_hash", "f_pos").distinct(), ["f_id", "f_len", "f_hash", "f_pos"], "_name")
    level = stored(flat.join(names, ["f_id", "f_len", "f_hash", "f_pos"]).select(*KEY, "_pos", "_name"))
    sizes = level.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_blocks"))
    level = stored(level.join(sizes, KEY))
    done = level.filter("_blocks = 1").select(*KEY, "_blocks", "_name")
    level, left = level.filter("_blocks > 1"), level.agg(F.max("_blocks")).first()[0] or 1
    while left > 1:
        side = lambda odd: F.max(F.when(F.col("_pos") % 2 == odd, F.col("_name")))
        pairs = stored(
            level.groupBy(*KEY, "_blocks", F.floor(F.col("_pos") / 2).alias("_half"))
            .agg(side(0).alias("_a"), F.coalesce(side(1), F.lit(-1)).alias("_b"))
        )
        names = numbered(pairs.select("_a", "_b").distinct(), ["_a", "_b"], "_name")
        level = stored(pairs.join(names, ["_a", "_b"]).select(*KEY, "_blocks", F.col("_half").alias("_pos"), "_name"))
        left = (left + 1) // 2
    return done.unionByName(level.select(*KEY, "_blocks", "_name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest doc_id of equal texts stays; rows repeated with that
    id share its decision, and a null id stays only where its group has no other. Extra columns
    of the input are not read. An empty table gives an empty result.
    """
    named = stored(_identified(docs, id_col, text_col, block_chars))
    groups = named.groupBy("_blocks", "_name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return named.join(stored(groups), ["_blocks", "_name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op6(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM t WINDOW g AS (PARTITION BY n)
"""
