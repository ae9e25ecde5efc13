"""Quality rules by a hashed n-gram log-likelihood ratio.

N-grams are whole words, alone and with the next word. Two multinomials over their hash buckets,
one of a trusted target (rows labelled good) and one of the whole corpus, give each bucket a log
ratio. The corpus' pseudo-counts are the target's over the target's share of all n-grams, so that
a bucket which neither has seen says nothing, and one seen seldom says little, whatever the
corpus' size. A document's score is its mean per n-gram; documents below a fixed threshold are
rejected. Counts cover every word of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WORD, carried, documents, let, split_words, stored

#: Hash buckets of single words (four hexadecimal digits of a digest); as many again hold pairs.
#: The broadcast table has both.
BUCKETS = 1 << 16
#: Pseudo-count of every bucket of the target.
SMOOTHING = 4.0
#: Lowest mean log ratio that a kept document may have. Labelled rows that pass the base rules lie
#: at -0.07 and more if good, at -0.16 and less if bad, on 200 to 10,000 documents.
THRESHOLD = -0.15
SYMBOLS = r"[#*$%&|<>]"

#: 30 bits hold a place in the word list (a string has fewer words), 34 bits a fingerprint.
PLACE_BITS = 30


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, first included; exact.

    Windows are packed as (fingerprint, place) into longs and sorted, so equal windows stand side
    by side. The few neighbours that agree in the fingerprint are then compared as words.
    """
    place = (1 << PLACE_BITS) - 1

    def packed(w):
        at = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
        pack = lambda i: F.shiftleft(at(i), PLACE_BITS).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), pack))

    def neighbours(p):
        head = lambda x: F.shiftright(x, PLACE_BITS)
        last = F.size(p) - 1
        before = lambda x, j: F.coalesce((j > 0) & (head(F.get(p, j - 1)) == head(x)), F.lit(False))
        after = lambda x, j: F.coalesce((j < last) & (head(F.get(p, j + 1)) == head(x)), F.lit(False))
        return F.transform(F.filter(p, lambda x, j: before(x, j) | after(x, j)), lambda x: x.bitwiseAND(F.lit(place).cast("long")).cast("int"))

    def exact(w, places):
        window = lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))
        return F.array_sort(F.transform(places, window))

    def same(x, y):
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def covered(s):
        last = F.size(s) - 1
        before = lambda x, j: F.coalesce((j > 0) & same(F.get(s, j - 1), x), F.lit(False))
        after = lambda x, j: F.coalesce((j < last) & same(F.get(s, j + 1), x), F.lit(False))
        hits = F.filter(s, lambda x, j: before(x, j) | after(x, j))
        three = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(three))

    count = let(words, lambda w: let(let(packed(w), neighbours), lambda places: let(exact(w, places), covered)))
    return F.when(F.size(words) >= 4, count).otherwise(0).cast("long")


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = let(F.split(text, "\n", -1), lambda x: F.filter(x, lambda s: s.rlike(WORD)))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), split_words(text).alias("_words"), lines.alias("_lines"))
        .select(
            "doc_id", "_words", F.xxhash64("_text").alias("_print"),
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
        )
    )


def word_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _print, _codes: each row's words as buckets. Stored, so that no word is hashed twice;
    a code takes less room than its word, also in the exchange that brings the trusted ids to it."""

    def code(word):
        return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_print"), F.transform(split_words(text), code).alias("_codes")))


def _buckets(coded: DataFrame, *keep: str) -> DataFrame:
    """A row for each n-gram: the kept columns and _bucket."""
    pairs = F.arrays_zip(F.col("_codes").alias("_a"), F.slice("_codes", F.lit(2), F.size("_codes")).alias("_b"))
    both = F.array(F.col("_a"), ((F.col("_a").cast("long") * 40503 + F.col("_b") * 9973) % BUCKETS + BUCKETS).cast("int"))
    return coded.select(*keep, F.inline(pairs)).select(*keep, F.explode(both).alias("_bucket")).filter("_bucket is not null")


def bucket_ratios(coded: DataFrame, good: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """_bucket, _ratio: log of target over corpus probability; at most 2 * BUCKETS rows.

    `good` holds the ids of the trusted rows. Both counts come from one pass over the corpus, and
    the trusted ids are merged in at every size, as they grow with it.
    """
    trusted = good.select(F.col(id_col).alias("_id"), F.lit(1).alias("_good")).distinct()
    rows = coded.select(F.col("doc_id").alias("_id"), "_codes").join(trusted.hint("merge"), "_id", "left")
    counts = _buckets(rows, "_good").groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_all"), F.count("_good").alias("_target")
    )
    counts = stored(counts)
    totals = counts.agg(F.sum("_all").alias("_sum_all"), F.sum("_target").alias("_sum_target"))
    share = F.coalesce(F.col("_sum_target") / F.col("_sum_all"), F.lit(0.0))
    ratio = F.log((F.col("_target") + SMOOTHING) / (F.col("_all") * share + SMOOTHING))
    return counts.crossJoin(F.broadcast(totals)).select("_bucket", ratio.alias("_ratio"))


def judge(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, the five base measures, base_failed, score, kept, _id, _print.

    Null text has no words, so it fails the base rules. With no trusted row at all every
    score is 0, and the base rules alone decide. Repeated rows share a score; null ids and extra columns are fine.
    """
    base = base_measures(docs, id_col, text_col).drop("_words").withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    coded = word_codes(docs, id_col, text_col)
    ratios = stored(bucket_ratios(coded, good, id_col))
    scores = (
        _buckets(coded.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))), "_id", "_print")
        .join(F.broadcast(ratios), "_bucket")  # a fixed number of rows
        .groupBy("_id", "_print")
        .agg(F.avg("_ratio").alias("score"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        base.join(scores, ["_id", "_print"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
    )


def good_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op7(spark, sf_dir):
    return judge(documents(spark, sf_dir), good_ids(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    verdicts = judge(docs, good).filter("kept").select("_id", "_print").distinct()
    keyed = carried(docs, _id=F.coalesce("doc_id", F.lit(NO_ID)), _print=F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(verdicts, ["_id", "_print"], "left_semi").select("_doc.*")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_no, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
x AS (SELECT row_no, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT row_no, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM x WHERE i + 2 <= len(ws)),
r AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, a, b, c) AS n FROM g),
cov AS (SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY row_no),
ln AS (SELECT row_no, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_no),
h AS (SELECT row_no, i, ('0x' || substr(md5(ws[i]), 1, 4))::BIGINT AS c FROM x),
n AS (SELECT row_no, c, lead(c) OVER (PARTITION BY row_no ORDER BY i) AS nx FROM h),
b AS (SELECT row_no, c AS bucket FROM n UNION ALL SELECT row_no, (c * 40503 + nx * 9973) % {BUCKETS} + {BUCKETS} FROM n WHERE nx IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
m AS (SELECT bucket, count(*) AS n_all, count(good.doc_id) AS n_good FROM b JOIN d USING (row_no) LEFT JOIN good USING (doc_id) GROUP BY bucket),
lr AS (SELECT bucket, ln((n_good + {SMOOTHING}) / (n_all * (sum(n_good) OVER () / sum(n_all) OVER ()) + {SMOOTHING})) AS ratio FROM m),
sc AS (SELECT row_no, avg(ratio) AS score FROM b JOIN lr USING (bucket) GROUP BY row_no),
al AS (SELECT w.row_no, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
              (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
              coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, score
       FROM w LEFT JOIN dup USING (row_no) LEFT JOIN cov USING (row_no) LEFT JOIN sc USING (row_no))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(score >= {THRESHOLD}, false) AS kept
FROM al
"""
