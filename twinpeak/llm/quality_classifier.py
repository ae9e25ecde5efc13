"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of the target (rows labelled good) and of all raw
text, give each document an importance weight: the log ratio of its n-grams' probabilities under
both, brought to a length of `LENGTH` n-grams so that long texts don't win by size. Gumbel noise,
seeded by id, is added, and the documents with the k highest sums are the sample.

N-grams are whole words, alone and with the next one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, documents, numbered, stored

#: Hash buckets of each model: what a task holds, and what reaches the driver.
BUCKETS = 1 << 17
SMOOTHING = 1.0
LENGTH = 100
#: Words whose hash a task remembers.
MEMORY = 1 << 18


class Grams:
    """Buckets of a text's n-grams."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, codes = self.known, []
        if len(known) > MEMORY:
            known.clear()
        for word in (text or "").encode().split():  # splits at ASCII blanks only
            code = known.get(word)
            if code is None:
                known[word] = code = zlib.crc32(word) % BUCKETS
            codes.append(code)
        one = np.array(codes, dtype=np.int64)
        return np.concatenate([one, (one[:-1] * 31 + one[1:] * 17 + 7) % BUCKETS])


def models(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, n_all, n_good: counts over all rows and over trusted ones; at most BUCKETS rows.

    Each task adds up its own part of the corpus first.
    """
    trusted = good.select(F.col(id_col).alias("_id"), F.lit(True).alias("_good")).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(trusted.hint("merge"), "_id", "left").select("_text", "_good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1), strict=True):
                found = grams(text.as_py())
                np.add.at(sums[0], found, 1)
                if mark.as_py():
                    np.add.at(sums[1], found, 1)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], ["bucket", "n_all", "n_good"])

    parts = rows.mapInArrow(count, "bucket long, n_all long, n_good long")
    return parts.groupBy("bucket").agg(F.sum("n_all").alias("n_all"), F.sum("n_good").alias("n_good"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw probability by bucket: a table of fixed size."""
    sums = np.zeros((2, BUCKETS))
    for row in counts.collect():
        sums[:, row.bucket] = row.n_all, row.n_good
    share = np.log((sums + SMOOTHING) / (sums.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    return (share[1] - share[0]).astype(np.float32)


def weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight. A text without n-grams weighs 0."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1):
                g = grams(text.as_py())
                sizes.append(len(g))
                found.append(round(float(ratios[g].mean(dtype=np.float64)) * LENGTH, 6) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {dict(rows.dtypes)['doc_id']}, n_grams long, log_weight double")


def resample(docs: DataFrame, good: DataFrame, share: float, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight, kept; round(share * rows) rows are kept.

    Null text has no n-grams, weighs 0 and competes by its noise alone. Ties go to the smaller id;
    repeated rows share their noise and are taken one by one. Without any trusted row the target
    is uniform. An empty table gives no rows; extra columns aren't read.
    """
    ratios = log_ratios(models(docs, good, id_col, text_col))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)
    noisy = weights(docs, ratios, id_col, text_col).withColumn("_key", -(F.col("log_weight") - F.log(-F.log(uniform))))
    ranked = stored(numbered(noisy.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))), ["_key", "_id"], "_rank"))
    k = round(share * ranked.count())
    return ranked.select("doc_id", "n_grams", "log_weight", (F.col("_rank") < k).alias("kept"))


def good_share(labels: DataFrame) -> float:
    """Share of good rows among the labelled ones; 1 without labels."""
    n, n_good = labels.agg(F.count("quality"), F.count(F.when(F.col("quality") == 1, 1))).first()
    return n_good / n if n else 1.0


def op5(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    return resample(documents(spark, sf_dir), good, good_share(labels))
