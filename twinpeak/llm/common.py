"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a missing doc_id in join keys; keys always hold a fingerprint of the text too.
NO_ID = -(2**63)
#: A key is hot when it holds at least one row in so many; so there are at most as many hot keys.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local-mode session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of the tables that the step under way has stored, if it is one of `settled`.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, so lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, stored; then the tables that it stored on the way are deleted, and the
    driver's heap is swept, which frees the shuffle files behind them.

    Nothing else may read those tables. The result is a table of its own, so a lost executor never
    asks for them again.
    """
    inner: list[str] = []
    token = _passing.set(inner)
    try:
        found = make()
    finally:
        _passing.reset(token)
    found = stored(found)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, inner):
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def carried(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows packed into _doc, beside key columns whose names can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[e.alias(k) for k, e in keys.items()])


def let(value: Column, body) -> Column:
    """Bind an array expression once for a lambda that reads it many times."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def work_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the order of `order` (unique rows): range sort, then offsets.

    The range partitions are stored first, so both readers see the same ones. A window task
    holds one range partition; the offsets are one row per partition.
    """
    spark = df.sparkSession
    ranged = stored(df.repartitionByRange(work_partitions(spark), *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_part", "_start")
    )


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding at least 1/HOT_SHARE of the rows: at most HOT_SHARE rows, safe to broadcast."""
    counts = stored(df.groupBy(key).count())
    floor = max(2, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_SHARE)
    return counts.filter(F.col("count") >= floor).select(key, F.lit(True).alias("_hot"))
