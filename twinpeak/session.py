"""Session helpers: settings a job wants, shipping the package, and durable cut points."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app: str = "twinpeak", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """What every session needs once: the package on its workers, and a shared folder.

    A local session that names no folder gets one; a cluster must name its own.
    """
    context = spark.sparkContext
    if not getattr(context, "_twinpeak_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="twinpeak-ship-"), "twinpeak.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("twinpeak", os.path.relpath(full, PACKAGE)))
        context.addPyFile(archive)
        context._twinpeak_shipped = True
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.master.split("[")[0] == "local":
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="twinpeak-shared-"))
    return spark


def work_partitions(spark: SparkSession) -> int:
    """Partition count for exchanges that feed CPU-heavy array work.

    Passed explicitly, because by-size coalescing would pack such rows into few tasks.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan over the cluster when it has fewer splits than work partitions.

    A scan that already has enough splits is returned as it is, without a shuffle.
    """
    wanted = work_partitions(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, which the session must name."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
