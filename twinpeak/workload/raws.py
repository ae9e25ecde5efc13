"""Raw-file queries: XML text written from `lineitem`, read back by the scan readers.

An order is a scan and its lines are the peaks. Scans vary in level, window, precision, byte
order, compression, time unit and white space, so that every branch of the readers has rows; the
SQL states the same scans straight from the table.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_partitions
from ..sources import projections as proj
from ..sources import rawscans

#: Scans in a row of text.
CHUNK = 32


@F.pandas_udf(T.StringType())
def encoded(values: pd.Series, wide: pd.Series, big: pd.Series, packed: pd.Series) -> pd.Series:
    """Base64 text of float arrays."""

    def one(v, w, b, z):
        raw = np.asarray(v, dtype=float).astype((">" if b else "<") + ("f8" if w else "f4")).tobytes()
        return base64.b64encode(zlib.compress(raw) if z else raw).decode()

    return pd.Series([one(*a) for a in zip(values, wide, big, packed, strict=True)])


def _scans(spark, d) -> DataFrame:
    """One row per order: k, its sorted peaks, and how the scan is written.

    Lines are dealt by the chunk that their scan goes to, so that no later step moves them again.
    """
    k, chunk = F.col("l_orderkey").alias("k"), F.floor(F.col("l_orderkey") / CHUNK).alias("chunk")
    line = proj.table(spark, d, "lineitem").select(k, chunk, "l_partkey", "l_linenumber", "l_quantity")
    line = line.repartition(work_partitions(spark), "chunk")
    mz = 100.0 + F.col("l_partkey") % 1500 + F.col("l_linenumber") / 8.0
    peaks = F.sort_array(F.collect_list(F.struct(mz.alias("mz"), F.col("l_quantity").cast("double").alias("it"))))
    k = F.col("k")
    return line.groupBy("chunk", "k").agg(peaks.alias("peaks")).select(
        "chunk", "k", "peaks", (k % 3 != 0).alias("wide"), (k % 5 < 2).alias("packed"),
        F.when(k % 4 == 0, 1).otherwise(2).alias("level"), (300.0 + 10.0 * (k % 7)).alias("win"),
    )


def _texts(scans: DataFrame, scan: Column) -> DataFrame:
    """Scans joined to rows of CHUNK scans each: a fixed number of items a list."""
    numbered = scans.select("chunk", F.struct("k", scan.alias("xml")).alias("s"))
    joined = F.array_join(F.sort_array(F.collect_list("s"))["xml"], "\n")
    return numbered.groupBy("chunk").agg(joined.alias("value")).select(F.lit("run").alias("raw_id"), "value")


def _xml(template: str, **parts: Column) -> Column:
    """A template whose {names} are columns."""
    pieces, out = template.split("{"), []
    for i, piece in enumerate(pieces):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        out += ([parts[name].cast("string")] if name else []) + [F.lit(rest)]
    return F.concat(*out)


def _peak_rows(scans: DataFrame) -> DataFrame:
    return scans.select("scan_no", "ms_level", "rt", "win", "iso_lo", "iso_hi", F.explode("peaks").alias("p")).select(
        F.col("scan_no").cast("bigint").alias("scan_no"), "ms_level", "rt", "win", "iso_lo", "iso_hi", "p.mz", "p.it"
    )


def mzxml_text(spark, d) -> DataFrame:
    k, flat = F.col("k"), F.flatten(F.transform("peaks", lambda p: F.array(p["mz"], p["it"])))
    scan = _xml(
        """<scan{blank}num="{k}" msLevel="{level}" retentionTime="PT{rt}S">{window}<peaks precision="{bits}" byteOrder="network" compressionType="{kind}">{body}</peaks></scan>""",
        blank=F.element_at(F.array(F.lit(" "), F.lit("\n"), F.lit("\t")), (k % 3 + 1).cast("int")),
        k=k, level=F.col("level"), rt=k % 600 + 0.25, bits=F.when(F.col("wide"), 64).otherwise(32),
        window=F.when(F.col("level") == 2, _xml("""<precursorMz windowWideness="20.0">{win}</precursorMz>""", win=F.col("win"))).otherwise(""),
        kind=F.when(F.col("packed"), "zlib").otherwise("none"), body=F.col("body"),
    )
    return _texts(_scans(spark, d).withColumn("body", encoded(flat, "wide", F.lit(True), "packed")), scan)


def mzxml_scans(spark, d):
    return _peak_rows(rawscans.mzxml_scans(mzxml_text(spark, d)))


def mzml_text(spark, d) -> DataFrame:
    k = F.col("k")
    rows = _scans(spark, d)
    for name in ("mz", "it"):
        rows = rows.withColumn(f"{name}_body", encoded(F.col(f"peaks.{name}"), "wide", F.lit(False), "packed"))
    cv = lambda code, more="": f"""<cvParam cvRef="MS" accession="{rawscans.CV[code]}"{more}/>"""
    shape = F.concat(F.when(F.col("wide"), cv("float64")).otherwise(""), F.when(F.col("packed"), cv("zlib")).otherwise(""))
    array = lambda kind, body: _xml(
        "<binaryDataArray>{shape}" + cv(kind) + "<binary>{body}</binary></binaryDataArray>", shape=shape, body=F.col(body)
    )
    minutes = k % 2 == 1
    spectrum = _xml(
        "<spectrum index=\"{k}\">" + cv("ms_level", ' value="{level}"') + "{time}{window}<binaryDataArrayList>{a}{b}</binaryDataArrayList></spectrum>",
        k=k, level=F.col("level"),
        time=F.when(minutes, _xml(cv("scan_time", ' value="{v}" unitAccession="UO:0000031"'), v=(k % 600) * 0.5)).otherwise(
            _xml(cv("scan_time", ' value="{v}" unitAccession="UO:0000010"'), v=k % 600 + 0.25)),
        window=F.when(F.col("level") == 2, _xml(
            cv("isolation_target", ' value="{win}"') + cv("lower_offset", ' value="10.0"') + cv("upper_offset", ' value="10.0"'), win=F.col("win"),
        )).otherwise(""),
        a=array("mz_array", "mz_body"), b=array("intensity_array", "it_body"),
    )
    return _texts(rows, spectrum)


def mzml_scans(spark, d):
    return _peak_rows(rawscans.mzml_scans(mzml_text(spark, d)))


def ms1_scans(spark, d):
    scans = rawscans.ms1_scans(rawscans.mzxml_scans(mzxml_text(spark, d)))
    return scans.select("scan", F.col("scan_no").cast("bigint").alias("scan_no"), "rt", F.size("peaks").alias("n_peaks"))


def _rows_sql(rt: str) -> str:
    return f"""
WITH p AS (SELECT l_orderkey AS k, 100.0::DOUBLE + l_partkey % 1500 + l_linenumber / 8.0::DOUBLE AS mz, l_quantity::DOUBLE AS it FROM lineitem)
SELECT k AS scan_no, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS ms_level, {rt} AS rt,
       CASE WHEN k % 4 <> 0 THEN 300.0::DOUBLE + 10 * (k % 7) END AS win,
       CASE WHEN k % 4 <> 0 THEN 290.0::DOUBLE + 10 * (k % 7) END AS iso_lo, CASE WHEN k % 4 <> 0 THEN 310.0::DOUBLE + 10 * (k % 7) END AS iso_hi,
       CASE WHEN k % 3 = 0 THEN mz::FLOAT::DOUBLE ELSE mz END AS mz, CASE WHEN k % 3 = 0 THEN it::FLOAT::DOUBLE ELSE it END AS it
FROM p"""


SECONDS = "(k % 600 + 0.25)::DOUBLE"
MS1_SQL = f"""
SELECT row_number() OVER (ORDER BY k) - 1 AS scan, k AS scan_no, {SECONDS} AS rt, n AS n_peaks
FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE k % 4 = 0"""

QUERIES = {
    "mzxml_scans": (mzxml_scans, _rows_sql(SECONDS)),
    "mzml_scans": (mzml_scans, _rows_sql(f"CASE WHEN k % 2 = 1 THEN (k % 600) * 30.0::DOUBLE ELSE {SECONDS} END")),
    "ms1_scans": (ms1_scans, MS1_SQL),
}
