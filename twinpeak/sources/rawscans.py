"""mzXML / mzML readers built on splittable text.

A raw file is read as text records separated by its scan start tag, so Spark splits large
files across tasks by byte range and no task ever holds a whole file. Attributes come out
with native expressions; only the binary peak payload goes through an Arrow function.
"""

from __future__ import annotations

import base64
import binascii
import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import duration_seconds, number
from ..session import durable, work_partitions

# XML attributes summarised for acquisition provenance.
ATTRIBUTES = ("msLevel", "collisionEnergy", "activationMethod", "windowWideness")
# Controlled-vocabulary accessions used by mzML.
CV = {
    "ms_level": "MS:1000511",
    "isolation_target": "MS:1000827",
    "selected_ion": "MS:1000744",
    "lower_offset": "MS:1000828",
    "upper_offset": "MS:1000829",
    "scan_time": "MS:1000016",
    "minute_unit": "UO:0000031",
    "mz_array": "MS:1000514",
    "intensity_array": "MS:1000515",
    "float64": "MS:1000523",
    "zlib": "MS:1000574",
}
NUMPRESS = ("MS:1002312", "MS:1002313", "MS:1002314")

DECODED = T.StructType(
    [
        T.StructField("mz", T.ArrayType(T.DoubleType())),
        T.StructField("it", T.ArrayType(T.DoubleType())),
        T.StructField("error", T.StringType()),
    ]
)


def _bytes(text: str, compressed: bool) -> bytes:
    payload = base64.b64decode("".join((text or "").split()), validate=True)
    return zlib.decompress(payload) if compressed else payload


def _floats(payload: bytes, wide: bool, big_endian: bool) -> np.ndarray:
    kind = (">" if big_endian else "<") + ("f8" if wide else "f4")
    return np.frombuffer(payload, dtype=kind).astype(float)


def _by_mz(mz: np.ndarray, it: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(mz) > 1 and (np.diff(mz) < 0).any():
        order = np.lexsort((it, mz))
        return mz[order], it[order]
    return mz, it


def _interleaved(text, precision, byte_order, compression):
    """One mzXML payload: m/z and intensity values in turn."""
    compression = (compression or "none").lower()
    if not "".join((text or "").split()):
        return np.empty(0), np.empty(0)
    if compression not in ("none", "zlib"):
        raise ValueError(f"unsupported peak compression: {compression}")
    precision = precision or "32"
    if precision not in ("32", "64"):
        raise ValueError(f"unsupported peak precision: {precision}")
    big = (byte_order or "network").lower() in ("network", "big", "big-endian")
    values = _floats(_bytes(text, compression == "zlib"), precision == "64", big)
    if len(values) % 2:
        raise ValueError("malformed peak array: odd number of values")
    return _by_mz(values[0::2], values[1::2])


def _rows(items) -> pd.DataFrame:
    out = {"mz": [], "it": [], "error": []}
    for build in items:
        try:
            mz, it = build()
            if len(mz) != len(it):
                raise ValueError("m/z and intensity arrays differ in length")
            error = None
        except (ValueError, binascii.Error, zlib.error) as exc:
            mz, it, error = [], [], f"{type(exc).__name__}: {exc}"
        out["mz"].append(mz)
        out["it"].append(it)
        out["error"].append(error)
    return pd.DataFrame(out)


def _decode_mzxml(text: pd.Series, precision: pd.Series, order: pd.Series, comp: pd.Series) -> pd.DataFrame:
    return _rows(
        [lambda a=a: _interleaved(*a) for a in zip(text, precision, order, comp)]
    )


def _decode_mzml(
    mz_text: pd.Series, mz_wide: pd.Series, mz_zip: pd.Series,
    it_text: pd.Series, it_wide: pd.Series, it_zip: pd.Series,
) -> pd.DataFrame:
    def one(mt, mw, mc, tt, tw, tc):
        return _by_mz(_floats(_bytes(mt, mc), mw, False), _floats(_bytes(tt, tc), tw, False))

    return _rows(
        [
            lambda a=a: one(*a)
            for a in zip(mz_text, mz_wide, mz_zip, it_text, it_wide, it_zip)
        ]
    )


# Marked non-deterministic so the decode stays one projection and is never duplicated.
decode_mzxml = F.pandas_udf(_decode_mzxml, DECODED).asNondeterministic()
decode_mzml = F.pandas_udf(_decode_mzml, DECODED).asNondeterministic()


def _attribute(text: Column, name: str) -> Column:
    value = F.regexp_extract(text, rf"(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.nullif(value, F.lit(""))


def _name(tag: str, prefix: str) -> str:
    return f"{prefix}:{tag}" if prefix else tag


def _file_text(spark: SparkSession, paths, tag: str, prefix: str) -> DataFrame:
    """(raw_id, value): a file's text from end tag to end tag, so that a file is many tasks."""
    rows = spark.read.option("lineSep", f"</{_name(tag, prefix)}>").text(paths)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]+$", 1)
    return rows.select(stem.alias("raw_id"), "value")


def _records(text: DataFrame, tag: str, prefix: str) -> DataFrame:
    """(raw_id, head, body): one row per element start tag, body up to the next start tag.

    Start tags may be followed by any white space; longer names are other elements.
    """
    starts = F.filter(F.split("value", rf"<{_name(tag, prefix)}(?=[\s/>])"), lambda _, i: i > 0)
    return text.select("raw_id", F.explode(starts).alias("body")).select(
        "raw_id", F.substring_index("body", ">", 1).alias("head"), "body"
    )


def _once(rows: DataFrame, *columns) -> DataFrame:
    """``rows.select(*columns)``, each worked out once a row.

    An outer generator, because a filter on a plain projection is pushed below it with a copy of
    every pattern that it reads.
    """
    return rows.select(F.inline_outer(F.array(F.struct(*columns))))


def read_mzxml(spark: SparkSession, paths, prefix: str = "") -> DataFrame:
    return mzxml_scans(_file_text(spark, paths, "scan", prefix), prefix)


def mzxml_scans(text: DataFrame, prefix: str = "") -> DataFrame:
    """All MS1 and MS2 scans of (raw_id, value) text, whatever their nesting, with decoded peaks.

    A row of text holds whole scans, at least up to their peaks.
    """
    p = r"<(?:[\w.-]+:)?"
    found = _once(
        _records(text, "scan", prefix),
        "raw_id",
        _attribute(F.col("head"), "msLevel").alias("ms_level"),
        _attribute(F.col("head"), "num").alias("scan_no"),
        F.coalesce(_attribute(F.col("head"), "retentionTime"), F.lit("")).alias("rt"),
        F.regexp_extract("body", p + r"precursorMz\b([^>]*)>", 1).alias("pre_head"),
        F.regexp_extract("body", p + r"precursorMz\b[^>]*>([^<]*)<", 1).alias("win"),
        F.regexp_extract("body", p + r"peaks\b([^>]*)>", 1).alias("peaks_head"),
        F.regexp_extract("body", p + r"peaks\b[^>/]*>([^<]*)<", 1).alias("payload"),
        F.col("body").rlike(p + r"peaks\b").alias("has_peaks"),
    )
    rows = _once(
        found,
        "raw_id",
        F.coalesce(F.col("ms_level").try_cast("int"), F.lit(0)).alias("ms_level"),
        F.col("scan_no").try_cast("int").alias("scan_no"),
        duration_seconds(F.col("rt")).alias("rt"),
        "pre_head",
        number(F.col("win")).alias("win"),
        "peaks_head",
        "payload",
        "has_peaks",
    )
    kept = rows.where(
        F.col("has_peaks")
        & F.col("rt").isNotNull()
        & ((F.col("ms_level") == 1) | ((F.col("ms_level") == 2) & F.col("win").isNotNull()))
    )
    peaks_head = F.col("peaks_head")
    decoded = kept.withColumn(
        "d",
        decode_mzxml(
            F.col("payload"),
            _attribute(peaks_head, "precision"),
            _attribute(peaks_head, "byteOrder"),
            _attribute(peaks_head, "compressionType"),
        ),
    )
    width = number(_attribute(F.col("pre_head"), "windowWideness"))
    half = F.when(width != 0, width / 2)
    return _finish(decoded, F.col("win") - half, F.col("win") + half)


def _tag_value(tags: Column, accession: str, attribute: str = "value") -> Column:
    hit = F.filter(tags, lambda t: F.contains(t, F.lit(f'"{accession}"')))
    return _attribute(F.try_element_at(hit, F.lit(1)), attribute)


def read_mzml(spark: SparkSession, paths, prefix: str = "") -> DataFrame:
    return mzml_scans(_file_text(spark, paths, "spectrum", prefix), prefix)


def mzml_scans(text: DataFrame, prefix: str = "") -> DataFrame:
    """MS1 and MS2 spectra of (raw_id, value) text; little-endian 32/64-bit arrays, zlib or plain."""
    pieces = _records(text, "spectrum", prefix).withColumn(
        "parts", F.split("body", r"<(?:[\w.-]+:)?binaryDataArray[\s>]")
    )
    cv = r"<(?:[\w.-]+:)?cvParam\s[^>]*>"
    tags = F.regexp_extract_all(F.element_at("parts", 1), F.lit(cv), F.lit(0))
    value = lambda name, attribute="value": _tag_value(F.col("tags"), CV[name], attribute)
    found = _once(
        _once(pieces, "raw_id", "head", "parts", tags.alias("tags")),
        "raw_id",
        value("ms_level").alias("ms_level"),
        _attribute(F.col("head"), "index").alias("scan_no"),
        value("scan_time").alias("rt"),
        value("scan_time", "unitAccession").alias("unit"),
        F.coalesce(value("isolation_target"), value("selected_ion")).alias("win"),
        value("lower_offset").alias("below"),
        value("upper_offset").alias("above"),
        F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("arrays"),
    )

    def array_of(kind):
        return F.try_element_at(
            F.filter("arrays", lambda a: F.contains(a, F.lit(f'"{CV[kind]}"'))), F.lit(-1)
        )

    rows = _once(
        found,
        "raw_id",
        F.col("ms_level").try_cast("int").alias("ms_level"),
        F.col("scan_no").try_cast("int").alias("scan_no"),
        (number(F.col("rt")) * F.when(F.col("unit") == CV["minute_unit"], 60.0).otherwise(1.0)).alias("rt"),
        *[number(F.col(n)).alias(n) for n in ("win", "below", "above")],
        array_of("mz_array").alias("mz_xml"),
        array_of("intensity_array").alias("it_xml"),
    )
    kept = rows.where(
        F.col("rt").isNotNull()
        & F.col("mz_xml").isNotNull()
        & F.col("it_xml").isNotNull()
        & ((F.col("ms_level") == 1) | ((F.col("ms_level") == 2) & F.col("win").isNotNull()))
    )

    def inputs(name):
        xml = F.col(name)
        packed = F.lit(False)
        for code in NUMPRESS:
            packed = packed | F.contains(xml, F.lit(f'"{code}"'))
        text = F.regexp_extract(xml, r"<(?:[\w.-]+:)?binary>([^<]*)<", 1)
        return (
            F.when(packed, F.lit("numpress-compressed arrays are not supported!")).otherwise(text),
            F.contains(xml, F.lit(f'"{CV["float64"]}"')),
            F.contains(xml, F.lit(f'"{CV["zlib"]}"')),
        )

    decoded = kept.withColumn("d", decode_mzml(*inputs("mz_xml"), *inputs("it_xml")))
    below, above = F.when(F.col("below") != 0, F.col("below")), F.when(F.col("above") != 0, F.col("above"))
    return _finish(decoded, F.col("win") - below, F.col("win") + above)


def _finish(decoded: DataFrame, iso_lo: Column, iso_hi: Column) -> DataFrame:
    second = F.col("ms_level") == 2
    return decoded.select(
        "raw_id",
        "ms_level",
        "scan_no",
        "rt",
        F.when(second, F.col("win")).alias("win"),
        F.when(second, iso_lo).alias("iso_lo"),
        F.when(second, iso_hi).alias("iso_hi"),
        F.zip_with(
            "d.mz", "d.it", lambda m, i: F.struct(m.alias("mz"), i.alias("it"))
        ).alias("peaks"),
        F.col("d.error").alias("error"),
    )


def read_raw(spark: SparkSession, paths: list[str], on_error: str = "fail", prefix: str = "") -> DataFrame:
    """Scans of any mix of mzXML and mzML files.

    ``on_error='fail'`` stops on the first bad payload; ``'record'`` keeps the row with
    its ``error`` text, so one bad file cannot hide the others.
    """
    frames = []
    for suffix, reader in ((".mzxml", read_mzxml), (".mzml", read_mzml)):
        mine = [p for p in paths if p.lower().endswith(suffix)]
        if mine:
            frames.append(reader(spark, mine, prefix))
    if not frames:
        raise ValueError("no .mzXML or .mzML file given")
    scans = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if on_error == "fail":
        bad = F.col("error").isNotNull()
        scans = scans.withColumn(
            "rt", F.when(bad, F.raise_error(F.col("error"))).otherwise(F.col("rt"))
        ).drop("error")
    elif on_error != "record":
        raise ValueError("on_error must be 'fail' or 'record'")
    return scans


def _numbered(scans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``scan``: places from 0 in each group's order, however many scans a group has.

    Range partitions are counted each on its own; what lies before one is a sum over the partitions
    that hold a part of the group. Equal keys share a partition.
    """
    # Cut twice: drawing the ranges reads the scans, and the parts must be the same in every pass.
    ranged = durable(scans).repartitionByRange(work_partitions(scans.sparkSession), *by, *order)
    ranged = durable(ranged.withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    keys = [F.col(f"s.{b}").eqNullSafe(F.col(f"r.{b}")) for b in (*by, "_part")]
    starts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    starts = starts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).alias("s")
    place = F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)) - 1
    placed = ranged.withColumn("_place", place).alias("r").join(starts, functools.reduce(Column.__and__, keys))
    return placed.select(*[F.col(f"r.{c}") for c in scans.columns], (F.col("_start") + F.col("_place")).cast("int").alias("scan"))


def ms2_scans(scans: DataFrame) -> DataFrame:
    """MS2 scans numbered from 0 by RT inside each isolation window."""
    return _numbered(scans.where("ms_level = 2"), ["raw_id", "win"], ["rt", "scan_no"])


def ms1_scans(scans: DataFrame) -> DataFrame:
    """MS1 scans numbered from 0 in acquisition order."""
    return _numbered(scans.where("ms_level = 1"), ["raw_id"], ["scan_no", "rt"])


def store_scans(scans: DataFrame, path: str) -> None:
    """Parquet layout the plans read fast: split by level, clustered by raw and window."""
    (
        scans.repartition("raw_id", "win")
        .sortWithinPartitions("raw_id", "win", "rt")
        .write.mode("overwrite")
        .partitionBy("ms_level")
        .parquet(path)
    )


def attribute_histogram(text: DataFrame, keys=ATTRIBUTES) -> DataFrame:
    """(raw_id, key, value, rows) for ``key="value"`` pairs found in text rows."""
    pattern = rf"\b(?:{'|'.join(keys)})=\"[^\"]+\""
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    pairs = text.select("raw_id", F.explode_outer(found).alias("pair")).where("pair IS NOT NULL")
    return (
        pairs.groupBy(
            "raw_id",
            F.substring_index("pair", "=", 1).alias("key"),
            F.regexp_extract("pair", "\"([^\"]+)\"", 1).alias("value"),
        )
        .agg(F.count("*").alias("rows"))
    )


def acquisition_attributes(spark: SparkSession, paths) -> DataFrame:
    """Attribute histogram of raw files, read tag by tag without decoding peaks."""
    rows = spark.read.option("lineSep", ">").text(paths)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]+$", 1)
    return attribute_histogram(rows.select(stem.alias("raw_id"), "value"))
