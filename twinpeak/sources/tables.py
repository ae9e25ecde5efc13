"""Text tables, manifests and directory listings."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..session import durable


def read_table(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """CSV with every cell as text, NULL cells as '', a ``row_no`` from 0, blank rows dropped.

    Spreadsheet files need an optional reader that is not part of a Spark installation.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        return _read_spreadsheet(spark, path, keep_blank)
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8"
    )
    return _clean(raw, keep_blank)


def _clean(raw: DataFrame, keep_blank: bool) -> DataFrame:
    cells = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns])
    filled = F.lit(True) if keep_blank else F.exists(cells, lambda v: F.trim(v) != "")
    named = [c for c in raw.columns if not c.startswith("_c")]
    cleaned = raw.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named],
        filled.alias("_filled"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    # Cut: the blank-row test names every column, and on a wide table the optimizer would
    # derive a combinatorial number of constraints from it. It also fixes the row numbers.
    return _densely_numbered(durable(cleaned)).where("_filled").drop("_filled")


def _densely_numbered(rows: DataFrame) -> DataFrame:
    """Turn (partition, place) numbers into 0, 1, 2 ... in file order.

    Only one count per partition is gathered for the offsets.
    """
    part = F.shiftright("row_no", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("row_no").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("row_no", F.col("_start") + place).drop("_part", "_start")


def _read_spreadsheet(spark: SparkSession, path: str, keep_blank: bool) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as exc:
        raise RuntimeError("reading .xlsx needs the optional openpyxl package; use CSV") from exc
    import pandas as pd

    frame = pd.read_excel(path, dtype=str).fillna("")
    return _clean(spark.createDataFrame(frame), keep_blank)


def resolve_column(df: DataFrame, wanted: str) -> str:
    """Exact header first, then case-insensitive."""
    if wanted in df.columns:
        return wanted
    for name in df.columns:
        if name.lower() == wanted.lower():
            return name
    raise ValueError(f"table is missing required column: {wanted}")


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"table is missing required column(s): {', '.join(missing)}")


def source_struct(table: DataFrame) -> Column:
    """The untouched text cells as one struct, so typed names cannot clash with headers."""
    return F.struct(*[F.col(f"`{c}`") for c in table.columns if c != "row_no"]).alias("source")


def to_targets(
    table: DataFrame, raw_id: str, mz: str = "MZ", peak_a: str = "Peak1", peak_b: str = "Peak2"
) -> DataFrame:
    """Typed target rows (row_id, raw_id, mz, peak_a_rt, peak_b_rt) beside their ``source``."""
    columns = {"mz": mz, "peak_a_rt": peak_a, "peak_b_rt": peak_b}
    typed = {k: number(F.col(f"`{resolve_column(table, v)}`")) for k, v in columns.items()}
    return table.select(
        F.col("row_no").alias("row_id"),
        F.lit(raw_id).alias("raw_id"),
        *[c.alias(k) for k, c in typed.items()],
        source_struct(table),
    )


def expand_source(df: DataFrame) -> DataFrame:
    """Source columns first, then results; a result replaces a source column of its name."""
    others = [c for c in df.columns if c != "source"]
    taken = {c.lower() for c in others}
    names = [n for n in df.schema["source"].dataType.names if n.lower() not in taken]
    return df.select(*[F.col(f"source.`{n}`").alias(n) for n in names], *[F.col(c) for c in others])


def peak_files(folder: str) -> list[str]:
    return _listing(folder, (".csv", ".xlsx"))


def raw_files(folder: str) -> list[str]:
    return _listing(folder, (".mzml", ".mzxml"))


def _listing(folder: str, suffixes: tuple[str, ...]) -> list[str]:
    if not os.path.isdir(folder):
        return []
    names = sorted(n for n in os.listdir(folder) if n.lower().endswith(suffixes))
    return [os.path.join(folder, n) for n in names]


def match_by_token(keys: DataFrame, raws: DataFrame, key: str = "key") -> DataFrame:
    """(key, raw_id) where the key text is part of the raw stem, ignoring case.

    Every key must match exactly one raw file; both inputs are file listings.
    """
    hit = F.contains(F.lower(F.col("raw_id")), F.lower(F.col(key)))
    joined = keys.join(F.broadcast(raws.select("raw_id")), hit, "left")
    grouped = joined.groupBy(key).agg(
        F.count("raw_id").alias("n"), F.min("raw_id").alias("raw_id")
    )
    message = F.concat(
        F.lit("expected exactly one raw file for "), F.col(key), F.lit("; found "), F.col("n")
    )
    return grouped.select(
        key, F.when(F.col("n") == 1, F.col("raw_id")).otherwise(F.raise_error(message)).alias("raw_id")
    )


def match_raw_file(stem: str, raws: list[str]) -> str | None:
    """Raw file for a peak table: same stem inside the name, else a shared well token."""
    import re

    def stem_of(path):
        return os.path.splitext(os.path.basename(path))[0]

    hits = [r for r in raws if stem in stem_of(r)]
    if not hits:
        tokens = re.findall(r"[A-Za-z]\d{2,}", stem)
        hits = [r for r in raws if any(t in stem_of(r) for t in tokens)]
    if len(hits) > 1:
        raise ValueError(f"more than one raw file matches {stem}")
    return hits[0] if hits else None


# Columns every batch manifest must have.
MANIFEST_COLUMNS = ("sample_id", "mode", "peaklist", "raw", "output")


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Manifest rows with paths resolved against the manifest's own folder."""
    df = read_table(spark, path)
    require_columns(df, MANIFEST_COLUMNS)
    base = os.path.dirname(os.path.abspath(path))
    rows = [r.asDict() for r in df.orderBy("row_no").collect()]
    for row in rows:
        for name in ("peaklist", "raw", "output", "peak_config_json"):
            if row.get(name):
                row[name] = os.path.normpath(os.path.join(base, row[name]))
    if not rows:
        raise ValueError("batch manifest is empty")
    return rows


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)
