"""Table, sidecar, drawing and archive sinks."""

from __future__ import annotations

import hashlib
import html
import json
import os
import platform
import zipfile
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import text_g6
from .functions.spectra import similarity
from .params import ExtractionSettings, PairThresholds

FINGERPRINT = "path string, size bigint, sha256 string"
# Parameters that every run records alike.
RUN_CONSTANTS = {
    "mz_column": "MZ",
    "peak_a_column": "Peak1",
    "peak_b_column": "Peak2",
    "mz_tol_legacy_scope": "shared precursor and fragment EIC default",
}


def as_text_table(df: DataFrame, skip=("row_id", "raw_id")) -> DataFrame:
    """Every cell as text the way a result table is exchanged: six digits, '' for NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in skip:
            continue
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = text_g6(c.cast("double"))
        elif isinstance(field.dataType, T.ArrayType):
            c = F.concat_ws(";", c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(field.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """CSV part files with header; distributed, so no task sees the whole table."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("emptyValue", "").csv(path)


def write_json(payload: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        json.dump(payload, handle, indent=2, ensure_ascii=False)


def file_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Size and SHA-256 of files, hashed in parallel by streaming reads inside tasks."""
    def hashed(batches):
        import pyarrow.fs as pafs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                full = path if "://" in path else "file://" + os.path.abspath(path)
                system, inner = pafs.FileSystem.from_uri(full)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(1 << 20):
                        digest.update(chunk)
                        size += len(chunk)
                rows.append((path, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInPandas(hashed, FINGERPRINT)


STATUS_COLUMNS = {
    "status_counts": "enantiomer_pair_status",
    "ms2_diagnostic_status_counts": "ms2_diagnostic_status",
    "ms1_reference_status_counts": "ms1_reference_status",
}


def status_counts(results: DataFrame) -> dict:
    """Histograms of the status columns (a fixed vocabulary) from one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in STATUS_COLUMNS.items()])
    rows = results.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").count().collect()
    return {n: {r.value: r["count"] for r in rows if r.name == n} for n in STATUS_COLUMNS}


def run_sidecar(
    results: DataFrame, windows: DataFrame, settings: ExtractionSettings,
    thresholds: PairThresholds, attributes: DataFrame | None = None, method: dict | None = None,
    inputs: DataFrame | None = None, elapsed_seconds: float = 0.0,
) -> dict:
    """What a run did, as flat facts: counts, parameters, windows, raw attributes, input files.

    Tables that grow with the input (attribute values, windows) stay tables; only their sums are
    kept here.
    """
    if method is not None and not method.get("profile_id"):
        raise ValueError("method profile must define profile_id")
    extraction = settings.as_dict()
    parameters = {
        **extraction, **thresholds.__dict__, **RUN_CONSTANTS, "dia_iso_win_fallback": extraction.pop("dia_iso_win"),
    }
    parameters.pop("dia_iso_win")
    known = F.col("iso_lo").isNotNull() & F.col("iso_hi").isNotNull()
    bounds = windows.agg(
        F.count_if(known).alias("with_raw_bounds"), F.count_if(~known).alias("with_fallback_width"),
        F.min("iso_lo").alias("lower"), F.max("iso_hi").alias("upper"),
    ).first()
    counts = status_counts(results)
    return {
        "schema_version": "twinpeak-run-v2",
        "created_utc": datetime.now(UTC).isoformat(),
        "python": platform.python_version(),
        "elapsed_seconds": elapsed_seconds,
        "rows_processed": sum(counts["status_counts"].values()),
        **counts,
        "parameters": parameters,
        "method": method or {},
        "windows": bounds.asDict(),
        "raw": {} if attributes is None else raw_context(attributes),
        "inputs": [] if inputs is None else [r.asDict() for r in inputs.collect()],
    }


def raw_context(attributes: DataFrame) -> dict:
    """Per attribute key: rows, distinct values, and the value where there is one only.

    Keys are a fixed list, so this is a few rows however many values a file holds.
    """
    rows = attributes.groupBy("key").agg(
        F.sum("rows").alias("rows"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("value"),
        F.sum(F.when((F.col("key") == "msLevel") & (F.col("value") == "1"), F.col("rows")).otherwise(0)).alias("ms1"),
        F.sum(F.when((F.col("key") == "msLevel") & (F.col("value") == "2"), F.col("rows")).otherwise(0)).alias("ms2"),
    ).collect()
    found = {r.key: {"rows": r["rows"], "distinct_values": r.distinct_values} for r in rows}
    for r in rows:
        if r.distinct_values == 1:
            found[r.key]["value"] = r.value
    ms1, ms2 = sum(r.ms1 for r in rows), sum(r.ms2 for r in rows)
    return {"attributes": found, "scan_counts": {"ms1": ms1, "ms2": ms2}, "ms2_per_ms1": ms2 / ms1 if ms1 else None}


# ---- drawings ------------------------------------------------------------------------


def _bars(peaks, matched, top, scale_x, base, sign, colour):
    lines = []
    for i, p in enumerate(peaks):
        x, h = scale_x(p["mz"]), 90 * p["it"] / top
        stroke = colour if i in matched else "#9aa4b2"
        lines.append(
            f'<line x1="{x:.1f}" y1="{base}" x2="{x:.1f}" y2="{base - sign * h:.1f}" stroke="{stroke}"/>'
        )
    return "".join(lines)


def _mirror(title: str, a, b, matches) -> str:
    """Mirror spectrum: first side up, second down, matched peaks coloured."""
    peaks = [*a, *b]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 240"><title>{html.escape(title)}</title>'
    if not peaks:
        return head + '<text x="20" y="120">no spectrum</text></svg>'
    lo, hi = min(p["mz"] for p in peaks), max(p["mz"] for p in peaks)
    span = (hi - lo) or 1.0

    def scale_x(mz):
        return 40 + 560 * (mz - lo) / span

    ia, ib = {m["i"] for m in matches}, {m["j"] for m in matches}
    body = '<line x1="40" y1="120" x2="600" y2="120" stroke="#172033"/>'
    if len(a):
        body += _bars(a, ia, max(p["it"] for p in a), scale_x, 120, 1, "#2563eb")
    if len(b):
        body += _bars(b, ib, max(p["it"] for p in b), scale_x, 120, -1, "#ea580c")
    return head + body + f'<text x="40" y="16">{html.escape(title)}</text></svg>'


@F.pandas_udf(T.StringType())
def _mirror_svg(title: pd.Series, a: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([_mirror(*row) for row in zip(title, a, b, m)])


def mirror_svg(df: DataFrame, title: Column, a: Column, b: Column, out: str = "svg") -> DataFrame:
    """Add a mirror-spectrum drawing that uses exactly the scored alignment."""
    sim = df.withColumn("_sim", similarity(a, b))
    return sim.withColumn(
        out, _mirror_svg(title, F.col("_sim.peaks_a"), F.col("_sim.peaks_b"), F.col("_sim.matches"))
    ).drop("_sim")


def _trace(title: str, rts, y, marks) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 240"><title>{html.escape(title)}</title>'
    if rts is None or len(rts) < 2:
        return head + '<text x="20" y="120">no trace</text></svg>'
    top, lo, span = max(max(y), 1e-9), rts[0], (rts[-1] - rts[0]) or 1.0
    points = " ".join(
        f"{40 + 560 * (t - lo) / span:.1f},{220 - 200 * v / top:.1f}" for t, v in zip(rts, y)
    )
    ticks = "".join(
        f'<line x1="{40 + 560 * (t - lo) / span:.1f}" x2="{40 + 560 * (t - lo) / span:.1f}" y1="20" y2="220" stroke="#ea580c"/>'
        for t in (marks if marks is not None else [])
    )
    return head + f'{ticks}<polyline fill="none" stroke="#2563eb" points="{points}"/></svg>'


@F.pandas_udf(T.StringType())
def trace_svg(title: pd.Series, rts: pd.Series, y: pd.Series, marks: pd.Series) -> pd.Series:
    """EIC drawing with vertical marks at peak RTs (seconds)."""
    return pd.Series([_trace(*row) for row in zip(title, rts, y, marks)])


def write_gallery(cards: DataFrame, path: str, partition: str) -> None:
    """One text part per task, one HTML card per line, split by ``partition``."""
    cards.select(partition, "card").write.mode("overwrite").partitionBy(partition).text(path)


@F.pandas_udf(T.StringType())
def escape_html(values: pd.Series) -> pd.Series:
    return values.fillna("").map(html.escape)


# ---- archive -------------------------------------------------------------------------


def package_directory(folder: str, archive: str) -> dict:
    """Deterministic ZIP: sorted entries, fixed timestamps, hash list, CRC check, rename.

    Packs a finished review folder of drawings and summaries, not bulk tables.
    """
    entries = []
    for base, _, names in os.walk(folder):
        for name in names:
            full = os.path.join(base, name)
            entries.append((os.path.relpath(full, folder).replace(os.sep, "/"), full))
    entries.sort()
    for name, _ in entries:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"unsafe archive path: {name}")
    os.makedirs(os.path.dirname(os.path.abspath(archive)), exist_ok=True)
    temporary, hashes = archive + ".tmp", []

    def add(handle, name, data):
        info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        handle.writestr(info, data)

    with zipfile.ZipFile(temporary, "w") as handle:
        for name, full in entries:
            with open(full, "rb") as source:
                data = source.read()
            hashes.append(f"{hashlib.sha256(data).hexdigest()}  {name}")
            add(handle, name, data)
        add(handle, "SHA256SUMS", ("\n".join(hashes) + "\n").encode())
    with zipfile.ZipFile(temporary) as handle:
        if handle.testzip() is not None or len(handle.namelist()) != len(entries) + 1:
            raise ValueError("archive verification failed")
    os.replace(temporary, archive)
    return {"archive": archive, "entries": len(entries), "hashes": hashes}
