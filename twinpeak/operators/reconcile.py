"""Consistency of a review package: four tables about the same targets, reconciled in one pass.

Result, queue, manifest and label rows are united with a bit for their table and grouped by target
once. Which tables hold the target, how often, and the smallest and largest fingerprint of the fields
that two tables share are sums and minima, so a target with any number of rows needs no list; every
violation is read off them. Places in the queue are compared with dense numbers of the result's
disagreements. Rows without a target id are counted before the grouping and never meet in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .ordered import dense_numbers
from .shadow import ML_FIELDS, ML_STATUSES

RESULT, QUEUE, MANIFEST, LABELS = 1, 2, 4, 8
NAMES = {RESULT: "result", QUEUE: "queue", MANIFEST: "manifest", LABELS: "labels"}
# What a queue row adds to its result row, and what a reviewer fills in.
COMPARISON_FIELDS = (
    "comparison_change_level", "comparison_baseline_status", "comparison_v2_normalized_status",
    "comparison_candidate_status", "comparison_review_tier", "comparison_review_flags",
)
MANUAL_FIELDS = (
    "reviewer_id", "manual_ms2_identity_label", "confidence", "peak1_spectrum_quality", "peak2_spectrum_quality",
    "manual_issue_codes", "diagnostic_fragment_notes", "notes", "reviewed_utc",
)
STATUS = "ms2_diagnostic_status"


def text(value: Column) -> Column:
    """A cell as a table holds it: NULL is empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def fingerprint(cells: list[Column]) -> Column:
    """One digest of texts; each goes with its length, so cells can't run into one another."""
    return F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cells]), 256)


def _cells(names) -> list[Column]:
    return [text(F.col(f"`{n}`")) for n in names]


def comparison_cells() -> list[Column]:
    """The comparison fields recomputed from a result row."""
    v2, ml = F.trim(text(F.col(STATUS))), F.trim(text(F.col("ml_diagnostic_status")))
    return [
        F.lit("v2_ml_status"), v2, F.when(v2 == "not_attempted", "not_evaluable").otherwise(v2), ml,
        F.lit("v2_ml_disagreement"), text(F.col("ml_review_flags")),
    ]


def _part(df: DataFrame, bit: int, **given: Column) -> DataFrame:
    """The common columns of one table's rows; what the table doesn't have is NULL."""
    nothing = {
        "at": F.lit(None).cast("long"), "fields": F.lit(None).cast("string"), "comparison": F.lit(None).cast("string"),
        "identity": F.lit(None).cast("string"), "artifact": F.lit(None).cast("string"), "odd": F.lit(0),
        "wanted": F.lit(False),
    }
    columns = nothing | given
    return df.select(F.trim(text(F.col("target_uid"))).alias("target_uid"), F.lit(bit).alias("bit"), *[c.alias(n) for n, c in columns.items()])


def package_violations(
    result: DataFrame, queue: DataFrame, manifest: DataFrame, labels: DataFrame,
    order: str = "row_order", compound: str = "Compound_ID",
) -> DataFrame:
    """(kind, target_uid, rows) of every violation; a consistent package has none.

    The queue must be the result's disagreements in result order with recomputed comparison fields;
    manifest and labels must list the queue's targets in its order, with the same compound, statuses
    and artifact digest; no target may occur twice; labels must not be filled in. ``queue_row``,
    ``source_row`` and ``label_row`` are places in those tables, from 1. ``order`` orders the result.
    """
    shared = [c for c in result.columns if c not in ("target_uid", order)]
    identity = [compound, STATUS, *ML_FIELDS]
    v2, ml = F.trim(text(F.col(STATUS))), F.trim(text(F.col("ml_diagnostic_status")))
    differs = rules.comparison_status(F.col(STATUS)) != text(F.col("ml_diagnostic_status"))
    judged = result.withColumn("_differs", differs)
    invalid = F.when(~v2.isin(*rules.DIAGNOSTIC_STATUSES), 1).otherwise(0) + F.when(~ml.isin(*ML_STATUSES), 2).otherwise(0)
    placed = dense_numbers(
        judged.where("_differs").select(F.trim(text(F.col("target_uid"))).alias("target_uid"), order), [order, "target_uid"], "n"
    )
    parts = [
        _part(judged, RESULT, fields=fingerprint(_cells(shared)), comparison=fingerprint(comparison_cells()), wanted=F.col("_differs"), odd=invalid),
        _part(placed, 0, at=F.col("n") + 1),
        _part(queue, QUEUE, at=F.col("queue_row").cast("long"), fields=fingerprint(_cells(shared)),
              comparison=fingerprint(_cells(COMPARISON_FIELDS)), identity=fingerprint(_cells(identity))),
        _part(manifest, MANIFEST, at=F.col("source_row").cast("long"), identity=fingerprint(_cells(["compound_id", *identity[1:]])),
              artifact=text(F.col("artifact_sha256"))),
        _part(labels, LABELS, at=F.col("label_row").cast("long"), artifact=text(F.col("artifact_sha256")),
              odd=F.when(F.trim(F.concat(*_cells(MANUAL_FIELDS))) != "", 1).otherwise(0)),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _blank_targets(rows).unionByName(_target_violations(rows.where("target_uid != ''")))


def _blank_targets(rows: DataFrame) -> DataFrame:
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("bit")]
    blank = rows.where("target_uid = '' AND bit > 0").groupBy("bit").agg(F.count("*").alias("rows"))
    return blank.select(F.concat(F.lit("blank_target_"), name).alias("kind"), F.lit("").alias("target_uid"), "rows")


def _target_violations(rows: DataFrame) -> DataFrame:
    of = lambda bit, value: F.when(F.col("bit") == bit, value)
    aggregates = [F.max("wanted").alias("wanted")]
    for bit, name in NAMES.items():
        aggregates += [
            F.count_if(F.col("bit") == bit).alias(f"n_{name}"),
            F.min(of(bit, F.col("at"))).alias(f"at_{name}"),
            F.max(of(bit, F.col("at"))).alias(f"to_{name}"),
        ]
        for column in ("fields", "comparison", "identity", "artifact"):
            aggregates += [F.min(of(bit, F.col(column))).alias(f"{column}_{name}"), F.max(of(bit, F.col(column))).alias(f"{column}_{name}_most")]
    aggregates += [
        F.min(of(0, F.col("at"))).alias("at_wanted"),
        F.count_if((F.col("bit") == RESULT) & (F.col("odd") % 2 == 1)).alias("odd_v2"),
        F.count_if((F.col("bit") == RESULT) & (F.col("odd") >= 2)).alias("odd_ml"),
        F.count_if((F.col("bit") == LABELS) & (F.col("odd") == 1)).alias("filled"),
    ]
    n = {name: F.col(f"n_{name}") for name in NAMES.values()}

    def both(a, b):
        return (n[a] > 0) & (n[b] > 0)

    def unequal(column, a, b):
        """Some row of one table has another fingerprint than some row of the other."""
        return both(a, b) & ~(
            (F.col(f"{column}_{a}") == F.col(f"{column}_{b}")) & (F.col(f"{column}_{a}_most") == F.col(f"{column}_{b}_most"))
            & (F.col(f"{column}_{a}") == F.col(f"{column}_{a}_most"))
        )

    def elsewhere(a, b):
        return both(a, b) & ~(F.col(f"at_{a}").eqNullSafe(F.col(f"at_{b}")) & F.col(f"to_{a}").eqNullSafe(F.col(f"to_{b}")))

    wanted = F.col("wanted")
    invalid = (n["manifest"] > 0) & ((F.length("artifact_manifest") != 64) | (F.length("artifact_manifest_most") != 64))
    kinds = [
        *[(f"duplicate_{name}", n[name] > 1, n[name]) for name in NAMES.values()],
        ("invalid_v2_status", F.col("odd_v2") > 0, F.col("odd_v2")),
        ("invalid_ml_status", F.col("odd_ml") > 0, F.col("odd_ml")),
        ("queue_missing", wanted & (n["queue"] == 0), n["result"]),
        ("queue_unexpected", ~wanted & (n["queue"] > 0), n["queue"]),
        ("queue_fields", unequal("fields", "result", "queue"), n["queue"]),
        ("queue_comparison", unequal("comparison", "result", "queue"), n["queue"]),
        ("queue_order", wanted & (n["queue"] > 0) & ~F.col("at_queue").eqNullSafe(F.col("at_wanted")), n["queue"]),
        ("manifest_missing", (n["queue"] > 0) & (n["manifest"] == 0), n["queue"]),
        ("manifest_extra", (n["queue"] == 0) & (n["manifest"] > 0), n["manifest"]),
        ("manifest_identity", unequal("identity", "queue", "manifest"), n["manifest"]),
        ("manifest_order", elsewhere("queue", "manifest"), n["manifest"]),
        ("manifest_artifact", invalid, n["manifest"]),
        ("label_missing", (n["manifest"] > 0) & (n["labels"] == 0), n["manifest"]),
        ("label_extra", (n["manifest"] == 0) & (n["labels"] > 0), n["labels"]),
        ("label_artifact", unequal("artifact", "manifest", "labels"), n["labels"]),
        ("label_order", elsewhere("manifest", "labels"), n["labels"]),
        ("label_filled", F.col("filled") > 0, F.col("filled")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), count.alias("rows"))) for kind, test, count in kinds]))
    return (
        rows.groupBy("target_uid").agg(*aggregates)
        .select("target_uid", F.explode(found).alias("v"))
        .select("v.kind", "target_uid", "v.rows")
    )
