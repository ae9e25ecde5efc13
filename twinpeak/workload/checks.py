"""Queries over the evidence checks: each input is a consistent one with prepared faults of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import hashtree, modeling, reconcile, shadow
from ..session import durable
from . import sqltext as sql
from .models import _EX, _LOBO, _batches, _folds

ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "cents", "day", "o_orderpriority"]


def _orders(spark, d) -> DataFrame:
    """Orders as source rows of a batch for each month."""
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("batch_id"), "o_orderkey", "o_custkey", "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
    )


def _altered(rows: DataFrame) -> DataFrame:
    """What a manifest was written from: rows lost, added, repeated and changed, whole months renamed."""
    key = F.col("o_orderkey")
    changed = rows.where(key % 701 != 5).withColumn("cents", F.when((key % 503 == 7) & F.col("batch_id").endswith("-07"), F.col("cents") + 1).otherwise(F.col("cents")))
    added = rows.where((key % 997 == 11) & F.col("batch_id").endswith("-03")).withColumn("o_orderkey", key + 1_000_000_000)
    repeated = rows.where((key % 801 == 13) & F.col("batch_id").endswith("-11"))
    every = changed.unionByName(added).unionByName(repeated)
    return every.withColumn("batch_id", F.when(F.col("batch_id").endswith("-12"), F.concat(F.lit("x"), "batch_id")).otherwise(F.col("batch_id")))


ORDERS_CTES = """
elig AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch_id, o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders),
alt0 AS (
  SELECT batch_id, o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 503 = 7 AND batch_id LIKE '%-07' THEN cents + 1 ELSE cents END AS cents, day, o_orderpriority
  FROM elig WHERE o_orderkey % 701 <> 5
  UNION ALL SELECT batch_id, o_orderkey + 1000000000, o_custkey, o_orderstatus, cents, day, o_orderpriority FROM elig WHERE o_orderkey % 997 = 11 AND batch_id LIKE '%-03'
  UNION ALL SELECT * FROM elig WHERE o_orderkey % 801 = 13 AND batch_id LIKE '%-11'),
alt AS (SELECT CASE WHEN batch_id LIKE '%-12' THEN 'x' || batch_id ELSE batch_id END AS batch_id, * EXCLUDE (batch_id) FROM alt0)
"""


def batch_source_cover(spark, d):
    """Manifest of altered months, one of them named twice and one without a digest, against the orders."""
    eligible = _orders(spark, d)
    stated = durable(hashtree.table_digest(_altered(eligible), ORDER_FIELDS, ("batch_id",), depth=2))
    blank = stated.withColumn("sha256", F.when(F.col("batch_id").endswith("-05"), "").otherwise(F.col("sha256")))
    manifest = blank.unionByName(blank.where("batch_id LIKE '%-02'"))
    return hashtree.source_cover(manifest, eligible, "batch_id", ORDER_FIELDS, depth=2)


COVER_SQL = sql.with_ctes(
    ORDERS_CTES,
    """diff AS (SELECT DISTINCT batch_id FROM ((SELECT * FROM elig EXCEPT ALL SELECT * FROM alt) UNION ALL (SELECT * FROM alt EXCEPT ALL SELECT * FROM elig)))""",
    """names AS (SELECT batch_id, bool_or(e) AS e, bool_or(a) AS a FROM
      (SELECT batch_id, TRUE AS e, FALSE AS a FROM elig UNION ALL SELECT batch_id, FALSE, TRUE FROM alt) GROUP BY 1)""",
    select="""SELECT batch_id AS batch, CASE WHEN NOT a THEN 'missing' WHEN NOT e THEN 'extra' WHEN batch_id LIKE '%-02' THEN 'repeated'
      WHEN batch_id LIKE '%-05' THEN 'unstated' ELSE 'changed' END AS fault
    FROM names WHERE NOT a OR NOT e OR batch_id LIKE '%-02' OR batch_id LIKE '%-05' OR batch_id IN (SELECT batch_id FROM diff)""",
)


def batch_source_changes(spark, d):
    """The rows behind differing digests, found by descent."""
    eligible = _orders(spark, d)
    return hashtree.row_changes(eligible, _altered(eligible), ["o_orderkey"], ORDER_FIELDS, ("batch_id",), depth=2)


CHANGES_SQL = sql.with_ctes(
    ORDERS_CTES,
    "e AS (SELECT *, count(*) AS n FROM elig GROUP BY ALL)",
    "a AS (SELECT *, count(*) AS n FROM alt GROUP BY ALL)",
    """odd AS (SELECT batch_id, o_orderkey, 1 AS bit FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
      UNION ALL SELECT batch_id, o_orderkey, 2 FROM (SELECT * FROM a EXCEPT SELECT * FROM e))""",
    select="""SELECT batch_id, o_orderkey, CASE bit_or(bit) WHEN 1 THEN 'missing' WHEN 2 THEN 'extra' ELSE 'changed' END AS fault
    FROM odd GROUP BY 1, 2""",
)


def table_digest(spark, d):
    """Digests of whole tables, of differing partitioning and row order."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("lineitem").alias("name"), *[F.col(c).cast("string") for c in LINE_FIELDS])
    shuffled = line.repartition(5, "l_partkey").withColumn("name", F.lit("lineitem, dealt by part"))
    both = line.unionByName(shuffled)
    return hashtree.table_digest(both, LINE_FIELDS, ("name",), depth=2)


LINE_FIELDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
DIGEST_SQL = sql.with_ctes(
    "rd AS (SELECT sha256(" + " || ".join(f"length({c}::VARCHAR) || ':' || {c}::VARCHAR" for c in LINE_FIELDS) + ") AS digest FROM lineitem)",
    "dd AS (SELECT digest, count(*) AS n FROM rd GROUP BY 1)",
    "l2 AS (SELECT substr(digest, 1, 2) AS p, sha256(string_agg(digest || ':' || n, ',' ORDER BY digest)) AS h FROM dd GROUP BY 1)",
    "l1 AS (SELECT substr(p, 1, 1) AS p, sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM l2 GROUP BY substr(l2.p, 1, 1))",
    "l0 AS (SELECT sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM l1)",
    select="SELECT unnest(['lineitem', 'lineitem, dealt by part']) AS name, h AS sha256 FROM l0",
)


# ---- roles -----------------------------------------------------------------------------


def _faulty_roles(folds: DataFrame) -> DataFrame:
    key, fold, role = F.col("row_id"), F.col("fold"), F.col("role")
    kept = folds.where(~((fold == 0) & (key % 7 == 3)))
    again = folds.where((fold == 1) & (key % 5 == 2))
    also = folds.where((fold == 2) & (role == "purged")).withColumn("role", F.lit("train"))
    foreign = folds.where((fold == 3) & (key % 11 == 1)).withColumn("row_id", key + 10_000_000)
    named = F.when((F.col("fold") == 3) & (F.col("row_id") % 13 == 4), F.lit("held")).otherwise(F.col("role"))
    return kept.unionByName(again).unionByName(also).unionByName(foreign).withColumn("role", named)


def partition_faults(spark, d):
    folds = durable(_folds(spark, d).select("row_id", "batch_id", "fold", "role"))
    universe = modeling.fold_universe(folds.where("fold = 0"), _batches(folds))
    return modeling.role_violations(universe, _faulty_roles(folds.select("row_id", "fold", "role")))


PARTITION_SQL = sql.with_ctes(
    *_EX, _LOBO,
    """fr AS (
      SELECT row_id, fold, CASE WHEN fold = 3 AND row_id % 13 = 4 THEN 'held' ELSE role END AS role FROM (
        SELECT * FROM fo WHERE NOT (fold = 0 AND row_id % 7 = 3)
        UNION ALL SELECT * FROM fo WHERE fold = 1 AND row_id % 5 = 2
        UNION ALL SELECT row_id, fold, 'train' FROM fo WHERE fold = 2 AND role = 'purged'
        UNION ALL SELECT row_id + 10000000, fold, role FROM fo WHERE fold = 3 AND row_id % 11 = 1))""",
    "known AS (SELECT row_id, fold, role IN ('train', 'validation', 'purged') AS k, role, count(*) AS n FROM fr GROUP BY ALL)",
    select="""
    SELECT u.fold, u.row_id, 'missing' AS kind FROM fo u WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.row_id = u.row_id AND fr.fold = u.fold)
    UNION ALL SELECT DISTINCT fold, row_id, 'repeated' FROM known WHERE k AND n > 1
    UNION ALL SELECT fold, row_id, 'overlapping' FROM known WHERE k GROUP BY fold, row_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT fold, row_id, 'unknown_role' FROM known WHERE NOT k
    UNION ALL SELECT DISTINCT fold, row_id, 'foreign' FROM known f WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.row_id = f.row_id AND fo.fold = f.fold)""",
)


def fold_output_faults(spark, d):
    """United validation rows: a fold's come twice in part, another's are lost in part, some are of no row."""
    folds = durable(_folds(spark, d).select("row_id", "fold", "role"))
    held = folds.where("role = 'validation'").select("row_id", "fold")
    key = F.col("row_id")
    outputs = (
        held.where(~((F.col("fold") == 1) & (key % 3 == 0)))
        .unionByName(held.where((F.col("fold") == 0) & (key % 5 == 0)))
        .unionByName(held.where((F.col("fold") == 2) & (key % 17 == 0)).withColumn("row_id", -1 - key))
    )
    return modeling.fold_output_violations(folds.where("fold = 0"), outputs)


OUTPUT_SQL = sql.with_ctes(
    *_EX, _LOBO,
    "h AS (SELECT row_id, fold FROM fo WHERE role = 'validation')",
    """o AS (SELECT row_id FROM h WHERE NOT (fold = 1 AND row_id % 3 = 0) UNION ALL SELECT row_id FROM h WHERE fold = 0 AND row_id % 5 = 0
      UNION ALL SELECT -1 - row_id FROM h WHERE fold = 2 AND row_id % 17 = 0)""",
    select="""SELECT row_id, 'missing' AS kind FROM ex WHERE row_id NOT IN (SELECT row_id FROM o)
    UNION ALL SELECT row_id, 'repeated' FROM o GROUP BY row_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT row_id, 'foreign' FROM o WHERE row_id NOT IN (SELECT row_id FROM ex)""",
)


# ---- review package ----------------------------------------------------------------------


def _package(spark, d):
    """Result, queue, manifest and labels over the orders, before faults."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, n: F.array(*[F.lit(x) for x in names])[n.cast("int")]
    result = spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("T"), key.cast("string")).alias("target_uid"), key.alias("row_order"), F.concat(F.lit("C"), cust.cast("string")).alias("Compound_ID"),
        pick(rules.DIAGNOSTIC_STATUSES, key % 5).alias("ms2_diagnostic_status"),
        F.when(key % 3 == 0, (cust % 100).cast("string")).alias("ml_same_compound_probability"),
        pick(shadow.ML_STATUSES, cust % 4).alias("ml_diagnostic_status"), F.lit("m1").alias("ml_model_id"),
        F.lit("").alias("ml_abstention_reason"), F.when(key % 2 == 0, "flag").alias("ml_review_flags"),
    )
    return durable(result)


def package_violations(spark, d):
    result = _package(spark, d)
    key = F.col("row_order")
    queue = reconcile.dense_numbers(shadow.disagreements(result), ["row_order"], "n").withColumn("queue_row", F.col("n") + 1).drop("n")
    queue = durable(queue)
    manifest = queue.select(
        "target_uid", F.col("queue_row").alias("source_row"), F.sha2("target_uid", 256).alias("artifact_sha256"), F.col("Compound_ID").alias("compound_id"),
        reconcile.STATUS, *shadow.ML_FIELDS, "row_order",
    )
    labels = manifest.select("target_uid", F.col("source_row").alias("label_row"), "artifact_sha256", *[F.lit(None).cast("string").alias(f) for f in reconcile.MANUAL_FIELDS], "row_order")
    change = lambda df, column, test, value: df.withColumn(column, F.when(test, value).otherwise(F.col(column)))
    agreeing = result.join(queue.select("target_uid"), "target_uid", "left_anti").where(key % 211 == 3)
    added = agreeing.select("*", *[c.alias(n) for c, n in zip(reconcile.comparison_cells(), reconcile.COMPARISON_FIELDS, strict=True)], F.lit(0).cast("long").alias("queue_row"))
    result = change(change(result, "ms2_diagnostic_status", key % 401 == 6, F.lit("perhaps")), "ml_diagnostic_status", key % 409 == 8, F.lit("not_attempted"))
    result = change(result.unionByName(result.where(key % 419 == 10)), "target_uid", key % 601 == 33, F.lit(" "))
    queue = queue.where(key % 223 != 4).unionByName(added).unionByName(queue.where(key % 421 == 12))
    queue = change(change(queue, "Compound_ID", key % 227 == 5, F.lit("C?")), "comparison_review_flags", key % 229 == 7, F.lit("x"))
    queue = change(queue, "queue_row", key % 233 == 9, F.col("queue_row") + 1)
    extra = manifest.where(key % 239 == 11)
    manifest = manifest.where(key % 241 != 13).unionByName(extra.withColumn("target_uid", F.concat(F.lit("E"), "target_uid")))
    manifest = change(change(manifest, "artifact_sha256", key % 251 == 14, F.lit("short")), "ml_model_id", key % 257 == 15, F.lit("m2"))
    manifest = change(manifest.unionByName(manifest.where(key % 431 == 16)), "source_row", key % 263 == 17, F.lit(-1).cast("long"))
    labels = labels.where(key % 269 != 18).unionByName(labels.where(key % 271 == 19).withColumn("target_uid", F.concat(F.lit("L"), "target_uid")))
    labels = change(change(labels, "notes", key % 277 == 20, F.lit("seen")), "label_row", key % 281 == 21, F.lit(-2).cast("long"))
    labels = change(labels.unionByName(labels.where(key % 433 == 22)), "target_uid", key % 607 == 34, F.lit(None).cast("string"))
    return reconcile.package_violations(result, queue.drop("row_order"), manifest.drop("row_order"), labels.drop("row_order"))


_STATUSES = ", ".join(f"'{s}'" for s in rules.DIAGNOSTIC_STATUSES)
_ML_STATUSES = ", ".join(f"'{s}'" for s in shadow.ML_STATUSES)
_ML = ", ".join(shadow.ML_FIELDS)
_CELLS = "Compound_ID, ms2_diagnostic_status, " + _ML
_COMPARED = ", ".join(reconcile.COMPARISON_FIELDS)
_NORMAL = "CASE ms2_diagnostic_status WHEN 'not_attempted' THEN 'not_evaluable' ELSE ms2_diagnostic_status END"
_ADDED = f"""'v2_ml_status' AS comparison_change_level, ms2_diagnostic_status AS comparison_baseline_status, {_NORMAL} AS comparison_v2_normalized_status,
  ml_diagnostic_status AS comparison_candidate_status, 'v2_ml_disagreement' AS comparison_review_tier, coalesce(ml_review_flags, '') AS comparison_review_flags"""
PACKAGE_CTES = f"""
r0 AS (SELECT 'T' || o_orderkey AS target_uid, o_orderkey AS k, 'C' || o_custkey AS Compound_ID, ([{_STATUSES}])[1 + o_orderkey % 5] AS ms2_diagnostic_status,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 100)::VARCHAR END AS ml_same_compound_probability, ([{_ML_STATUSES}])[1 + o_custkey % 4] AS ml_diagnostic_status,
    'm1' AS ml_model_id, '' AS ml_abstention_reason, CASE WHEN o_orderkey % 2 = 0 THEN 'flag' END AS ml_review_flags FROM orders),
q0 AS (SELECT *, {_ADDED}, row_number() OVER (ORDER BY k) AS queue_row FROM r0 WHERE {_NORMAL} <> ml_diagnostic_status),
m0 AS (SELECT target_uid, k, queue_row AS source_row, sha256(target_uid) AS artifact_sha256, Compound_ID AS compound_id, ms2_diagnostic_status, {_ML} FROM q0),
l0 AS (SELECT target_uid, k, source_row AS label_row, artifact_sha256, '' AS notes FROM m0),
r1 AS (SELECT * REPLACE (CASE WHEN k % 401 = 6 THEN 'perhaps' ELSE ms2_diagnostic_status END AS ms2_diagnostic_status,
    CASE WHEN k % 409 = 8 THEN 'not_attempted' ELSE ml_diagnostic_status END AS ml_diagnostic_status) FROM r0),
r AS (SELECT * REPLACE (CASE WHEN k % 601 = 33 THEN '' ELSE target_uid END AS target_uid) FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r1 WHERE k % 419 = 10)),
q1 AS (SELECT * FROM q0 WHERE k % 223 <> 4 UNION ALL SELECT * FROM q0 WHERE k % 421 = 12
  UNION ALL SELECT *, {_ADDED}, 0 FROM r0 WHERE {_NORMAL} = ml_diagnostic_status AND k % 211 = 3),
q AS (SELECT * REPLACE (CASE WHEN k % 227 = 5 THEN 'C?' ELSE Compound_ID END AS Compound_ID, CASE WHEN k % 229 = 7 THEN 'x' ELSE comparison_review_flags END AS comparison_review_flags,
    CASE WHEN k % 233 = 9 THEN queue_row + 1 ELSE queue_row END AS queue_row) FROM q1),
m1 AS (SELECT * REPLACE (CASE WHEN k % 251 = 14 THEN 'short' ELSE artifact_sha256 END AS artifact_sha256, CASE WHEN k % 257 = 15 THEN 'm2' ELSE ml_model_id END AS ml_model_id) FROM
  (SELECT * FROM m0 WHERE k % 241 <> 13 UNION ALL SELECT * REPLACE ('E' || target_uid AS target_uid) FROM m0 WHERE k % 239 = 11)),
m AS (SELECT * REPLACE (CASE WHEN k % 263 = 17 THEN -1 ELSE source_row END AS source_row) FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m1 WHERE k % 431 = 16)),
l1 AS (SELECT * REPLACE (CASE WHEN k % 277 = 20 THEN 'seen' ELSE notes END AS notes, CASE WHEN k % 281 = 21 THEN -2 ELSE label_row END AS label_row) FROM
  (SELECT * FROM l0 WHERE k % 269 <> 18 UNION ALL SELECT * REPLACE ('L' || target_uid AS target_uid) FROM l0 WHERE k % 271 = 19)),
l AS (SELECT * REPLACE (CASE WHEN k % 607 = 34 THEN '' ELSE target_uid END AS target_uid) FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l1 WHERE k % 433 = 22)),
rw AS (SELECT *, {_NORMAL} <> ml_diagnostic_status AS w FROM r),
rn AS (SELECT *, CASE WHEN w THEN row_number() OVER (PARTITION BY w ORDER BY k, target_uid) END AS n FROM rw),
ra AS (SELECT target_uid, count(*) AS c, bool_or(w) AS w, min(n) AS n FROM rn WHERE target_uid <> '' GROUP BY 1),
qa AS (SELECT target_uid, count(*) AS c, min(queue_row) AS lo, max(queue_row) AS hi FROM q WHERE target_uid <> '' GROUP BY 1),
ma AS (SELECT target_uid, count(*) AS c, min(source_row) AS lo, max(source_row) AS hi FROM m WHERE target_uid <> '' GROUP BY 1),
la AS (SELECT target_uid, count(*) AS c, min(label_row) AS lo, max(label_row) AS hi FROM l WHERE target_uid <> '' GROUP BY 1)
"""
PACKAGE_SQL = sql.with_ctes(
    PACKAGE_CTES,
    select=f"""
    SELECT 'blank_target_result' AS kind, '' AS target_uid, count(*) AS rows FROM r WHERE target_uid = '' HAVING count(*) > 0
    UNION ALL SELECT 'blank_target_labels', '', count(*) FROM l WHERE target_uid = '' HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_result', target_uid, c FROM ra WHERE c > 1
    UNION ALL SELECT 'duplicate_queue', target_uid, c FROM qa WHERE c > 1
    UNION ALL SELECT 'duplicate_manifest', target_uid, c FROM ma WHERE c > 1
    UNION ALL SELECT 'duplicate_labels', target_uid, c FROM la WHERE c > 1
    UNION ALL SELECT 'invalid_v2_status', target_uid, count(*) FROM r WHERE target_uid <> '' AND ms2_diagnostic_status NOT IN ({_STATUSES}) GROUP BY 2
    UNION ALL SELECT 'invalid_ml_status', target_uid, count(*) FROM r WHERE target_uid <> '' AND ml_diagnostic_status NOT IN ({_ML_STATUSES}) GROUP BY 2
    UNION ALL SELECT 'queue_missing', target_uid, c FROM ra WHERE w AND target_uid NOT IN (SELECT target_uid FROM qa)
    UNION ALL SELECT 'queue_unexpected', target_uid, c FROM qa WHERE target_uid NOT IN (SELECT target_uid FROM ra WHERE w)
    UNION ALL SELECT 'queue_fields', target_uid, c FROM qa WHERE target_uid IN (SELECT target_uid FROM ra) AND target_uid IN (
      SELECT target_uid FROM (SELECT target_uid, {_CELLS} FROM r UNION SELECT target_uid, {_CELLS} FROM q) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'queue_comparison', target_uid, c FROM qa WHERE target_uid IN (SELECT target_uid FROM ra) AND target_uid IN (
      SELECT target_uid FROM (SELECT target_uid, {_ADDED} FROM r UNION SELECT target_uid, {_COMPARED} FROM q) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'queue_order', target_uid, qa.c FROM qa JOIN ra USING (target_uid) WHERE w AND lo <> n
    UNION ALL SELECT 'manifest_missing', target_uid, c FROM qa WHERE target_uid NOT IN (SELECT target_uid FROM ma)
    UNION ALL SELECT 'manifest_extra', target_uid, c FROM ma WHERE target_uid NOT IN (SELECT target_uid FROM qa)
    UNION ALL SELECT 'manifest_identity', target_uid, c FROM ma WHERE target_uid IN (SELECT target_uid FROM qa) AND target_uid IN (
      SELECT target_uid FROM (SELECT target_uid, {_CELLS} FROM q UNION SELECT target_uid, compound_id, ms2_diagnostic_status, {_ML} FROM m) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'manifest_order', target_uid, ma.c FROM ma JOIN qa USING (target_uid) WHERE ma.lo <> qa.lo OR ma.hi <> qa.hi
    UNION ALL SELECT 'manifest_artifact', target_uid, c FROM ma WHERE target_uid IN (SELECT target_uid FROM m WHERE length(artifact_sha256) <> 64)
    UNION ALL SELECT 'label_missing', target_uid, c FROM ma WHERE target_uid NOT IN (SELECT target_uid FROM la)
    UNION ALL SELECT 'label_extra', target_uid, c FROM la WHERE target_uid NOT IN (SELECT target_uid FROM ma)
    UNION ALL SELECT 'label_artifact', target_uid, c FROM la WHERE target_uid IN (SELECT target_uid FROM ma) AND target_uid IN (
      SELECT target_uid FROM (SELECT target_uid, artifact_sha256 FROM m UNION SELECT target_uid, artifact_sha256 FROM l) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'label_order', target_uid, la.c FROM la JOIN ma USING (target_uid) WHERE ma.lo <> la.lo OR ma.hi <> la.hi
    UNION ALL SELECT 'label_filled', target_uid, count(*) FROM l WHERE target_uid <> '' AND notes <> '' GROUP BY 2""",
)

QUERIES = {
    "package_violations": (package_violations, PACKAGE_SQL),
    "batch_source_cover": (batch_source_cover, COVER_SQL),
    "batch_source_changes": (batch_source_changes, CHANGES_SQL),
    "table_digest": (table_digest, DIGEST_SQL),
    "partition_faults": (partition_faults, PARTITION_SQL),
    "fold_output_faults": (fold_output_faults, OUTPUT_SQL),
}
