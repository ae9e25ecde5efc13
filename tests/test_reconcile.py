"""Evidence checks: cross-table reconciliation, table digests and fold roles."""

import hashlib

import pytest
from pyspark.sql import functions as F

from twinpeak.operators import compare, hashtree, modeling, reconcile, shadow
from twinpeak.workload import checks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def package(spark):
    result = checks._package(spark, SF)
    queue = reconcile.dense_numbers(shadow.disagreements(result), ["row_order"], "n").withColumn("queue_row", F.col("n") + 1).drop("n", "row_order")
    manifest = queue.select(
        "target_uid", F.col("queue_row").alias("source_row"), F.sha2("target_uid", 256).alias("artifact_sha256"),
        F.col("Compound_ID").alias("compound_id"), reconcile.STATUS, *shadow.ML_FIELDS,
    )
    labels = manifest.select("target_uid", F.col("source_row").alias("label_row"), "artifact_sha256", *[F.lit("").alias(f) for f in reconcile.MANUAL_FIELDS])
    return result, queue, manifest, labels


def test_a_consistent_package_has_no_violations(package):
    assert package[1].count() > 100 and reconcile.package_violations(*package).collect() == []
    nothing = [t.limit(0) for t in package]
    assert reconcile.package_violations(*nothing).collect() == []


def test_one_target_many_times_and_no_target_at_all(package):
    result, queue, manifest, labels = package
    uid = queue.orderBy("queue_row").first().target_uid
    many = labels.unionByName(labels.where(F.col("target_uid") == uid).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    blank = manifest.where(F.col("target_uid") == uid).withColumn("target_uid", F.lit(None).cast("string"))
    blank = manifest.unionByName(blank.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    got = {(r.kind, r.target_uid, r.rows) for r in reconcile.package_violations(result, queue, blank, many).collect()}
    assert got == {("blank_target_manifest", "", 300), ("duplicate_labels", uid, 501)}


def table(spark):
    rows = [(i % 7, str(i), None if i % 5 == 0 else i * 1.5) for i in range(3000)] + [(1, "same", 2.0)] * 900
    return spark.createDataFrame(rows, "b int, k string, v double")


def test_digest_does_not_depend_on_partitions(spark):
    df = table(spark)
    roots = {hashtree.table_digest(t, ["k", "v"], depth=d).first().sha256 for t, d in ((df, 2), (df.repartition(13), 2), (df.orderBy(F.rand(3)).coalesce(1), 2))}
    assert len(roots) == 1
    assert hashtree.table_digest(df.limit(0), ["k", "v"]).collect() == []
    fewer = df.where("k != '17'").unionByName(df.where("k = '18'"))
    assert hashtree.table_digest(fewer, ["k", "v"], depth=2).first().sha256 not in roots
    one = spark.createDataFrame([("a", None)], "k string, v double")
    leaf = hashlib.sha256((hashlib.sha256(b"1:a0:").hexdigest() + ":1").encode()).hexdigest()
    prefix = hashlib.sha256(b"1:a0:").hexdigest()[0]
    assert hashtree.table_digest(one, ["k", "v"], depth=1).first().sha256 == hashlib.sha256(f"{prefix}:{leaf}".encode()).hexdigest()


def test_changes_are_found_by_descent(spark):
    df = table(spark)
    other = df.where("k != '17'").withColumn("v", F.when(F.col("k") == "20", 0.0).otherwise(F.col("v"))).unionByName(df.where("k = '21'"))
    other = other.unionByName(spark.createDataFrame([(3, "new", 1.0)], "b int, k string, v double"))
    got = {(r.b, r.k, r.fault) for r in hashtree.row_changes(df, other.repartition(5), ["k"], ["k", "v"], ("b",), depth=2).collect()}
    assert got == {(3, "17", "missing"), (6, "20", "changed"), (0, "21", "changed"), (3, "new", "extra")}
    assert hashtree.row_changes(df, df.repartition(3), ["k"], ["k", "v"], ("b",)).collect() == []
    trees = [hashtree.tree(hashtree.row_digests(t, ["k", "v"]), 2) for t in (df, other)]
    assert 3 <= hashtree.differing_leaves(*trees, 2).count() <= 6


def test_source_cover(spark):
    df = table(spark)
    stated = hashtree.table_digest(df, ["k", "v"], ("b",), depth=2)
    assert hashtree.source_cover(stated, df, "b", ["k", "v"], depth=2).collect() == []
    wrong = stated.where("b != 2").withColumn("sha256", F.when(F.col("b") == 3, "x").when(F.col("b") == 4, None).otherwise(F.col("sha256")))
    wrong = wrong.unionByName(stated.where("b = 5")).unionByName(spark.createDataFrame([(9, "y")], "b int, sha256 string"))
    got = {(r.batch, r.fault) for r in hashtree.source_cover(wrong, df, "b", ["k", "v"], depth=2).collect()}
    assert got == {("2", "missing"), ("3", "changed"), ("4", "unstated"), ("5", "repeated"), ("9", "extra")}


def test_roles_partition_their_rows(spark):
    rows = [(i, i % 40, i % 4) for i in range(400)] + [(1000 + i, 7, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, compound_id long, batch_id int")
    split = modeling.with_compound_batches(df)
    batches = [0, 1, 2, 3]
    folds = modeling.leave_one_batch_out(split, batches)
    assert modeling.role_violations(modeling.fold_universe(split, batches), folds).count() == 0
    nested = modeling.nested_folds(split, batches)
    assert modeling.role_violations(modeling.nested_universe(split, batches), nested, ("outer", "inner")).count() == 0
    assert modeling.fold_output_violations(df, folds.where("role = 'validation'")).count() == 0
    lost = modeling.role_violations(modeling.nested_universe(split, batches), nested.where("outer IS NOT NULL OR inner != 2"), ("outer", "inner"))
    assert {(r.outer, r.inner, r.kind) for r in lost.select("outer", "inner", "kind").distinct().collect()} == {(None, 2, "missing")} and lost.count() == 600
    blank = folds.withColumn("role", F.when((F.col("row_id") == 1000) & (F.col("fold") == 1), None).otherwise(F.col("role")))
    assert [tuple(r) for r in modeling.role_violations(modeling.fold_universe(split, batches), blank).collect()] == [(1, 1000, "unknown_role")]


def test_predictions_are_compared_both_ways(spark):
    source = spark.createDataFrame([(str(i), "supported_same_compound") for i in range(6)], "Compound_ID string, ms2_diagnostic_status string")
    made = shadow.as_text(shadow.apply_model(source, None))
    assert shadow.prediction_violations(made, None, source).count() == 0
    bad = made.where("Compound_ID != '2'").withColumn("ml_model_id", F.when(F.col("Compound_ID") == "4", "other").otherwise(F.col("ml_model_id")))
    got = sorted((r.Compound_ID, r.violation) for r in shadow.prediction_violations(bad, None, source).collect())
    assert got == [("2", "absent"), ("4", "absent"), ("4", "unfounded")]


def test_digests_are_moved_once_for_counts_and_leaves(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 2).alias("b"))
    for depth in (1, 2, 3):
        leaves = hashtree.row_digests(df, ["k"], ("b",), depth).groupBy("b", "prefix").agg(F.collect_list("digest").alias("d"))
        plan = leaves._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan
        plain = {r.digest for r in hashtree.row_digests(df, ["k"], ("b",)).collect()}
        found = leaves.collect()
        assert {d for r in found for d in r.d} == plain and all(d.startswith(r.prefix) for r in found for d in r.d)


def test_a_run_summary_moves_compared_cells_only(spark, monkeypatch):
    from twinpeak.sources import projections as proj

    base, cand = (proj.result_rows(spark, "/root/testdata/sf0.001", v) for v in (0, 1))
    whole = compare.compare_runs(base, cand)[1].first()
    stored, plain = [], compare.durable
    monkeypatch.setattr(compare, "durable", lambda df: stored.append(df.schema["base"].dataType.names) or plain(df))
    assert compare.run_summary(base, cand).first() == whole
    assert stored == [[c for c in base.columns if c in (*compare.KEY_COLUMNS, "row_no", *compare.COMPARED_COLUMNS)]]
