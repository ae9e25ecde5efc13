"""Queries over the shadow-model layer, on spectrum pairs with label agreement as truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectra
from ..operators import modeling, scoring, shadow
from ..session import durable
from . import sqltext as sql
from .evidence import compared, r6, scored_pairs

RULE = {
    "min_cosine": 0.5,
    "min_matched_peaks": 4,
    "min_explained_intensity": 0.6,
    "min_entropy_similarity": 0.6,
}
LOGISTIC = {
    "type": "logistic_regression",
    "intercept": -5.0,
    "coefficients": [10.0, 0.5, 0.0, -0.25, 0.0, 1.0],
    "means": [0.1, 0.2, 0.0, 0.0, 0.0, 0.5],
    "scales": [1.0, 0.5, 1.0, 2.0, 1.0, 1.0],
}


def examples(spark, d) -> DataFrame:
    a = F.col("a")
    return scored_pairs(spark, d).select(
        (a * 10 + (F.col("b") - a)).alias("row_id"),
        F.when(a % 10 == 0, F.floor(a / 20)).otherwise(a + 100_000).alias("compound_id"),
        (a % 4).cast("int").alias("batch_id"),
        F.col("same").alias("label"),
        *[v.alias(n) for n, v in spectra.similarity_features(F.col("sim")).items()],
    )


def scored(spark, d) -> DataFrame:
    # A coarse score makes ties common, as rule probabilities do.
    return examples(spark, d).select(
        "row_id", "compound_id", "label", F.round("cosine", 2).alias("score")
    )


EX = """
ex AS (
  SELECT s.a * 10 + (s.b - s.a) AS row_id,
    CASE WHEN s.a % 10 = 0 THEN s.a // 20 ELSE s.a + 100000 END AS compound_id,
    CAST(s.a % 4 AS INT) AS batch_id, p.same AS label, cosine, entropy AS entropy_similarity,
    ln(1 + matched::DOUBLE) AS log1p_matched_peaks, least(explained_a, explained_b) AS min_explained_intensity,
    abs(explained_a - explained_b) AS explained_intensity_asymmetry,
    least(count_a, count_b)::DOUBLE / greatest(count_a, count_b) AS fragment_count_balance, matched
  FROM scores s JOIN pairs p ON p.a = s.a AND p.b = s.b),
sc AS (SELECT row_id, compound_id, label, round(cosine, 2) AS score FROM ex)
"""
_EX = (sql.SPECTRA, sql.CAND_PAIRS, sql.GREEDY, sql.PAIR_SIDES, sql.SCORES, EX)
_GRIDS = f"""
grid AS (SELECT * FROM
  (SELECT unnest({list(modeling.COSINE_GRID)}::DOUBLE[]) AS gc) CROSS JOIN (SELECT unnest({list(modeling.MATCHED_GRID)}) AS gm)
  CROSS JOIN (SELECT unnest({list(modeling.EXPLAINED_GRID)}::DOUBLE[]) AS gx)
  CROSS JOIN (SELECT unnest([NULL, {', '.join(str(e) for e in modeling.ENTROPY_GRID[1:])}]::DOUBLE[]) AS ge)),
gm AS (
  SELECT gc, gm, gx, ge, count(*) FILTER (ok AND label = 1) AS tp, count(*) FILTER (ok AND label = 0) AS fp,
    count(*) FILTER (NOT ok AND label = 0) AS tn, count(*) FILTER (NOT ok AND label = 1) AS fn
  FROM (SELECT *, matched >= gm AND cosine >= gc AND min_explained_intensity >= gx AND (ge IS NULL OR entropy_similarity >= ge) AS ok
        FROM ex CROSS JOIN grid) GROUP BY ALL),
gr AS (SELECT *, {{rates}} FROM gm)
"""
_RATES = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS specificity,
  coalesce(1.25::DOUBLE * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
    / nullif(0.25::DOUBLE * (tp / nullif(tp + fp, 0)) + tp / nullif(tp + fn, 0), 0), 0) AS f0_5"""
GRIDS = _GRIDS.replace("{rates}", _RATES)


def ml_features(spark, d):
    return examples(spark, d).select(
        "row_id", "compound_id", "batch_id", "label", *[r6(f) for f in modeling.FEATURES]
    )


FEATURES_SQL = sql.with_ctes(
    *_EX,
    select="SELECT row_id, compound_id, batch_id, label, "
    + ", ".join(f"round({f}, 6) AS {f}" for f in modeling.FEATURES)
    + " FROM ex",
)


def threshold_grid(spark, d):
    return modeling.threshold_grid(examples(spark, d)).select(
        *modeling.GRID_COLUMNS, "tp", "fp", "tn", "fn",
        *[r6(n) for n in ("precision", "recall", "specificity", "f0_5")],
    )


GRID_SQL = sql.with_ctes(
    *_EX, GRIDS,
    select="""SELECT gc AS min_cosine, CAST(gm AS INT) AS min_matched_peaks, gx AS min_explained_intensity, ge AS min_entropy_similarity,
    tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
    round(f0_5, 6) AS f0_5 FROM gr""",
)


def threshold_fit(spark, d):
    return modeling.fit_thresholds(examples(spark, d)).select(
        *modeling.GRID_COLUMNS, "tp", "fp", "tn", "fn"
    )


GRID_FIT_SQL = sql.with_ctes(
    *_EX, GRIDS,
    select="""SELECT gc AS min_cosine, CAST(gm AS INT) AS min_matched_peaks, gx AS min_explained_intensity, ge AS min_entropy_similarity,
    tp, fp, tn, fn FROM gr WHERE specificity >= 0.95::DOUBLE
    ORDER BY recall DESC, precision DESC, f0_5 DESC, specificity DESC, gc DESC, gm DESC, gx DESC, coalesce(ge, -1) DESC LIMIT 1""",
)


def bucket_probabilities(spark, d):
    return modeling.bucket_probabilities(examples(spark, d), RULE).select(
        "bucket", "n", r6("probability")
    )


_BUCKET = """CASE WHEN matched < 4 THEN 'insufficient_evidence'
  WHEN cosine < 0.5 OR min_explained_intensity < 0.6::DOUBLE OR entropy_similarity < 0.6::DOUBLE THEN 'conflicting_spectra'
  ELSE 'supported_same_compound' END"""
BUCKET_SQL = sql.with_ctes(
    *_EX,
    "nm AS (SELECT unnest(['supported_same_compound', 'conflicting_spectra', 'insufficient_evidence']) AS bucket)",
    f"bk AS (SELECT {_BUCKET} AS bucket, label FROM ex)",
    select="""SELECT nm.bucket, count(bk.label) AS n, round((coalesce(sum(bk.label), 0) + 1) / (count(bk.label) + 2), 6) AS probability
    FROM nm LEFT JOIN bk ON bk.bucket = nm.bucket GROUP BY nm.bucket""",
)


def binary_metrics(spark, d):
    return scoring.binary_metrics(scored(spark, d), 0.3).select(
        "evaluable_rows", "tp", "fp", "tn", "fn",
        *[
            r6(n)
            for n in (
                "precision", "recall", "specificity", "f0_5", "brier_score",
                "expected_calibration_error", "average_precision", "pr_auc",
            )
        ],
    )


_CURVE = """
tt AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS q FROM sc GROUP BY score),
cv AS (SELECT score, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER () AS ap FROM tt
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT score, cp / ap AS recall, cp / (cp + cq) AS precision FROM cv),
pv AS (SELECT *, coalesce(lag(recall) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(precision) OVER (ORDER BY score DESC), 1) AS p0 FROM pr)
"""
METRICS_SQL = sql.with_ctes(
    *_EX, _CURVE,
    """cm AS (SELECT count(*) AS evaluable_rows, count(*) FILTER (score >= 0.3::DOUBLE AND label = 1) AS tp,
      count(*) FILTER (score >= 0.3::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < 0.3::DOUBLE AND label = 0) AS tn,
      count(*) FILTER (score < 0.3::DOUBLE AND label = 1) AS fn, avg((score - label) * (score - label)) AS brier FROM sc)""",
    f"cr AS (SELECT *, {_RATES} FROM cm)",
    """bn AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM sc GROUP BY 1)""",
    select="""SELECT evaluable_rows, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(specificity, 6) AS specificity, round(f0_5, 6) AS f0_5, round(brier, 6) AS brier_score,
    (SELECT round(sum(n * gap) / sum(n), 6) FROM bn) AS expected_calibration_error,
    (SELECT round(sum((recall - r0) * precision), 6) FROM pv) AS average_precision,
    (SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) FROM pv) AS pr_auc FROM cr""",
)


def pr_curve(spark, d):
    return scoring.pr_curve(scored(spark, d)).select(
        F.col("k").alias("score"), r6("recall"), r6("precision"), r6("prev_recall"), r6("prev_precision")
    )


CURVE_SQL = sql.with_ctes(
    *_EX, _CURVE,
    select="""SELECT score, round(recall, 6) AS recall, round(precision, 6) AS precision, round(r0, 6) AS prev_recall,
    round(p0, 6) AS prev_precision FROM pv""",
)


def calibration_table(spark, d):
    return scoring.calibration_table(scored(spark, d)).select(
        "bin", r6("lower_bound"), r6("upper_bound"), "count", r6("mean_predicted_probability"),
        r6("observed_positive_rate"), r6("calibration_gap"),
    )


CALIBRATION_SQL = sql.with_ctes(
    *_EX,
    "bn AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS b, count(*) AS n, avg(score) AS m, avg(label) AS o FROM sc GROUP BY 1)",
    select="""SELECT CAST(r AS INT) AS bin, round(r / 10, 6) AS lower_bound, round((r + 1) / 10, 6) AS upper_bound,
    coalesce(n, 0) AS count, round(m, 6) AS mean_predicted_probability, round(o, 6) AS observed_positive_rate,
    round(abs(m - o), 6) AS calibration_gap FROM (SELECT unnest(range(10)) AS r) LEFT JOIN bn ON bn.b = r""",
)

_CUTS = f"""
ct AS (SELECT DISTINCT t FROM (SELECT score AS t FROM sc UNION ALL SELECT 0.0::DOUBLE UNION ALL SELECT 1.0::DOUBLE)),
cc AS (SELECT t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
  count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score < t AND label = 1) AS fn FROM ct CROSS JOIN sc GROUP BY t),
ck AS (SELECT *, {_RATES} FROM cc),
sp AS (SELECT * FROM ck WHERE specificity >= 0.95::DOUBLE ORDER BY recall DESC, precision DESC, f0_5 DESC, specificity DESC, t DESC LIMIT 1)
"""


def support_cutoff(spark, d):
    return scoring.support_cutoff(scored(spark, d)).select(
        "threshold", "tp", "fp", "tn", "fn", r6("recall"), r6("specificity")
    )


SUPPORT_SQL = sql.with_ctes(
    *_EX, _CUTS,
    select="""SELECT t AS threshold, tp, fp, tn, fn, round(recall, 6) AS recall, round(specificity, 6) AS specificity FROM sp""",
)


def specificity_cutoff(spark, d):
    return scoring.specificity_cutoff(scored(spark, d)).select("threshold", r6("recall"), r6("precision"))


SPECIFICITY_SQL = sql.with_ctes(
    *_EX, _CUTS,
    select="""SELECT t AS threshold, round(recall, 6) AS recall, round(precision, 6) AS precision FROM ck
    WHERE specificity >= 0.95::DOUBLE ORDER BY ck.recall DESC, ck.precision DESC, specificity DESC, t DESC LIMIT 1""",
)


def conflict_cutoff(spark, d):
    rows = durable(scored(spark, d))
    support = scoring.support_cutoff(rows).select(F.col("threshold").alias("support_threshold"))
    return scoring.conflict_cutoff(rows, support).select(
        "support_threshold", r6("negative_capture"), "conflict_threshold"
    )


CONFLICT_SQL = sql.with_ctes(
    *_EX, _CUTS,
    """lo AS (SELECT t, count(*) FILTER (score <= t AND label = 1) / count(*) FILTER (label = 1) AS pc,
      count(*) FILTER (score <= t AND label = 0) / count(*) FILTER (label = 0) AS nc
      FROM (SELECT DISTINCT score AS t FROM sc, (SELECT t AS lim FROM sp) WHERE score < lim UNION SELECT 0.0::DOUBLE) CROSS JOIN sc GROUP BY t)""",
    select="""SELECT (SELECT t FROM sp) AS support_threshold, round(nc, 6) AS negative_capture, t AS conflict_threshold
    FROM lo WHERE 1 - pc >= 0.95::DOUBLE ORDER BY nc DESC, t DESC LIMIT 1""",
)


def _with_status(spark, d):
    return examples(spark, d).select("label", modeling.threshold_bucket(RULE).alias("status"))


def abstention(spark, d):
    return scoring.abstention_report(_with_status(spark, d)).select(
        "row_count", "abstained", "tp", "fp", "tn", "fn",
        *[
            r6(n)
            for n in (
                "decision_coverage", "positive_coverage", "negative_coverage", "all_row_recall",
                "precision", "recall", "specificity",
            )
        ],
    )


ABSTENTION_SQL = sql.with_ctes(
    *_EX, f"st AS (SELECT label, {_BUCKET} AS s FROM ex)",
    """cm AS (SELECT count(*) AS row_count, count(*) FILTER (s = 'insufficient_evidence') AS abstained,
      count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn,
      count(*) FILTER (label = 1 AND s <> 'insufficient_evidence') AS dp, count(*) FILTER (label = 0 AND s <> 'insufficient_evidence') AS dn,
      count(*) FILTER (s = 'supported_same_compound' AND label = 1) AS tp, count(*) FILTER (s = 'supported_same_compound' AND label = 0) AS fp,
      count(*) FILTER (s = 'conflicting_spectra' AND label = 0) AS tn, count(*) FILTER (s = 'conflicting_spectra' AND label = 1) AS fn FROM st)""",
    f"cr AS (SELECT *, {_RATES} FROM cm)",
    select="""SELECT row_count, abstained, tp, fp, tn, fn, round(1 - abstained / row_count, 6) AS decision_coverage,
    round(dp / np, 6) AS positive_coverage, round(dn / nn, 6) AS negative_coverage, round(tp / np, 6) AS all_row_recall,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity FROM cr""",
)


def status_truth(spark, d):
    return scoring.status_truth_counts(_with_status(spark, d))


STATUS_TRUTH_SQL = sql.with_ctes(
    *_EX,
    select=f"""SELECT {_BUCKET} AS status, count(*) FILTER (label = 1) AS positive_rows, count(*) FILTER (label = 0) AS negative_rows
    FROM ex GROUP BY 1""",
)


def _batches(rows: DataFrame) -> list:
    return sorted(r.batch_id for r in rows.select("batch_id").distinct().collect())


def _folds(spark, d) -> DataFrame:
    rows = durable(examples(spark, d))
    return modeling.leave_one_batch_out(rows, _batches(rows))


def lobo_folds(spark, d):
    return _folds(spark, d).select("row_id", "fold", "role")


_LOBO = """
fo AS (SELECT e.row_id, f AS fold, CASE WHEN e.batch_id = f THEN 'validation'
  WHEN EXISTS (SELECT 1 FROM ex v WHERE v.batch_id = f AND v.compound_id = e.compound_id) THEN 'purged' ELSE 'train' END AS role
  FROM ex e CROSS JOIN (SELECT DISTINCT batch_id AS f FROM ex))
"""
LOBO_SQL = sql.with_ctes(*_EX, _LOBO, select="SELECT row_id, fold, role FROM fo")


def locked_split(spark, d):
    return modeling.locked_split(examples(spark, d), 2).select("row_id", "role")


LOCKED_SQL = sql.with_ctes(
    *_EX, _LOBO,
    select="""SELECT row_id, CASE role WHEN 'validation' THEN 'locked' WHEN 'train' THEN 'development' ELSE role END AS role
    FROM fo WHERE fold = 2""",
)


def _nested(spark, d):
    development = modeling.locked_split(examples(spark, d), 3).where("role = 'development'").drop("role")
    development = durable(development)
    return modeling.nested_folds(development, _batches(development))


def nested_folds(spark, d):
    return _nested(spark, d).groupBy("outer", "inner", "role").agg(
        F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives")
    )


NESTED_SQL = sql.with_ctes(
    *_EX, _LOBO,
    "dev AS (SELECT e.* FROM ex e JOIN fo ON fo.row_id = e.row_id AND fo.fold = 3 AND fo.role = 'train')",
    "ba AS (SELECT DISTINCT batch_id AS i FROM dev)",
    """pl AS (SELECT o, i FROM (SELECT i AS o FROM ba UNION ALL SELECT NULL) CROSS JOIN ba WHERE o IS NULL OR o <> i)""",
    """tr AS (SELECT d.*, o, i FROM dev d CROSS JOIN pl WHERE o IS NULL OR (d.batch_id <> o
      AND NOT EXISTS (SELECT 1 FROM dev v WHERE v.batch_id = o AND v.compound_id = d.compound_id)))""",
    """ro AS (SELECT t.*, CASE WHEN t.batch_id = i THEN 'validation'
      WHEN EXISTS (SELECT 1 FROM dev v WHERE v.batch_id = t.i AND v.compound_id = t.compound_id) THEN 'purged' ELSE 'train' END AS role FROM tr t)""",
    select="""SELECT o AS outer, i AS inner, role, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM ro GROUP BY 1, 2, 3""".replace(
        "AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'),
)


def fold_leaks(spark, d):
    # Every second fold is spoilt: its purged compounds go back to training.
    folds = _folds(spark, d)
    spoilt = F.when((F.col("fold") % 2 == 0) & (F.col("role") == "purged"), "train").otherwise(F.col("role"))
    found = modeling.isolation_violations(folds.withColumn("role", spoilt))
    return folds.groupBy("fold").agg(F.count_if(F.col("role") == "purged").alias("purged")).join(
        found.groupBy("fold").agg(F.count("*").alias("leaks")), "fold", "left"
    ).select("fold", "purged", F.coalesce("leaks", F.lit(0)).alias("leaks"))


LEAKS_SQL = sql.with_ctes(
    *_EX, _LOBO,
    """sp AS (SELECT fold, compound_id, batch_id, CASE WHEN fold % 2 = 0 AND role = 'purged' THEN 'train' ELSE role END AS r
      FROM fo JOIN ex USING (row_id))""",
    """lk AS (SELECT fold FROM sp WHERE r IN ('train', 'validation') GROUP BY fold, compound_id HAVING count(DISTINCT r) = 2
      UNION ALL SELECT fold FROM sp WHERE r IN ('train', 'validation') GROUP BY fold, batch_id HAVING count(DISTINCT r) = 2)""",
    select="""SELECT fold, count(*) FILTER (role = 'purged') AS purged, (SELECT count(*) FROM lk WHERE lk.fold = fo.fold) AS leaks
    FROM fo GROUP BY fold""",
)


def fold_cover(spark, d):
    # One prepared fault of each kind: fold 1 is missing, fold 0 comes twice.
    folds = durable(_folds(spark, d))
    faulty = folds.where("fold != 1").unionByName(folds.where("fold = 0"))
    return modeling.fold_cover(folds.where("fold = 0"), faulty)


COVER_SQL = sql.with_ctes(
    *_EX, _LOBO,
    "fl AS (SELECT * FROM fo WHERE fold <> 1 UNION ALL SELECT * FROM fo WHERE fold = 0)",
    "hv AS (SELECT row_id, count(*) FILTER (role = 'validation') AS times FROM fl GROUP BY row_id)",
    select="SELECT times, count(*) AS rows FROM hv GROUP BY times",
)


def scaler(spark, d):
    both = modeling.feature_statistics(examples(spark, d))
    return both.select(*[r6(c) for c in both.columns])


SCALER_SQL = sql.with_ctes(
    *_EX,
    select="SELECT "
    + ", ".join(
        f"round({fn}({f}), 6) AS {p}_{f}"
        for p, fn in (("mean", "avg"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max"))
        for f in modeling.FEATURES
    )
    + " FROM ex",
)


def logistic_fit(spark, d):
    from ..plans.training import CONFIGS

    rows = durable(examples(spark, d)).withColumn("fold", F.col("batch_id").cast("string"))
    models = modeling.fit_logistic(rows.select("fold", "label", *modeling.FEATURES), CONFIGS)
    flat = [
        (m["fold"], m["c"], m["class_weight"] or "none", m["intercept"], *m["coefficients"], m["converged"])
        for m in models
    ]
    names = ", ".join(f"{f} double" for f in modeling.FEATURES)
    out = spark.createDataFrame(
        flat, f"fold string, c double, class_weight string, intercept double, {names}, converged boolean"
    )
    return out.select(
        "fold", "c", "class_weight", r6("intercept"), *[r6(f) for f in modeling.FEATURES], "converged"
    )


def logistic_scores(spark, d):
    rows = examples(spark, d).withColumn("p", modeling.predict_logistic(LOGISTIC))
    return rows.select("row_id", r6("p"), modeling.logistic_status(F.col("p"), 0.2, 0.8).alias("status"))


_Z = "-5.0::DOUBLE" + "".join(
    f" + {b}::DOUBLE * (({f} - {m}::DOUBLE) / {s}::DOUBLE)"
    for f, b, m, s in zip(modeling.FEATURES, LOGISTIC["coefficients"], LOGISTIC["means"], LOGISTIC["scales"])
)
LOGISTIC_SQL = sql.with_ctes(
    *_EX, f"zz AS (SELECT row_id, 1 / (1 + exp(-({_Z}))) AS p FROM ex)",
    select="""SELECT row_id, round(p, 6) AS p, CASE WHEN p <= 0.2::DOUBLE THEN 'conflicting_spectra'
    WHEN p >= 0.8::DOUBLE THEN 'supported_same_compound' ELSE 'insufficient_evidence' END AS status FROM zz""",
)


def _text_rows(spark, d):
    """Pairs as a result table: spectra as text (empty for some rows), rule status beside."""
    from ..functions import rules
    from ..sources import projections as proj

    def text(c):
        body = F.array_join(
            F.transform(c, lambda p: F.concat_ws(",", p["mz"].cast("string"), p["it"].cast("string"))), ";"
        )
        return body

    pairs = compared(proj.spectrum_pairs(spark, d))
    a, b = F.col("a"), F.col("b")
    empty = F.lit("")
    return pairs.select(
        (a * 10 + (b - a)).alias("row_id"),
        F.when(a % 17 == 0, empty).otherwise(text(F.col("peaks_a"))).alias("peak_a_MS2"),
        F.when(b % 19 == 0, empty).when(a % 23 == 0, "junk").otherwise(text(F.col("peaks_b"))).alias("peak_b_MS2"),
        rules.pair_status(F.col("sim"))["status"].alias("ps"),
    ).select(
        "row_id", "peak_a_MS2", "peak_b_MS2",
        rules.lookup(
            F.col("ps"), {v: k for k, v in rules.PAIR_OF_DIAGNOSTIC.items()}, "not_attempted"
        ).alias("ms2_diagnostic_status"),
    )


def _artifact() -> dict:
    ranges = {f: {"minimum": 0.0, "maximum": 0.9} for f in ("cosine", "entropy_similarity")}
    return {
        "trainable_decision": {
            "model_id": "fixture-model",
            "selected_model": "threshold",
            "model": {
                "type": "threshold",
                "parameters": RULE,
                "bucket_probabilities": {
                    "supported_same_compound": 0.9, "conflicting_spectra": 0.1, "insufficient_evidence": 0.4,
                },
            },
            "training_feature_ranges": ranges,
        }
    }


def shadow_apply(spark, d):
    out = shadow.apply_model(_text_rows(spark, d), _artifact())
    return out.select("row_id", *shadow.ML_FIELDS)


_SHADOW = f"""
sh AS (
  SELECT e.*, (e.row_id // 10) % 17 = 0 AS no_a, ((e.row_id // 10) + e.row_id % 10) % 19 = 0 AS no_b,
    (e.row_id // 10) % 23 = 0 AND ((e.row_id // 10) + e.row_id % 10) % 19 <> 0 AS junk, {_BUCKET} AS bucket,
    cosine > 0.9::DOUBLE OR entropy_similarity > 0.9::DOUBLE AS outside FROM ex e),
so AS (
  SELECT row_id, CASE WHEN no_a OR no_b OR junk THEN NULL WHEN bucket = 'supported_same_compound' THEN 0.9::DOUBLE
      WHEN bucket = 'conflicting_spectra' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS ml_same_compound_probability,
    CASE WHEN no_a OR no_b OR junk THEN 'not_evaluable' ELSE bucket END AS ml_diagnostic_status, 'fixture-model' AS ml_model_id,
    CASE WHEN no_a AND no_b THEN 'MISSING_BILATERAL_SPECTRA' WHEN no_a THEN 'MISSING_PEAK_A_SPECTRUM' WHEN no_b THEN 'MISSING_PEAK_B_SPECTRUM'
      WHEN junk THEN 'INVALID_OR_NON_EVALUABLE_SPECTRA' WHEN bucket = 'insufficient_evidence' THEN 'TOO_FEW_MATCHED_FRAGMENTS' ELSE '' END AS ml_abstention_reason,
    CASE WHEN no_a OR no_b THEN concat_ws(';', 'SHADOW_ONLY', CASE WHEN no_a THEN 'MISSING_PEAK_A_SPECTRUM' END, CASE WHEN no_b THEN 'MISSING_PEAK_B_SPECTRUM' END)
      WHEN junk THEN 'SHADOW_ONLY;INVALID_SPECTRUM_FEATURES'
      ELSE concat_ws(';', 'SHADOW_ONLY', CASE WHEN outside THEN 'FEATURE_OUTSIDE_TRAINING_RANGE' END, 'INTERPRETABLE_THRESHOLD_MODEL') END AS ml_review_flags
  FROM sh)
"""
SHADOW_SQL = sql.with_ctes(*_EX, _SHADOW, select="SELECT * FROM so")


def shadow_untrained(spark, d):
    out = shadow.apply_model(_text_rows(spark, d))
    return out.groupBy(*shadow.ML_FIELDS).agg(F.count("*").alias("rows"))


UNTRAINED_SQL = sql.with_ctes(
    *_EX, _SHADOW,
    select="""SELECT '' AS ml_same_compound_probability, 'not_evaluable' AS ml_diagnostic_status, 'UNTRAINED' AS ml_model_id,
    'NO_INDEPENDENT_TRUTH_MODEL' AS ml_abstention_reason,
    concat_ws(';', 'SHADOW_ONLY', 'FEASIBILITY_ONLY', 'NO_INDEPENDENT_TRUTH', CASE WHEN no_a THEN 'MISSING_PEAK_A_SPECTRUM' END,
      CASE WHEN no_b THEN 'MISSING_PEAK_B_SPECTRUM' END) AS ml_review_flags, count(*) AS rows FROM sh GROUP BY ALL""",
)


def shadow_transitions(spark, d):
    # A stored prediction table, as the review step reads one.
    out = durable(shadow.apply_model(_text_rows(spark, d), _artifact()))
    queue = shadow.disagreements(out)
    return queue.groupBy(
        "comparison_baseline_status", "comparison_v2_normalized_status", "comparison_candidate_status"
    ).agg(F.count("*").alias("rows"))


TRANSITIONS_SQL = sql.with_ctes(
    *_EX, sql.STATUS, _SHADOW,
    """tv AS (SELECT o.ml_diagnostic_status AS ml, CASE j.status WHEN 'candidate_enantiomer_pair' THEN 'supported_same_compound'
      WHEN 'ms2_not_similar' THEN 'conflicting_spectra' WHEN 'insufficient_ms2_evidence' THEN 'insufficient_evidence' ELSE 'not_attempted' END AS v2
      FROM so o JOIN judged j ON j.a * 10 + (j.b - j.a) = o.row_id)""",
    select="""SELECT v2 AS comparison_baseline_status, CASE WHEN v2 = 'not_attempted' THEN 'not_evaluable' ELSE v2 END AS comparison_v2_normalized_status,
    ml AS comparison_candidate_status, count(*) AS rows FROM tv
    WHERE ml <> CASE WHEN v2 = 'not_attempted' THEN 'not_evaluable' ELSE v2 END GROUP BY 1, 2, 3""",
)


def group_bootstrap(spark, d):
    rows = scored(spark, d).withColumnRenamed("compound_id", "grp")
    return scoring.group_bootstrap(rows, 0.3, seed=7).select(
        "metric", r6("estimate"), r6("lower"), r6("upper"), "successful_iterations"
    )


_METRIC_ROWS = " UNION ALL ".join(f"SELECT i, '{m}' AS metric, {m} AS v FROM mt" for m in scoring.BOOTSTRAP_METRICS)
BOOTSTRAP_SQL = sql.with_ctes(
    *_EX,
    """gp AS (SELECT compound_id AS grp, row_number() OVER (ORDER BY compound_id) - 1 AS g, count(*) OVER () AS n
      FROM (SELECT DISTINCT compound_id FROM sc WHERE score IS NOT NULL))""",
    "it AS (SELECT n, unnest(range(1000)) AS i FROM (SELECT DISTINCT n FROM gp))",
    "dj AS (SELECT n, i, unnest(range(n)) AS j FROM it)",
    """bw AS (SELECT i, ('0x' || substr(md5('7:' || i || ':' || j), 1, 13))::BIGINT % n AS g, count(*) AS w FROM dj GROUP BY ALL
      UNION ALL SELECT -1, g, 1 FROM gp)""",
    "ce AS (SELECT compound_id AS grp, score, sum(label) AS p, count(*) - sum(label) AS q FROM sc WHERE score IS NOT NULL GROUP BY ALL)",
    "tt AS (SELECT i, score, sum(p * w) AS p, sum(q * w) AS q FROM ce JOIN gp USING (grp) JOIN bw USING (g) GROUP BY i, score)",
    """cv AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY i) AS ap FROM tt
      WINDOW w AS (PARTITION BY i ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
    "pr AS (SELECT *, coalesce(cp / nullif(ap, 0), 0) AS recall, coalesce(cp / nullif(cp + cq, 0), 0) AS precision FROM cv)",
    """pv AS (SELECT *, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, 1) AS p0 FROM pr
      WINDOW w AS (PARTITION BY i ORDER BY score DESC))""",
    """bn AS (SELECT i, least(floor(score * 10), 9) AS b, sum(p + q) AS n, abs(sum(score * (p + q)) - sum(p)) AS gap FROM tt GROUP BY ALL)""",
    "ec AS (SELECT i, sum(gap) / sum(n) AS expected_calibration_error FROM bn GROUP BY i)",
    """cm AS (SELECT i, coalesce(sum(p) FILTER (score >= 0.3::DOUBLE), 0) AS tp, coalesce(sum(q) FILTER (score >= 0.3::DOUBLE), 0) AS fp,
      coalesce(sum(q) FILTER (score < 0.3::DOUBLE), 0) AS tn, coalesce(sum(p) FILTER (score < 0.3::DOUBLE), 0) AS fn,
      sum(p * (1 - score) * (1 - score) + q * score * score) / sum(p + q) AS brier_score,
      sum((recall - r0) * precision) AS average_precision, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM pv GROUP BY i)""",
    f"mt AS (SELECT *, {_RATES} FROM cm JOIN ec USING (i) WHERE tp + fn > 0 AND tn + fp > 0)",
    f"ms AS ({_METRIC_ROWS})",
    select="""SELECT metric, round(max(v) FILTER (i < 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (i >= 0), 6) AS lower,
    round(quantile_cont(v, 0.975) FILTER (i >= 0), 6) AS upper, count(*) FILTER (i >= 0) AS successful_iterations FROM ms GROUP BY metric""",
)


QUERIES = {
    "ml_features": (ml_features, FEATURES_SQL),
    "threshold_grid": (threshold_grid, GRID_SQL),
    "threshold_grid_fit": (threshold_fit, GRID_FIT_SQL),
    "bucket_probabilities": (bucket_probabilities, BUCKET_SQL),
    "binary_metrics": (binary_metrics, METRICS_SQL),
    "pr_curve": (pr_curve, CURVE_SQL),
    "calibration_table": (calibration_table, CALIBRATION_SQL),
    "support_cutoff": (support_cutoff, SUPPORT_SQL),
    "specificity_cutoff": (specificity_cutoff, SPECIFICITY_SQL),
    "conflict_cutoff": (conflict_cutoff, CONFLICT_SQL),
    "abstention_report": (abstention, ABSTENTION_SQL),
    "status_truth_counts": (status_truth, STATUS_TRUTH_SQL),
    "lobo_folds": (lobo_folds, LOBO_SQL),
    "locked_split": (locked_split, LOCKED_SQL),
    "nested_folds": (nested_folds, NESTED_SQL),
    "fold_leaks": (fold_leaks, LEAKS_SQL),
    "fold_cover": (fold_cover, COVER_SQL),
    "feature_scaler": (scaler, SCALER_SQL),
    "logistic_fit": (logistic_fit, None),
    "logistic_scores": (logistic_scores, LOGISTIC_SQL),
    "shadow_apply": (shadow_apply, SHADOW_SQL),
    "shadow_untrained": (shadow_untrained, UNTRAINED_SQL),
    "shadow_disagreements": (shadow_transitions, TRANSITIONS_SQL),
    "group_bootstrap": (group_bootstrap, BOOTSTRAP_SQL),
}
