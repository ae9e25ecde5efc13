import math
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpeak.operators import compare, effects, modeling, scoring, shadow
from twinpeak.plans import contracts, training

FEATURE_DDL = ", ".join(f"{f} double" for f in modeling.FEATURES)
EXAMPLE = f"row_id string, compound_id string, batch_id string, label int, {FEATURE_DDL}"
GOOD = (0.95, 0.9, math.log1p(8), 0.9, 0.05, 0.9)
POOR = (0.2, 0.3, math.log1p(3), 0.2, 0.3, 0.5)


def test_effect_sizes(spark):
    f = lambda *v: [F.lit(x).cast("double") for x in v]
    row = spark.range(1).select(
        effects.enrichment_fold(*f(10, 2)), effects.recovery_fold(*f(4, 10)), effects.recovery_fold(*f(0, 1), 1.0),
        effects.enantiomer_fraction(*f(3, 1)), effects.enantiomer_fraction(*f(1e308, 1e308)),
        effects.log2_ratio_shift(*f(1, 1, 3, 1), 1.0), effects.enantiomer_fraction(*f(0, 0)), effects.recovery_fold(*f(0, 1)),
    ).first()
    assert list(row) == [5, 2.5, 2, 0.75, 0.5, 1, None, None]
    with pytest.raises(ValueError):
        effects.log2_ratio_shift(*f(1, 1, 1, 1), 0.0)


@pytest.mark.parametrize(
    "p,want",
    [([0.01, 0.04, 0.03, None], [0.03, 0.04, 0.04, None]), ([0.01, 0.01, 0.5], [0.015, 0.015, 0.5]),
     ([0.04, None, 0.01, 0.03], [0.04, None, 0.03, 0.04])],
)
def test_benjamini_hochberg(spark, p, want):
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r.p_adjusted for r in effects.benjamini_hochberg(df).orderBy("i").collect()]
    assert got == [pytest.approx(w) if w is not None else None for w in want]


def scores(spark, labels, values):
    return spark.createDataFrame(list(zip(labels, map(float, values))), "label int, score double")


def test_perfect_separation_metrics(spark):
    m = scoring.binary_metrics(scores(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (2, 0, 2, 0)
    assert m.average_precision == m.pr_auc == m.f0_5 == 1 and m.brier_score == pytest.approx(0.025)


def test_abstention_report(spark):
    st = ["supported_same_compound", "insufficient_evidence", "conflicting_spectra", "insufficient_evidence"]
    df = spark.createDataFrame(list(zip([1, 1, 0, 0], st)), "label int, status string")
    r = scoring.abstention_report(df).first()
    assert r.decision_coverage == 0.5 and r.all_row_recall == 0.5 and r.recall == r.specificity == 1


def test_curve_and_cutoffs_equal_brute_force(spark):
    rng = random.Random(11)
    y = [rng.randrange(2) for _ in range(300)]
    s = [round(min(1.0, max(0.0, 0.3 * a + rng.random() * 0.7)), 2) for a in y]
    df = scores(spark, y, s)

    def counts(t):
        tp = sum(a == 1 and b >= t for a, b in zip(y, s))
        fp = sum(a == 0 and b >= t for a, b in zip(y, s))
        return tp, fp, y.count(0) - fp, y.count(1) - tp

    def key(t):
        tp, fp, tn, fn = counts(t)
        p, r = (tp / (tp + fp) if tp + fp else 0.0), tp / (tp + fn)
        f = 1.25 * p * r / (0.25 * p + r) if p + r else 0.0
        return r, p, f, tn / (tn + fp), t

    best = max((key(t) for t in {0.0, 1.0, *s} if key(t)[3] >= 0.95))
    got = scoring.support_cutoff(df).first()
    assert got.threshold == best[4] and got.recall == pytest.approx(best[0])
    conflict = max(
        (sum(a == 0 and b <= t for a, b in zip(y, s)) / y.count(0), t)
        for t in {0.0, *[v for v in s if v < best[4]]}
        if 1 - sum(a == 1 and b <= t for a, b in zip(y, s)) / y.count(1) >= 0.95
    )
    support = spark.createDataFrame([(best[4],)], "support_threshold double")
    assert scoring.conflict_cutoff(df, support).first().conflict_threshold == conflict[1]
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp, _, fn = counts(t)
        ap += (tp / (tp + fn) - last) * tp / (tp + fp)
        last = tp / (tp + fn)
    assert scoring.binary_metrics(df).first().average_precision == pytest.approx(ap)


def test_specificity_target_floor(spark):
    with pytest.raises(ValueError):
        scoring.support_cutoff(scores(spark, [0, 1], [0.1, 0.9]), 0.949)


def test_bootstrap_equals_a_direct_resampling(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(6)}", rng.randrange(2), round(rng.random(), 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "grp string, label int, score double")
    got = {r.metric: r for r in scoring.group_bootstrap(df, iterations=40, seed=3).collect()}
    groups = sorted({g for g, _, _ in rows})

    def draw(i, j):
        return groups[int(hashlib.md5(f"3:{i}:{j}".encode()).hexdigest()[:13], 16) % len(groups)]

    recalls, briers = [], []
    for i in range(-1, 40):
        pick = [draw(i, j) for j in range(len(groups))] if i >= 0 else groups
        sample = [r for g in pick for r in rows if r[0] == g]
        if len({r[1] for r in sample}) < 2:
            continue
        pos = [r for r in sample if r[1] == 1]
        recalls.append(sum(r[2] >= 0.5 for r in pos) / len(pos))
        briers.append(sum((r[2] - r[1]) ** 2 for r in sample) / len(sample))
    assert (got["recall"].estimate, got["brier_score"].estimate) == pytest.approx((recalls.pop(0), briers.pop(0)))
    for name, values in (("recall", recalls), ("brier_score", briers)):
        assert got[name].lower == pytest.approx(np.percentile(values, 2.5))
        assert got[name].upper == pytest.approx(np.percentile(values, 97.5))
        assert got[name].successful_iterations == len(values)


def test_bootstrap_needs_both_classes_and_two_groups(spark):
    schema = "grp string, label int, score double"
    with pytest.raises(Exception, match="both classes"):
        scoring.group_bootstrap(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.4)], schema), iterations=3).collect()
    with pytest.raises(ValueError, match="two groups"):
        scoring.group_bootstrap(spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.4)], schema), iterations=3)


def examples(spark, rows):
    return spark.createDataFrame(rows, EXAMPLE)


def batches(spark, names="abcd"):
    rows = []
    for b in names:
        for k in range(3):
            jitter = 0.01 * k
            rows.append((f"{b}p{k}", f"c{b}p{k}", b, 1, *[v + jitter for v in GOOD[:2]], *GOOD[2:]))
            rows.append((f"{b}n{k}", f"c{b}n{k}", b, 0, *[v + jitter for v in POOR[:2]], *POOR[2:]))
    return examples(spark, rows)


def test_grid_fit(spark):
    df = batches(spark, "a")
    assert modeling.GRID_SIZE == 6384 == modeling.threshold_grid(df).count()
    assert (modeling.COSINE_GRID[0], modeling.COSINE_GRID[-1]) == (0.5, 0.95)
    r = modeling.fit_thresholds(df).first()
    assert r.recall == r.specificity == 1 and (r.min_cosine, r.min_matched_peaks) == (0.95, 8)


def test_split_purges_compounds(spark):
    rows = [(f"r{i}", c, b, i % 2, *GOOD) for i, (c, b) in enumerate(
        [("x", "a"), ("y", "a"), ("z", "b"), ("w", "b"), ("v", "c"), ("u", "c"), ("t", "b"), ("t", "final"), ("s", "final")])]
    split = modeling.locked_split(examples(spark, rows), "final")
    roles = {r.row_id: r.role for r in split.collect()}
    assert [k for k, v in roles.items() if v == "purged"] == ["r6"]
    folds = modeling.leave_one_batch_out(split.where("role = 'development'").drop("role"), ["a", "b", "c"])
    assert folds.select("fold").distinct().count() == 3
    assert modeling.isolation_violations(folds).count() == 0


def test_logistic_equals_an_independent_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    df = examples(spark, [(str(i), str(i), "a", int(y[i]), *map(float, x[i])) for i in range(200)])
    train = df.select(F.lit("f").alias("fold"), "label", *modeling.FEATURES)
    z = np.c_[np.ones(200), (x - x.mean(0)) / x.std(0)]
    for m in modeling.fit_logistic(train, [(1.0, None), (100.0, "balanced")]):
        w = np.ones(200) if m["class_weight"] is None else np.where(y == 1, 100 / y.sum(), 100 / (200 - y.sum()))
        lam, b = np.r_[0, np.full(6, 1 / m["c"])], np.zeros(7)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ b))
            g = z.T @ (w * (p - y)) / w.sum() + lam * b
            b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(lam), g)
        assert m["converged"] and np.allclose([m["intercept"], *m["coefficients"]], b, atol=1e-7)
        scored = df.select("row_id", modeling.predict_logistic(m).alias("p")).collect()
        want = dict(zip(map(str, range(200)), 1 / (1 + np.exp(-z @ b))))
        assert max(abs(r.p - want[r.row_id]) for r in scored) < 1e-6


def test_training_is_valid_and_prefers_the_rule(spark, tmp_path):
    one = training.train(batches(spark), "d", iterations=5)
    assert one["trainable_decision"]["selected_model"] == "threshold"
    contracts.validate_artifact(one)
    path = str(tmp_path / "m.json")
    training.write_artifact(one, path)
    forged = {"trainable_decision": {**one["trainable_decision"], "model_id": "x"}}
    with pytest.raises(ValueError):
        contracts.validate_artifact(forged)
    with pytest.raises(ValueError):
        training.train(batches(spark, "ab"), "b", iterations=5)


POSITIVE = "100,1000;120,900;140,800;160,700;180,600;200,500"
SHIFTED = "101,1000;121,900;141,800;161,700;181,600;201,500"


def artifact(selected, model, low=0.0, high=1.0):
    return {"trainable_decision": {
        "model_id": "m", "selected_model": selected, "model": model,
        "decision_thresholds": {"conflict_max_probability": low, "support_min_probability": high},
        "training_feature_ranges": None}}


def test_shadow_predictions(spark):
    rows = spark.createDataFrame(
        [("a", POSITIVE, POSITIVE), ("b", POSITIVE, "100,1000;120,900;140,800;400,9000;500,9000"),
         ("c", POSITIVE, SHIFTED), ("d", "", POSITIVE), ("e", "", "")], "id string, peak_a_MS2 string, peak_b_MS2 string")
    rule = {"min_cosine": 0.7, "min_matched_peaks": 3, "min_explained_intensity": 0.5, "min_entropy_similarity": None}
    probs = {"supported_same_compound": 0.9, "conflicting_spectra": 0.1, "insufficient_evidence": 0.4}
    out = {r.id: r for r in shadow.apply_model(rows, artifact("threshold", {"parameters": rule, "bucket_probabilities": probs})).collect()}
    got = {k: (r.ml_diagnostic_status, r.ml_same_compound_probability) for k, r in out.items()}
    assert got == {"a": ("supported_same_compound", 0.9), "b": ("conflicting_spectra", 0.1), "c": ("insufficient_evidence", 0.4),
                   "d": ("not_evaluable", None), "e": ("not_evaluable", None)}
    assert out["d"].ml_abstention_reason == "MISSING_PEAK_A_SPECTRUM" and out["e"].ml_abstention_reason == "MISSING_BILATERAL_SPECTRA"
    logistic = {"intercept": -5.0, "coefficients": [10.0, 0, 0, 0, 0, 0], "means": [0.0] * 6, "scales": [1.0] * 6}
    ml = {r.id: r for r in shadow.apply_model(rows, artifact("logistic_regression", logistic, 0.2, 0.8)).collect()}
    assert ml["a"].ml_diagnostic_status == "supported_same_compound" and ml["c"].ml_diagnostic_status == "conflicting_spectra"
    bare = shadow.apply_model(rows)
    assert {r.ml_model_id for r in bare.collect()} == {"UNTRAINED"}
    assert shadow.prediction_violations(bare, None).count() == 0 and shadow.model_id_violations(bare).count() == 0
    with pytest.raises(ValueError):
        shadow.apply_model(bare)


def test_truth_contract(spark):
    def rows(label, a=POSITIVE):
        return spark.createDataFrame([("u", "c", "b", label, a, POSITIVE)], "target_uid string, Compound_ID string, batch_id string, truth_label string, peak_a_MS2 string, peak_b_MS2 string")

    assert shadow.training_examples(rows("uncertain")).count() == 0
    assert shadow.training_examples(rows("positive_same_compound")).first().label == 1
    for bad in (rows("positive"), rows("positive_same_compound", "")):
        with pytest.raises(Exception):
            shadow.training_examples(bad).collect()
    with pytest.raises(ValueError):
        shadow.check_no_leakage(["Truth_Label"])


def test_frozen_source_contract():
    good = dict(contracts.FROZEN_SOURCE)
    assert contracts.validate_frozen_source({"parameters": good}) == contracts.FROZEN_SOURCE
    shared = {k: v for k, v in good.items() if k not in contracts.EXPLICIT_EIC}
    contracts.validate_frozen_source({"parameters": shared})
    for bad in ({**good, "rt_half_window_sec": 8.0}, {**good, "new_knob": 1}, {**good, "min_cosine": 0.7},
                {**shared, "precursor_eic_mz_tol": 10.0}):
        with pytest.raises(ValueError):
            contracts.validate_frozen_source({"parameters": bad})


def test_run_comparison_queue(spark):
    cols = "row_no long, Compound_ID string, MZ string, ms2_diagnostic_status string, peak_a_MS2 string, peak_b_MS2 string, ms2_matched_peaks string"
    base = spark.createDataFrame([(0, "A", "1", "supported_same_compound", "100,1", "100,1", "6"), (1, "A", "1", "not_evaluable", "x", "y", "")], cols)
    cand = spark.createDataFrame([(0, "A", "1", "not_evaluable", "100,2", "100,1", ""), (1, "A", "1", "not_evaluable", "z", "y", ""), (2, "B", "1", "not_evaluable", "", "", "")], cols)
    queue, summary = compare.compare_runs(base, cand, status_changes_only=True)
    (q,) = queue.collect()
    assert q.comparison_peak_a_spectrum_changed and not q.comparison_peak_b_spectrum_changed
    assert q.comparison_review_tier == "manual_parameter_flip" and q.comparison_matched_peak_delta is None
    s = summary.first()
    assert (s.matched_rows, s.baseline_only_rows, s.candidate_only_rows, s.queued_rows) == (2, 0, 1, 1)


def test_preserve_mode_keeps_supplied_diagnostics(spark):
    df = spark.createDataFrame([(0, "kept", "mine")], "row_no long, ms2_diagnostic_status string, manual_notes string")
    r = compare.annotate_results(df, preserve=True).first()
    assert (r.ms2_diagnostic_status, r.manual_notes, r.manual_reviewer, r.review_row) == ("kept", "mine", "", 1)


def test_logistic_fit_runs_every_setting(spark):
    from twinpeak.plans.training import CONFIGS
    from twinpeak.workload import models

    got = [(r.fold, r.c, r.class_weight) for r in models.logistic_fit(spark, "/root/testdata/sf0.001").collect()]
    want = {(c, w or "none") for c, w in CONFIGS}
    folds = {g[0] for g in got}
    assert folds and len(got) == len(folds) * len(want) and all({g[1:] for g in got if g[0] == f} == want for f in folds)


def test_pairs_are_compared_once_whatever_reads_the_scores(spark):
    from twinpeak.workload import models

    rows = models.scored(spark, "/root/testdata/sf0.001").where(F.col("score").isNotNull())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("lambda" in line and "greatest" not in line for line in plan.splitlines() if "Filter" in line) == 0
    assert sum("near" in line for line in plan.splitlines()) == 1
