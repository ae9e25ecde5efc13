"""Binary-classification scoring: confusion, curves, calibration, cutoffs, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f_half, safe_divide
from ..session import durable
from .ordered import dense_numbers, distinct_totals, previous_in_order, running_totals

MIN_SPECIFICITY_TARGET = 0.95
BOOTSTRAP_METRICS = (
    "precision", "recall", "specificity", "pr_auc", "average_precision", "f0_5",
    "brier_score", "expected_calibration_error",
)


def checked_scores(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Fail on labels outside {0, 1} or scores outside [0, 1]."""
    bad = (
        F.col(label).isNull()
        | ~F.col(label).isin(0, 1)
        | F.col(score).isNull()
        | F.isnan(score)
        | (F.col(score) < 0)
        | (F.col(score) > 1)
    )
    guard = F.when(bad, F.raise_error("labels must be 0/1 and scores probabilities"))
    return df.withColumn(score, guard.otherwise(F.col(score)))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "specificity": safe_divide(tn, tn + fp),
        "f0_5": f_half(precision, recall),
    }


def with_rates(df: DataFrame) -> DataFrame:
    parts = [F.col(n) for n in ("tp", "fp", "tn", "fn")]
    return df.withColumns(rates(*parts))


def confusion(df: DataFrame, threshold: float = 0.5, by=()) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )


def score_totals(df: DataFrame, by=()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return distinct_totals(
        df, F.col("score"), by, pos=F.col("label").cast("long"), neg=(1 - F.col("label")).cast("long")
    )


def pr_curve(df: DataFrame, by=()) -> DataFrame:
    """Precision/recall points with tied scores grouped, from the highest score down."""
    return pr_points(score_totals(df, by), by)


def pr_points(totals: DataFrame, by=()) -> DataFrame:
    run = running_totals(totals, ["pos", "neg"], descending=True, by=by)
    points = run.select(
        *by,
        "bucket",
        "k",
        safe_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
        safe_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )
    prev = previous_in_order(points, ["recall", "precision"], descending=True, by=by)
    return prev.withColumn("prev_recall", F.coalesce("prev_recall", F.lit(0.0))).withColumn(
        "prev_precision", F.coalesce("prev_precision", F.lit(1.0))
    )


def curve_areas(points: DataFrame, by=()) -> DataFrame:
    step = F.greatest(F.lit(0.0), F.col("recall") - F.col("prev_recall"))
    return points.groupBy(*by).agg(
        F.sum(step * F.col("precision")).alias("average_precision"),
        F.sum(step * (F.col("precision") + F.col("prev_precision")) / 2).alias("pr_auc"),
    )


def score_bin(score: Column, bins: int) -> Column:
    return F.least(F.floor(score * bins).cast("int"), F.lit(bins - 1))


def calibration_table(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width reliability bins, empty ones included."""
    if bins < 2:
        raise ValueError("calibration needs at least two bins")
    found = df.groupBy(score_bin(F.col("score"), bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_predicted_probability"),
        F.avg(F.col("label").cast("double")).alias("observed_positive_rate"),
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select(
        "bin",
        (F.col("bin") / bins).alias("lower_bound"),
        ((F.col("bin") + 1) / bins).alias("upper_bound"),
        F.coalesce("n", F.lit(0)).alias("count"),
        "mean_predicted_probability",
        "observed_positive_rate",
        F.abs(F.col("mean_predicted_probability") - F.col("observed_positive_rate")).alias(
            "calibration_gap"
        ),
    )


def binary_metrics(df: DataFrame, threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """One row: confusion, rates, PR-AUC, AP, Brier score and calibration error.

    Distinct scores are the only input of every part, so duplicates cost nothing.
    """
    totals = durable(score_totals(df))
    n = F.col("pos") + F.col("neg")
    k = F.col("k")
    hit = k >= threshold
    head = totals.agg(
        F.sum(n).alias("evaluable_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        (
            F.sum(F.col("pos") * (1 - k) * (1 - k) + F.col("neg") * k * k) / F.sum(n)
        ).alias("brier_score"),
    )
    per_bin = totals.groupBy(score_bin(k, bins).alias("bin")).agg(
        F.sum(n).alias("n"),
        F.abs(F.sum(k * n) / F.sum(n) - F.sum("pos") / F.sum(n)).alias("gap"),
    )
    ece = per_bin.agg(
        (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("expected_calibration_error")
    )
    areas = curve_areas(pr_points(totals))
    # Three one-row tables side by side.
    return (
        with_rates(head)
        .crossJoin(F.broadcast(ece))
        .crossJoin(F.broadcast(areas))
        .withColumn("threshold", F.lit(float(threshold)))
    )


def _cutoff_rows(df: DataFrame, extra, by=()) -> DataFrame:
    """Metrics of ``score >= k`` for every distinct score and each extra cutoff."""
    totals = score_totals(df, by)
    zero = F.lit(0).cast("long")
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    added = groups.select(
        *by,
        F.explode(F.array(*[F.lit(float(e)) for e in extra])).alias("k"),
        zero.alias("pos"),
        zero.alias("neg"),
    )
    merged = totals.unionByName(added).groupBy(*by, "k").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    run = running_totals(merged, ["pos", "neg"], descending=True, by=by)
    return with_rates(
        run.select(
            *by,
            F.col("k").alias("threshold"),
            F.col("cum_pos").alias("tp"),
            F.col("cum_neg").alias("fp"),
            (F.col("all_neg") - F.col("cum_neg")).alias("tn"),
            (F.col("all_pos") - F.col("cum_pos")).alias("fn"),
        )
    )


def _best(rows: DataFrame, order: list[str], by=()) -> DataFrame:
    """The row of largest ``order`` tuple in each group."""
    others = [c for c in rows.columns if c not in order and c not in by]
    top = rows.groupBy(*by).agg(F.max(F.struct(*order, *others)).alias("top"))
    return top.select(*by, "top.*")


def check_target(target: float) -> float:
    if not MIN_SPECIFICITY_TARGET <= target <= 1:
        raise ValueError(f"specificity target must be in [{MIN_SPECIFICITY_TARGET}, 1]")
    return float(target)


def support_cutoff(df: DataFrame, target: float = 0.95, by=()) -> DataFrame:
    """Cutoff of best recall whose specificity meets the target (no row if none does)."""
    rows = _cutoff_rows(df, (0.0, 1.0), by).where(F.col("specificity") >= check_target(target))
    return _best(rows, ["recall", "precision", "f0_5", "specificity", "threshold"], by)


def specificity_cutoff(df: DataFrame, target: float = 0.95) -> DataFrame:
    rows = _cutoff_rows(df, (1.0,)).where(F.col("specificity") >= check_target(target))
    return _best(rows, ["recall", "precision", "specificity", "threshold"])


def conflict_cutoff(df: DataFrame, support: DataFrame, target: float = 0.95, by=()) -> DataFrame:
    """Low cutoff that captures most negatives while sparing positives.

    ``support``: (by…, support_threshold). Only scores below it are candidates, and 0.
    """
    totals = score_totals(df, by)
    zero = F.lit(0).cast("long")
    floor = support.select(
        *by, F.lit(0.0).alias("k"), zero.alias("pos"), zero.alias("neg")
    )
    merged = totals.unionByName(floor).groupBy(*by, "k").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    run = running_totals(merged, ["pos", "neg"], by=by)
    limits = support.select(*by, "support_threshold")
    run = run.join(limits, list(by)) if by else run.crossJoin(F.broadcast(limits))  # one row
    safe = 1 - safe_divide(F.col("cum_pos"), F.col("all_pos")) >= check_target(target)
    below = (F.col("k") < F.col("support_threshold")) | (F.col("k") == 0)
    rows = run.where(safe & below).select(
        *by, safe_divide(F.col("cum_neg"), F.col("all_neg")).alias("negative_capture"),
        F.col("k").alias("conflict_threshold"),
    )
    found = _best(rows, ["negative_capture", "conflict_threshold"], by)
    joined = limits.join(found, list(by), "left") if by else limits.join(found, F.lit(True), "left")
    return joined.select(
        *by,
        "support_threshold",
        F.coalesce("negative_capture", F.lit(0.0)).alias("negative_capture"),
        F.coalesce("conflict_threshold", F.lit(0.0)).alias("conflict_threshold"),
    )


def abstention_report(df: DataFrame) -> DataFrame:
    """One row of coverage, class coverage and selective rates from (label, status)."""
    held = F.col("status") == "insufficient_evidence"
    support, pos = F.col("status") == "supported_same_compound", F.col("label") == 1
    row = df.agg(
        F.count("*").alias("row_count"),
        F.count_if(held).alias("abstained"),
        F.count_if(pos).alias("positives"),
        F.count_if(pos & held).alias("positives_abstained"),
        F.count_if(~pos & held).alias("negatives_abstained"),
        F.count_if(~held & support & pos).alias("tp"),
        F.count_if(~held & support & ~pos).alias("fp"),
        F.count_if(~held & ~support & ~pos).alias("tn"),
        F.count_if(~held & ~support & pos).alias("fn"),
    )
    negatives = F.col("row_count") - F.col("positives")
    return with_rates(row).withColumns(
        {
            "decision_coverage": 1 - safe_divide(F.col("abstained"), F.col("row_count")),
            "abstention_rate": safe_divide(F.col("abstained"), F.col("row_count")),
            "positive_coverage": safe_divide(
                F.col("positives") - F.col("positives_abstained"), F.col("positives")
            ),
            "negative_coverage": safe_divide(
                negatives - F.col("negatives_abstained"), negatives
            ),
            "all_row_recall": safe_divide(F.col("tp"), F.col("positives")),
        }
    )


def status_truth_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(
        F.count_if(F.col("label") == 1).alias("positive_rows"),
        F.count_if(F.col("label") == 0).alias("negative_rows"),
    )


def bootstrap_draws(groups: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(iteration, grp, weight) for whole-group resampling, by one rule at every size.

    Groups are numbered densely in order; draw j of iteration i takes the group whose number is
    a hash of (seed, i, j) modulo their count. Iteration -1 has every group once: the estimate.
    """
    spark = groups.sparkSession
    names = durable(dense_numbers(groups.select("grp").where("grp IS NOT NULL").distinct(), ["grp"], "g"))
    n = names.count()
    if n < 2:
        raise ValueError("grouped bootstrap needs at least two groups")
    cells = spark.range(0, iterations * n).select(
        F.floor(F.col("id") / n).cast("long").alias("iteration"), (F.col("id") % n).alias("j")
    )
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "iteration", "j").cast("binary")), 1, 13)
    drawn = cells.select("iteration", (F.conv(digits, 16, 10).cast("long") % n).alias("g"))
    weights = drawn.groupBy("iteration", "g").agg(F.count("*").alias("weight"))
    whole = names.select(F.lit(-1).cast("long").alias("iteration"), "g", F.lit(1).cast("long").alias("weight"))
    return weights.unionByName(whole).join(names, "g").select("iteration", "grp", "weight")


def group_bootstrap(
    df: DataFrame, threshold: float = 0.5, iterations: int = 1000, seed: int = 20260129,
    confidence: float = 0.95, bins: int = 10,
) -> DataFrame:
    """(metric, estimate, lower, upper, successful_iterations) of eight metrics.

    ``df``: grp, label, score. Rows collapse to (group, score) counts before resampling,
    and to (iteration, score) counts right after; replicates of one class are skipped.
    """
    if iterations < 1 or not 0 < confidence < 1:
        raise ValueError("iterations must be positive and confidence in (0, 1)")
    cells = durable(score_totals(df, ["grp"]))
    draws = bootstrap_draws(cells, iterations, seed)
    by = ["iteration"]
    reps = cells.join(draws, "grp").groupBy("iteration", "k").agg(
        F.sum(F.col("pos") * F.col("weight")).alias("pos"),
        F.sum(F.col("neg") * F.col("weight")).alias("neg"),
    )
    run = running_totals(reps, ["pos", "neg"], descending=True, by=by)
    points = run.withColumns(
        {
            "recall": safe_divide(F.col("cum_pos"), F.col("all_pos")),
            "precision": safe_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")),
        }
    )
    prev = previous_in_order(points, ["recall", "precision"], descending=True, by=by)
    n = F.col("pos") + F.col("neg")
    k, hit = F.col("k"), F.col("k") >= threshold
    step = F.greatest(F.lit(0.0), F.col("recall") - F.coalesce("prev_recall", F.lit(0.0)))
    before = F.coalesce("prev_precision", F.lit(1.0))
    binned = prev.groupBy("iteration", score_bin(k, bins).alias("bin")).agg(
        F.sum(n).alias("n"),
        F.sum(k * n).alias("kn"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * (1 - k) * (1 - k) + F.col("neg") * k * k).alias("sq"),
        F.sum(step * F.col("precision")).alias("ap"),
        F.sum(step * (F.col("precision") + before) / 2).alias("auc"),
    )
    per = binned.groupBy("iteration").agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        (F.sum("neg") - F.sum("fp")).alias("tn"),
        (F.sum("pos") - F.sum("tp")).alias("fn"),
        (F.sum("sq") / F.sum("n")).alias("brier_score"),
        F.sum("ap").alias("average_precision"),
        F.sum("auc").alias("pr_auc"),
        (F.sum(F.abs(F.col("kn") - F.col("pos"))) / F.sum("n")).alias("expected_calibration_error"),
    )
    usable = with_rates(per.where((F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)))
    tail = (1 - confidence) / 2
    stacked = usable.select(
        "iteration",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                    for m in BOOTSTRAP_METRICS
                ]
            )
        ).alias("m")
    )
    replicate = F.when(F.col("iteration") >= 0, F.col("m.v"))
    found = stacked.groupBy("m.metric").agg(
        F.max(F.when(F.col("iteration") < 0, F.col("m.v"))).alias("estimate"),
        F.percentile(replicate, F.lit(tail)).alias("lower"),
        F.percentile(replicate, F.lit(1 - tail)).alias("upper"),
        F.count(replicate).alias("successful_iterations"),
    )
    # a row for every metric, so that a table of one class is an error and not an empty result
    every = df.sparkSession.createDataFrame([(m,) for m in BOOTSTRAP_METRICS], "metric string")
    fault = F.when(F.col("estimate").isNull(), F.raise_error(F.lit("the bootstrap needs both classes"))).when(
        F.col("successful_iterations") == 0, F.raise_error(F.lit("no replicate has both classes"))
    )
    return every.join(found, "metric", "left").withColumn("estimate", F.coalesce(fault.cast("double"), "estimate"))


