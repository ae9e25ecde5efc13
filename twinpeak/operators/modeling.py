"""Threshold grid, grouped folds, logistic fits and prediction rules of the shadow model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_loss, sigmoid
from .scoring import _best, check_target, with_rates

# Model features in their frozen order.
FEATURES = (
    "cosine",
    "entropy_similarity",
    "log1p_matched_peaks",
    "min_explained_intensity",
    "explained_intensity_asymmetry",
    "fragment_count_balance",
)
# The decision grid (cosine 0.500 to 0.950 in steps of 0.025).
COSINE_GRID = tuple(round(0.5 + 0.025 * i, 3) for i in range(19))
MATCHED_GRID = (2, 3, 4, 5, 6, 8, 10)
EXPLAINED_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
ENTROPY_GRID = (None, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)
GRID_SIZE = len(COSINE_GRID) * len(MATCHED_GRID) * len(EXPLAINED_GRID) * len(ENTROPY_GRID)
# Logistic hyper-parameters.
C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
CLASS_WEIGHTS = (None, "balanced")
GRID_COLUMNS = (
    "min_cosine", "min_matched_peaks", "min_explained_intensity", "min_entropy_similarity",
)


def matched_peaks(feature: Column) -> Column:
    return F.rint(F.expm1(feature)).cast("int")


def _passed(value: Column, grid) -> Column:
    """How many ascending grid values lie at or below ``value``."""
    steps = F.array(*[F.lit(float(g)) for g in grid])
    return F.size(F.filter(steps, lambda g: g <= value))


def threshold_grid(examples: DataFrame, by=()) -> DataFrame:
    """Confusion counts and rates of all 6,384 rules, per group.

    Each example falls in one cell of the grid lattice; counts per cell are summed before
    anything else, and a rule's support count is the suffix sum of the lattice along its
    four axes. Work after the first aggregate depends on the lattice, not on the data.
    """
    axes = {
        "c": _passed(F.col("cosine"), COSINE_GRID),
        "m": _passed(matched_peaks(F.col("log1p_matched_peaks")), MATCHED_GRID),
        "x": _passed(F.col("min_explained_intensity"), EXPLAINED_GRID),
        "e": _passed(F.col("entropy_similarity"), ENTROPY_GRID[1:]),
    }
    sizes = (len(COSINE_GRID) + 1, len(MATCHED_GRID) + 1, len(EXPLAINED_GRID) + 1, len(ENTROPY_GRID))
    cells = examples.groupBy(*by, *[c.alias(n) for n, c in axes.items()]).agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"),
    )
    spark = examples.sparkSession
    span = int(np.prod(sizes))
    lattice, rest = spark.range(span), F.col("id")
    for name, size in zip(("e", "x", "m", "c"), reversed(sizes)):
        lattice = lattice.withColumn(name, (rest % size).cast("int"))
        rest = F.floor(rest / size)
    if by:
        # Groups are folds: a handful, each with its own copy of the lattice.
        lattice = cells.select(*by).distinct().crossJoin(F.broadcast(lattice))
    names = ["c", "m", "x", "e"]
    dense = lattice.join(cells, [*by, *names], "left").select(
        *by,
        *names,
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.coalesce("neg", F.lit(0)).alias("neg"),
    )
    from pyspark.sql import Window as W

    for name in names:
        w = (
            W.partitionBy(*by, *[n for n in names if n != name])
            .orderBy(F.col(name).desc())
            .rowsBetween(W.unboundedPreceding, 0)
        )
        dense = dense.withColumns({"pos": F.sum("pos").over(w), "neg": F.sum("neg").over(w)})
    totals = examples.groupBy(*by).agg(
        F.sum(F.col("label").cast("long")).alias("all_pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("all_neg"),
    )
    dense = dense.join(totals, list(by)) if by else dense.crossJoin(F.broadcast(totals))  # one row

    def value(grid, index):
        return F.get(F.array(*[F.lit(g).cast("double") for g in grid]), index)

    rules = dense.where("c >= 1 AND m >= 1 AND x >= 1")
    return with_rates(
        rules.select(
            *by,
            value(COSINE_GRID, F.col("c") - 1).alias("min_cosine"),
            value(MATCHED_GRID, F.col("m") - 1).cast("int").alias("min_matched_peaks"),
            value(EXPLAINED_GRID, F.col("x") - 1).alias("min_explained_intensity"),
            value(ENTROPY_GRID, F.col("e")).alias("min_entropy_similarity"),
            F.col("pos").alias("tp"),
            F.col("neg").alias("fp"),
            (F.col("all_neg") - F.col("neg")).alias("tn"),
            (F.col("all_pos") - F.col("pos")).alias("fn"),
        )
    )


def fit_thresholds(examples: DataFrame, target: float = 0.95, by=()) -> DataFrame:
    """Best rule per group: highest recall, then precision, F0.5, specificity, strictness."""
    rows = threshold_grid(examples, by).where(F.col("specificity") >= check_target(target))
    rows = rows.withColumn("entropy_rank", F.coalesce("min_entropy_similarity", F.lit(-1.0)))
    order = [
        "recall", "precision", "f0_5", "specificity", "min_cosine", "min_matched_peaks",
        "min_explained_intensity", "entropy_rank",
    ]
    return _best(rows, order, by).drop("entropy_rank")


def threshold_bucket(p: dict) -> Column:
    """Evidence bucket of one rule, whose values are numbers or columns."""
    def val(name):
        v = p[name]
        return v if isinstance(v, Column) else F.lit(v)

    entropy = p["min_entropy_similarity"]
    low_entropy = (
        F.lit(False)
        if entropy is None
        else F.coalesce(F.col("entropy_similarity") < val("min_entropy_similarity"), F.lit(False))
    )
    fails = (
        (F.col("cosine") < val("min_cosine"))
        | (F.col("min_explained_intensity") < val("min_explained_intensity"))
        | low_entropy
    )
    return (
        F.when(
            matched_peaks(F.col("log1p_matched_peaks")) < val("min_matched_peaks"),
            "insufficient_evidence",
        )
        .when(fails, "conflicting_spectra")
        .otherwise("supported_same_compound")
    )


def bucket_probabilities(examples: DataFrame, p: dict) -> DataFrame:
    """Laplace-smoothed positive rate of the three buckets, empty ones included."""
    every = examples.sparkSession.createDataFrame(
        [("supported_same_compound",), ("conflicting_spectra",), ("insufficient_evidence",)],
        "bucket string",
    )
    found = examples.groupBy(threshold_bucket(p).alias("bucket")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n")
    )
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0))
    return every.join(found, "bucket", "left").select(
        "bucket", n.alias("n"), ((pos + 1) / (n + 2)).alias("probability")
    )


# ---- grouped folds -------------------------------------------------------------------


def with_compound_batches(examples: DataFrame) -> DataFrame:
    """Attach ``seen``: the batches in which the row's compound occurs.

    Purging is then a per-row test, because a held-out batch removes a compound whole.
    """
    seen = examples.groupBy("compound_id").agg(F.collect_set("batch_id").alias("seen"))
    return examples.join(seen, "compound_id")


def locked_split(examples: DataFrame, final_batch) -> DataFrame:
    """Add ``role``: locked, purged or development."""
    rows = with_compound_batches(examples)
    locked = F.col("batch_id") == F.lit(final_batch)
    return rows.withColumn(
        "role",
        F.when(locked, "locked")
        .when(F.array_contains("seen", F.lit(final_batch)), "purged")
        .otherwise("development"),
    )


def _role(held: Column) -> Column:
    return (
        F.when(F.col("batch_id") == held, "validation")
        .when(F.array_contains("seen", held), "purged")
        .otherwise("train")
    )


def leave_one_batch_out(examples: DataFrame, batches: list) -> DataFrame:
    """(examples…, fold, role) for each held-out batch; compounds never cross a fold."""
    rows = with_compound_batches(examples) if "seen" not in examples.columns else examples
    folds = F.array(*[F.lit(b) for b in batches])
    return rows.withColumn("fold", F.explode(folds)).withColumn("role", _role(F.col("fold")))


def nested_folds(development: DataFrame, batches: list) -> DataFrame:
    """(…, outer, inner, role): inner folds of each outer training set, and of all rows.

    ``outer`` is NULL for the final tuning folds over the whole development set.
    """
    plan = [(o, i) for o in [None, *batches] for i in batches if i != o]
    kind = development.schema["batch_id"].dataType.simpleString()
    pairs = F.array(
        *[
            F.struct(F.lit(o).cast(kind).alias("outer"), F.lit(i).cast(kind).alias("inner"))
            for o, i in plan
        ]
    )
    rows = development.withColumn("p", F.explode(pairs)).select(
        *development.columns, F.col("p.outer").alias("outer"), F.col("p.inner").alias("inner")
    )
    outside = F.col("outer").isNotNull() & (
        (F.col("batch_id") == F.col("outer")) | F.array_contains("seen", F.col("outer"))
    )
    return rows.where(~outside).withColumn("role", _role(F.col("inner")))


def isolation_violations(folds: DataFrame, keys=("fold",)) -> DataFrame:
    """Compounds or batches present in both train and validation of a fold (must be empty)."""
    tags = F.array(
        F.concat(F.lit("compound|"), F.col("compound_id").cast("string")),
        F.concat(F.lit("batch|"), F.col("batch_id").cast("string")),
    )
    used = folds.where(F.col("role").isin("train", "validation"))
    return (
        used.select(*keys, "role", F.explode(tags).alias("tag"))
        .groupBy(*keys, "tag")
        .agg(F.min("role").alias("a"), F.max("role").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select(*keys, "tag")
    )


def fold_cover(examples: DataFrame, folds: DataFrame) -> DataFrame:
    """(times, rows): how often rows are validated over all folds; a partition has times = 1 only.

    Counts with multiplicity, so a fold that is missing or repeated shows at once.
    """
    held = folds.where("role = 'validation'").groupBy("row_id").agg(F.count("*").alias("times"))
    return (
        examples.select("row_id").join(held, "row_id", "left")
        .groupBy(F.coalesce("times", F.lit(0)).alias("times")).agg(F.count("*").alias("rows"))
    )


ROLES = ("train", "validation", "purged")


def role_violations(universe: DataFrame, assigned: DataFrame, keys=("fold",), roles=ROLES, key: str = "row_id") -> DataFrame:
    """(keys…, key, kind) where roles don't partition the rows that each fold must divide.

    A signed multiset difference: a fold's rows count once as to be assigned and minus once for each
    assignment. missing: no role; repeated: one role more than once; overlapping: several roles;
    foreign: not a row of the fold; unknown_role. NULL fold keys are a fold of their own.
    """
    wanted = universe.select(*keys, key, F.lit(1).alias("sign"), F.lit("").alias("role"))
    given = assigned.select(*keys, key, F.lit(-1).alias("sign"), F.coalesce("role", F.lit("")).alias("role"))
    counts = [F.count_if((F.col("sign") < 0) & (F.col("role") == r)).alias(f"n_{i}") for i, r in enumerate(roles)]
    both = wanted.unionByName(given).groupBy(*keys, key).agg(
        F.count_if(F.col("sign") > 0).alias("n_wanted"), F.sum("sign").alias("difference"), *counts,
        F.count_if((F.col("sign") < 0) & ~F.col("role").isin(*roles)).alias("n_unknown"),
    )
    each = [F.col(f"n_{i}") for i in range(len(roles))]
    several = sum((F.when(c > 0, 1).otherwise(0) for c in each[1:]), F.when(each[0] > 0, 1).otherwise(0))
    kinds = [
        ("missing", (F.col("n_wanted") > 0) & (F.col("difference") > 0) & (several == 0) & (F.col("n_unknown") == 0)),
        ("repeated", F.greatest(*each, F.lit(0)) > 1), ("overlapping", several > 1), ("foreign", F.col("n_wanted") == 0),
        ("unknown_role", F.col("n_unknown") > 0), ("universe", F.col("n_wanted") > 1),
    ]
    found = F.array_compact(F.array(*[F.when(test, kind) for kind, test in kinds]))
    return both.select(*keys, key, F.explode(found).alias("kind"))


def fold_universe(examples: DataFrame, batches: list, key: str = "row_id") -> DataFrame:
    """(fold, row): every fold has to divide every row."""
    return examples.select(F.explode(F.array(*[F.lit(b) for b in batches])).alias("fold"), key)


def nested_universe(development: DataFrame, batches: list, key: str = "row_id") -> DataFrame:
    """(outer, inner, row): inner folds divide the training rows of their outer fold, or all rows (outer NULL).

    It is derived from the outer folds, not from the nested ones that it is held against.
    """
    kind = development.schema["batch_id"].dataType.simpleString()
    outer = leave_one_batch_out(development, batches).where("role = 'train'").select(F.col("fold").cast(kind).alias("outer"), key)
    parents = outer.unionByName(development.select(F.lit(None).cast(kind).alias("outer"), key))
    inner = F.explode(F.array(*[F.lit(b).cast(kind) for b in batches])).alias("inner")
    return parents.select("outer", inner, key).where("outer IS NULL OR inner != outer")


def fold_output_violations(development: DataFrame, outputs: DataFrame, key: str = "row_id") -> DataFrame:
    """(row, kind): united fold outputs must hold each row exactly once."""
    fold = F.lit(0).alias("_all")
    found = role_violations(
        development.select(fold, key), outputs.select(fold, key, F.lit("validation").alias("role")), ("_all",), ("validation",), key
    )
    return found.drop("_all")


# ---- logistic regression -------------------------------------------------------------


def _scales() -> list[Column]:
    def sd(name):
        spread = F.stddev_pop(name)
        return F.when((F.max(name) == F.min(name)) | (spread == 0), 1.0).otherwise(spread)

    return [*[F.avg(f).alias(f"mean_{f}") for f in FEATURES], *[sd(f).alias(f"sd_{f}") for f in FEATURES]]


def _ranges() -> list[Column]:
    return [*[F.min(f).alias(f"min_{f}") for f in FEATURES], *[F.max(f).alias(f"max_{f}") for f in FEATURES]]


def scaler(examples: DataFrame, by=()) -> DataFrame:
    """Population mean and SD of each feature; a constant feature scales by one."""
    return examples.groupBy(*by).agg(*_scales())


def feature_ranges(examples: DataFrame) -> DataFrame:
    return examples.agg(*_ranges())


def feature_statistics(examples: DataFrame) -> DataFrame:
    """Scales and ranges of all features in one pass."""
    return examples.agg(*_scales(), *_ranges())


def scaled(rows: DataFrame) -> list[Column]:
    return [(F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}") for f in FEATURES]


def _logit(beta: list[Column], x: list[Column]) -> Column:
    out = beta[0]
    for b, v in zip(beta[1:], x):
        out = out + b * v
    return out


class FitState:
    """Newton state of one logistic fit; the numbers are a 7-vector and a 7x7 matrix."""

    def __init__(self, inverse_c: float, positive_share: float):
        share = min(1 - 1e-12, max(1e-12, positive_share))
        self.inverse_c = inverse_c
        self.beta = np.zeros(len(FEATURES) + 1)
        self.beta[0] = np.log(share / (1 - share))
        self.trial = self.beta.copy()
        self.loss = None
        self.step = self.slope = None
        self.scale = 1.0
        self.halvings = self.iterations = 0
        self.status = "running"

    def update(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tolerance: float, max_iter: int):
        """Judge the trial point, then take the next Newton step or shorten this one."""
        slopes = self.trial[1:]
        loss = loss + 0.5 * self.inverse_c * float(slopes @ slopes)
        if self.loss is not None:
            # Distributed sums round differently from run to run; allow for that much.
            slack = 1e-13 * max(1.0, abs(self.loss))
            if loss > self.loss - 1e-4 * self.scale * self.slope + slack:
                self.scale *= 0.5
                self.halvings += 1
                if self.halvings >= 40:
                    self.status = "line_search_failed"
                    return
                self.trial = self.beta - self.scale * self.step
                return
            moved = float(np.abs(self.trial - self.beta).max())
            self.beta = self.trial.copy()
            if moved <= tolerance * (1 + float(np.abs(self.beta).max())):
                self.loss, self.status = loss, "converged"
                return
        self.loss = loss
        gradient = gradient.copy()
        gradient[1:] += self.inverse_c * self.beta[1:]
        if self.iterations >= max_iter:
            self.status = "iteration_limit"
            return
        self.iterations += 1
        if float(np.abs(gradient).max()) <= tolerance:
            self.status = "converged"
            return
        ridge = np.full(len(self.beta), self.inverse_c + 1e-12)
        ridge[0] = 1e-12
        try:
            self.step = np.linalg.solve(hessian + np.diag(ridge), gradient)
        except np.linalg.LinAlgError:
            self.status = "singular"
            return
        self.slope = float(gradient @ self.step)
        self.scale, self.halvings = 1.0, 0
        self.trial = self.beta - self.step


def fit_logistic(
    train: DataFrame, configs: list[tuple[float, str | None]], fold: str = "fold",
    tolerance: float = 1e-9, max_iter: int = 200,
) -> list[dict]:
    """L2 logistic fits of every (fold, C, class weight) at once.

    One Spark job per Newton round computes loss, gradient and Hessian of all unfinished
    fits as partial aggregates; only fixed-size sums reach the driver. ``train``: fold,
    label and the six features.
    """
    spark = train.sparkSession
    counts = {
        r[fold]: (r.n, r.pos)
        for r in train.groupBy(fold)
        .agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
        .collect()
    }
    for key, (n, pos) in counts.items():
        if pos == 0 or pos == n:
            raise ValueError(f"logistic fitting needs both classes in fold {key!r}")
    scales = scaler(train, [fold])
    scale_rows = {r[fold]: r.asDict() for r in scales.collect()}
    kind = train.schema[fold].dataType.simpleString()
    base = train.join(F.broadcast(scales), fold)  # one row per fold
    design = base.select(
        fold, F.col("label").cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(scaled(base), 1)]
    ).persist()
    states = {}
    for key, (n, pos) in counts.items():
        for c, weighting in configs:
            share = pos / n if weighting is None else 0.5
            states[(key, c, weighting)] = FitState(1.0 / c, share)
    dim = len(FEATURES) + 1
    ids = {k: i for i, k in enumerate(states)}
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, dim)]]
    try:
        while any(s.status == "running" for s in states.values()):
            rows = []
            for k, s in states.items():
                if s.status != "running":
                    continue
                n, pos = counts[k[0]]
                w1, w0 = (1.0, 1.0) if k[2] is None else (n / (2 * pos), n / (2 * (n - pos)))
                rows.append((k[0], ids[k], w1, w0, *[float(b) for b in s.trial]))
            names = ", ".join(f"b{i} double" for i in range(dim))
            betas = spark.createDataFrame(rows, f"{fold} {kind}, fit int, w1 double, w0 double, {names}")
            joined = design.join(F.broadcast(betas), fold)  # at most folds x configurations rows
            w = F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0"))
            z = _logit([F.col(f"b{i}") for i in range(dim)], x[1:])
            p = sigmoid(F.col("z"))
            features = [f"x{i}" for i in range(1, dim)]
            flat = joined.select("fit", w.alias("w"), z.alias("z"), "y", *features)
            flat = flat.select(
                "fit",
                "w",
                (F.col("w") * log_loss(F.col("z"), F.col("y"))).alias("loss"),
                (F.col("w") * (p - F.col("y"))).alias("r"),
                (F.col("w") * p * (1 - p)).alias("q"),
                *features,
            )
            sums = {"w": F.col("w"), "loss": F.col("loss")}
            for i in range(dim):
                sums[f"g{i}"] = F.col("r") * x[i]
                for j in range(i + 1):
                    sums[f"h{i}_{j}"] = F.col("q") * x[i] * x[j]
            out = flat.groupBy("fit").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).collect()
            by_id = {i: k for k, i in ids.items()}
            for r in out:
                total = r["w"]
                g = np.array([r[f"g{i}"] for i in range(dim)]) / total
                h = np.zeros((dim, dim))
                for i in range(dim):
                    for j in range(i + 1):
                        h[i, j] = h[j, i] = r[f"h{i}_{j}"] / total
                states[by_id[r["fit"]]].update(r["loss"] / total, g, h, tolerance, max_iter)
    finally:
        design.unpersist()
    return [
        {
            "fold": k[0],
            "c": k[1],
            "class_weight": k[2],
            "intercept": float(s.beta[0]),
            "coefficients": [float(b) for b in s.beta[1:]],
            "means": [scale_rows[k[0]][f"mean_{f}"] for f in FEATURES],
            "scales": [scale_rows[k[0]][f"sd_{f}"] for f in FEATURES],
            "converged": s.status == "converged",
            "status": s.status,
            "iterations": s.iterations,
            "objective": s.loss,
        }
        for k, s in states.items()
    ]


def predict_logistic(model: dict) -> Column:
    """Probability column of one fitted model."""
    z = F.lit(model["intercept"])
    for f, b, m, s in zip(FEATURES, model["coefficients"], model["means"], model["scales"]):
        z = z + F.lit(b) * ((F.col(f) - F.lit(m)) / F.lit(s))
    return sigmoid(z)


def predict_many(rows: DataFrame, models: list[dict], fold: str = "fold") -> DataFrame:
    """Score rows with every model of their fold: adds c, class_weight, score."""
    kind = rows.schema[fold].dataType.simpleString()
    names = [f"{p}{i}" for i in range(len(FEATURES)) for p in ("b", "m", "s")]
    data = [
        (
            m["fold"], m["c"], m["class_weight"], m["intercept"],
            *[v for i in range(len(FEATURES)) for v in (m["coefficients"][i], m["means"][i], m["scales"][i])],
        )
        for m in models
    ]
    schema = f"{fold} {kind}, c double, class_weight string, b_ double, " + ", ".join(f"{n} double" for n in names)
    table = rows.sparkSession.createDataFrame(data, schema)
    joined = rows.join(F.broadcast(table), fold)  # one row per fitted model
    z = F.col("b_")
    for i, f in enumerate(FEATURES):
        z = z + F.col(f"b{i}") * ((F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}"))
    return joined.withColumn("score", sigmoid(z)).drop("b_", *names)


def logistic_status(score: Column, conflict: float, support: float) -> Column:
    if not 0 <= conflict < support <= 1:
        raise ValueError("conflict threshold must be below the support threshold")
    return (
        F.when(score <= conflict, "conflicting_spectra")
        .when(score >= support, "supported_same_compound")
        .otherwise("insufficient_evidence")
    )
