"""Shadow inference: five append-only fields beside an untouched result row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, spectra
from ..functions.scalars import has_value, text_g12
from . import modeling
from .compare import text_of

# Appended fields, in order.
ML_FIELDS = (
    "ml_same_compound_probability",
    "ml_diagnostic_status",
    "ml_model_id",
    "ml_abstention_reason",
    "ml_review_flags",
)
# Statuses a model may emit, and truth labels a person may assign.
ML_STATUSES = rules.DIAGNOSTIC_STATUSES[:4]
TRUTH_LABELS = (
    "positive_same_compound",
    "negative_different_or_interference",
    "uncertain",
    "not_evaluable",
)
# Names that may never be model features.
LEAKAGE_NAMES = frozenset(
    {
        "ms2_diagnostic_status", "enantiomer_pair_status", "ms2_issue_codes", "ig",
        "supported_same_compound", "conflicting_spectra", "candidate_enantiomer_pair",
        "ms2_not_similar", "insufficient_ms2_evidence", "compound_identity_status",
        "truth_label", "positive_same_compound", "negative_different_or_interference",
        "uncertain", "not_evaluable", *ML_FIELDS,
    }
)
UNTRAINED = "UNTRAINED"


def check_no_leakage(names) -> None:
    leaked = sorted({n for n in names if n.casefold() in LEAKAGE_NAMES})
    if leaked:
        raise ValueError(f"forbidden feature names: {', '.join(leaked)}")


check_no_leakage(modeling.FEATURES)


def truth_label(c: Column) -> Column:
    """1 / 0 / NULL from the exact four-word vocabulary; anything else fails."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(text == TRUTH_LABELS[0], 1)
        .when(text == TRUTH_LABELS[1], 0)
        .when(text.isin(*TRUTH_LABELS[2:]), F.lit(None).cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown truth label: "), text)).cast("int"))
    )


def training_examples(
    rows: DataFrame, label: str = "truth_label", compound: str = "Compound_ID",
    batch: str = "batch_id", row_id: str = "target_uid",
) -> DataFrame:
    """Eligible truth rows with features recomputed from their two spectra.

    A positive or negative label on a row without both spectra stops the job: a missing
    spectrum is never turned into a negative.
    """
    sim = spectra.similarity(
        spectra.parse_fragments(F.col("peak_a_MS2")), spectra.parse_fragments(F.col("peak_b_MS2"))
    )
    labelled = rows.withColumn("label", truth_label(F.col(label))).where(F.col("label").isNotNull())
    scored = labelled.withColumn("sim", sim)
    bad = F.col("sim.cosine").isNull()
    guard = F.when(bad, F.raise_error("an eligible truth row lacks an evaluable spectrum pair"))
    return scored.select(
        F.col(row_id).alias("row_id"),
        F.trim(F.col(compound).cast("string")).alias("compound_id"),
        F.trim(F.col(batch).cast("string")).alias("batch_id"),
        guard.otherwise(F.col("label")).cast("int").alias("label"),
        *[v.alias(n) for n, v in spectra.similarity_features(F.col("sim")).items()],
    )


def _outside(ranges: dict | None) -> Column:
    if not ranges:
        return F.lit(False)
    out = F.lit(False)
    for name, bound in ranges.items():
        out = out | (F.col(name) < bound["minimum"]) | (F.col(name) > bound["maximum"])
    return F.coalesce(out, F.lit(False))


def apply_model(rows: DataFrame, artifact: dict | None = None) -> DataFrame:
    """Append the five fields; without an artifact every row gets the untrained sentinel."""
    existing = [c for c in ML_FIELDS if c in rows.columns]
    if existing:
        raise ValueError(f"input already has model fields: {', '.join(existing)}")
    text = text_of(rows)
    missing = rules.codes(
        (~has_value(text("peak_a_MS2")), "MISSING_PEAK_A_SPECTRUM"),
        (~has_value(text("peak_b_MS2")), "MISSING_PEAK_B_SPECTRUM"),
    )
    keep = [F.col(f"`{c}`") for c in rows.columns]
    if artifact is None:
        flags = F.concat(
            F.array(*[F.lit(f) for f in ("SHADOW_ONLY", "FEASIBILITY_ONLY", "NO_INDEPENDENT_TRUTH")]),
            missing,
        )
        values = ("", "not_evaluable", UNTRAINED, "NO_INDEPENDENT_TRUTH_MODEL")
        return rows.select(
            *keep,
            *[F.lit(v).alias(n) for n, v in zip(ML_FIELDS, values)],
            F.concat_ws(";", flags).alias(ML_FIELDS[4]),
        )
    payload = artifact["trainable_decision"]
    sim = spectra.similarity(
        spectra.parse_fragments(text("peak_a_MS2")), spectra.parse_fragments(text("peak_b_MS2"))
    )
    scored = rows.select(F.struct(*keep).alias("row"), missing.alias("missing"), sim.alias("sim"))
    features = scored.select(
        "row", "missing", *[v.alias(n) for n, v in spectra.similarity_features(F.col("sim")).items()]
    )
    model = payload["model"]
    if payload["selected_model"] == "threshold":
        status = modeling.threshold_bucket(model["parameters"])
        probability = rules.lookup(
            status, {k: str(v) for k, v in model["bucket_probabilities"].items()}, F.lit(None).cast("string")
        ).cast("double")
        reason = F.when(status == "insufficient_evidence", "TOO_FEW_MATCHED_FRAGMENTS").otherwise("")
        near = F.lit(False)
        kind = "INTERPRETABLE_THRESHOLD_MODEL"
    else:
        cut = payload["decision_thresholds"]
        conflict, support = cut["conflict_max_probability"], cut["support_min_probability"]
        probability = modeling.predict_logistic(model)
        status = modeling.logistic_status(F.col("p"), conflict, support)
        reason = F.when(F.col("s") == "insufficient_evidence", "PROBABILITY_ABSTENTION_INTERVAL").otherwise("")
        near = F.least(F.abs(F.col("p") - conflict), F.abs(F.col("p") - support)) <= 0.05
        kind = "LOGISTIC_REGRESSION_MODEL"
    ready = features.withColumn("p", probability).withColumn("s", status)
    n_missing, evaluable = F.size("missing"), F.col("cosine").isNotNull()
    usable = (n_missing == 0) & evaluable
    flags = F.when(n_missing > 0, F.concat(F.array(F.lit("SHADOW_ONLY")), F.col("missing"))).when(
        ~evaluable, F.array(F.lit("SHADOW_ONLY"), F.lit("INVALID_SPECTRUM_FEATURES"))
    ).otherwise(
        rules.codes(
            (F.lit(True), "SHADOW_ONLY"),
            (_outside(payload.get("training_feature_ranges")), "FEATURE_OUTSIDE_TRAINING_RANGE"),
            (F.lit(True), kind),
            (near, "NEAR_ML_DECISION_BOUNDARY"),
        )
    )
    abstain = (
        F.when(n_missing == 2, "MISSING_BILATERAL_SPECTRA")
        .when(n_missing == 1, F.element_at("missing", 1))
        .when(~evaluable, "INVALID_OR_NON_EVALUABLE_SPECTRA")
        .otherwise(reason)
    )
    return ready.select(
        "row.*",
        F.when(usable, F.col("p")).alias(ML_FIELDS[0]),
        F.when(usable, F.col("s")).otherwise("not_evaluable").alias(ML_FIELDS[1]),
        F.lit(payload["model_id"]).alias(ML_FIELDS[2]),
        abstain.alias(ML_FIELDS[3]),
        F.concat_ws(";", flags).alias(ML_FIELDS[4]),
    )


def as_text(predicted: DataFrame) -> DataFrame:
    """Probability as 12-digit text, for the append-only table sink."""
    name = ML_FIELDS[0]
    if dict(predicted.dtypes)[name] == "string":
        return predicted
    return predicted.withColumn(name, text_g12(F.col(name)))


def disagreements(rows: DataFrame) -> DataFrame:
    """Rows whose model status differs from the rule status, with six comparison fields."""
    v2 = rules.comparison_status(F.col("ms2_diagnostic_status"))
    return rows.where(v2 != F.col("ml_diagnostic_status")).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.lit("v2_ml_status").alias("comparison_change_level"),
        F.col("ms2_diagnostic_status").alias("comparison_baseline_status"),
        v2.alias("comparison_v2_normalized_status"),
        F.col("ml_diagnostic_status").alias("comparison_candidate_status"),
        F.lit("v2_ml_disagreement").alias("comparison_review_tier"),
        F.col("ml_review_flags").alias("comparison_review_flags"),
    )


def transition_counts(rows: DataFrame) -> DataFrame:
    v2 = rules.comparison_status(F.col("ms2_diagnostic_status"))
    return rows.groupBy(v2.alias("v2_status"), F.col("ml_diagnostic_status").alias("ml_status")).agg(
        F.count("*").alias("rows")
    )


def prediction_violations(rows: DataFrame, artifact: dict | None, source: DataFrame | None = None) -> DataFrame:
    """Rows that are not a fresh prediction (must be empty), with ``violation``: unfounded or absent.

    Both ways: stored rows that a prediction doesn't give, and predictions that no stored row has.
    ``source`` is the table that was predicted; without it the stored rows' own fields are taken, and
    a row that was lost as a whole can't show.
    """
    bare = (rows if source is None else source).drop(*ML_FIELDS)
    fresh = as_text(apply_model(bare, artifact))
    stored = as_text(rows).select(*[F.col(f"`{c}`") for c in fresh.columns])
    signed = stored.withColumn("_sign", F.lit(1)).unionByName(fresh.withColumn("_sign", F.lit(-1)))
    counted = signed.groupBy(*[F.col(f"`{c}`") for c in fresh.columns]).agg(F.sum("_sign").alias("_sign")).where("_sign != 0")
    kind = F.when(F.col("_sign") > 0, "unfounded").otherwise("absent").alias("violation")
    return counted.select(*[F.col(f"`{c}`") for c in fresh.columns], kind)


def model_id_violations(rows: DataFrame) -> DataFrame:
    """More than one model id, or a blank one, in a prediction table."""
    ids = F.trim(F.coalesce(F.col("ml_model_id"), F.lit("")))
    return rows.agg(F.min(ids).alias("first_id"), F.max(ids).alias("last_id")).where(
        (F.col("first_id") != F.col("last_id")) | (F.col("first_id") == "")
    )
