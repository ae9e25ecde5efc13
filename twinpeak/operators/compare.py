"""Run-to-run comparison, result annotation, review queue and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import has_value, number
from ..functions.spectra import parse_fragments
from ..params import PairThresholds
from ..session import durable

# Columns that identify one target across two runs.
KEY_COLUMNS = (
    "Compound_ID",
    "SGC ID for Component",
    "SGC ID for Pool",
    "MZ",
    "Peak1",
    "Peak2",
)
# Baseline scores kept beside a queued row.
SCORE_COLUMNS = (
    "ms2_cosine",
    "ms2_entropy_similarity",
    "ms2_matched_peaks",
    "peak_a_explained_intensity",
    "peak_b_explained_intensity",
)
# Review queue columns in output order.
QUEUE_COLUMNS = (
    "review_row", "Compound_ID", "MZ", "Peak1", "Peak2", "ms1_reference_status",
    "ms2_diagnostic_status", "ms2_review_priority", "ms2_issue_codes", "ms2_cosine",
    "ms2_entropy_similarity", "ms2_matched_peaks", "peak_a_explained_intensity",
    "peak_b_explained_intensity", "peak_a_fragment_count", "peak_b_fragment_count",
    "dia_window_match_count", "peak_a_MS2", "peak_b_MS2", "manual_ms2_label",
    "manual_issue_codes", "manual_notes", "manual_reviewer", "manual_review_date",
)
MANUAL_COLUMNS = QUEUE_COLUMNS[-5:]


def text_of(df: DataFrame, prefix: str = ""):
    """name -> text column, '' for NULL cells and absent columns."""
    present = set(df.columns) if not prefix else set(df.select(f"{prefix}.*").columns)

    def get(name: str) -> Column:
        if name not in present:
            return F.lit("")
        ref = F.col(f"{prefix}.`{name}`") if prefix else F.col(f"`{name}`")
        return F.coalesce(ref.cast("string"), F.lit(""))

    return get


def number_of(df: DataFrame, prefix: str = ""):
    text = text_of(df, prefix)
    return lambda name: number(text(name))


def with_numbers(df: DataFrame, names) -> tuple[DataFrame, object]:
    """Parse the named text cells once into helper columns; returns (df, name -> column).

    Kept as own columns so that expressions using a value many times do not parse it
    many times.
    """
    text = text_of(df)
    typed = df.withColumns({f"_n_{n}": number(text(n)) for n in names})
    return typed, lambda name: F.col(f"_n_{name}")


def drop_numbers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_n_")])


# Text cells the review views read as numbers.
VIEW_NUMBERS = (
    "rt_separation_sec", "ms2_cosine", "ms2_matched_peaks", "dia_window_match_count", "MZ",
    "Peak1", "Peak2",
    *[
        f"{side}_{name}"
        for side in ("peak_a", "peak_b")
        for name in (
            "apex_rt", "rt_window_start", "rt_window_end", "fragment_count",
            "candidate_fragment_count",
        )
    ],
)
SCORE_NUMBERS = (
    "ms2_cosine", "ms2_matched_peaks", "ms2_entropy_similarity", "dia_window_match_count",
    "peak_a_explained_intensity", "peak_b_explained_intensity", "peak_a_fragment_count",
    "peak_b_fragment_count",
)


def _occurrence(df: DataFrame, order: str, text) -> DataFrame:
    """Number repeated keys 1, 2, … in row order, and keep the row as one struct.

    A key repeated without bound would gather in one window task, so the occurrence is
    counted in two steps: blocks of consecutive rows first, then rows inside a block.
    """
    key = F.xxhash64(*[F.trim(text(k)) for k in KEY_COLUMNS])
    keyed = df.select(
        F.concat_ws("\u0001", *[F.trim(text(k)) for k in KEY_COLUMNS]).alias("key"),
        key.alias("h"),
        F.col(order).alias("ord"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    ).withColumn("block", F.floor(F.col("ord") / 100_000))
    sizes = keyed.groupBy("h", "key", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("h", "key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "h", "key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")
    )
    inside = W.partitionBy("h", "key", "block").orderBy("ord")
    return (
        keyed.join(offsets, ["h", "key", "block"])
        .withColumn("occurrence", F.col("off") + F.row_number().over(inside))
        .select("h", "key", "occurrence", "row")
    )


def pair_runs(baseline: DataFrame, candidate: DataFrame, order: str = "row_no") -> DataFrame:
    """Full multiset match of two runs: (base struct, cand struct), either side NULL.

    The n-th occurrence of a key matches the n-th occurrence on the other side.
    """
    b = _occurrence(baseline, order, text_of(baseline)).withColumnRenamed("row", "base")
    c = _occurrence(candidate, order, text_of(candidate)).withColumnRenamed("row", "cand")
    return b.join(c, ["h", "key", "occurrence"], "full").select("base", "cand")


# The cells that tell whether a matched row changed.
COMPARED_COLUMNS = ("ms2_diagnostic_status", "peak_a_MS2", "peak_b_MS2")


def _queued(status_changes_only: bool) -> Column:
    return F.col("matched") & (F.col("status_changed") | (F.lit(not status_changes_only) & F.col("evidence_changed")))


def _changes(paired: DataFrame) -> DataFrame:
    base, cand = text_of(paired, "base"), text_of(paired, "cand")

    def differs(name):
        return base(name) != cand(name)

    return (
        paired.withColumn("status_changed", differs("ms2_diagnostic_status"))
        .withColumn("peak_a_changed", differs("peak_a_MS2"))
        .withColumn("peak_b_changed", differs("peak_b_MS2"))
        .withColumn("evidence_changed", F.col("peak_a_changed") | F.col("peak_b_changed"))
        .withColumn("matched", F.col("base").isNotNull() & F.col("cand").isNotNull())
    )


def review_flags(num) -> Column:
    """Ordered caution flags of one candidate row."""
    def offset(side, supplied):
        return F.abs(num(f"{side}_apex_rt") - num(supplied) * 60) > 6

    def imbalance():
        a, b = num("peak_a_fragment_count"), num("peak_b_fragment_count")
        low, high = F.least(a, b), F.greatest(a, b)
        both = a.isNotNull() & b.isNotNull()
        return both & (((low == 0) & (high > 0)) | ((low > 0) & (high > 4 * low)))

    def near_edge(side):
        return rules.apex_edge_distance(num, side) < 2

    return rules.codes(
        (num("rt_separation_sec") < 30, "CLOSE_RT_PAIR_LT30S"),
        (offset("peak_a", "Peak1"), "PEAK1_APEX_OFFSET_GT6S"),
        (near_edge("peak_a"), "PEAK1_APEX_NEAR_WINDOW_EDGE_LT2S"),
        (offset("peak_b", "Peak2"), "PEAK2_APEX_OFFSET_GT6S"),
        (near_edge("peak_b"), "PEAK2_APEX_NEAR_WINDOW_EDGE_LT2S"),
        (imbalance(), "FRAGMENT_COUNT_IMBALANCE_GT4X"),
    )


def review_tier(cand_num, base_num, status: Column, status_changed: Column, flags: Column) -> Column:
    matched = cand_num("ms2_matched_peaks")
    gain = matched - F.coalesce(base_num("ms2_matched_peaks"), F.lit(0.0))
    supported = status == "supported_same_compound"
    strong = (
        supported
        & (cand_num("ms2_cosine") >= 0.9)
        & (matched >= 8)
        & (gain >= 3)
        & (cand_num("peak_a_explained_intensity") >= 0.8)
        & (cand_num("peak_b_explained_intensity") >= 0.8)
        & (F.size(flags) == 0)
    )
    return (
        F.when(F.coalesce(strong, F.lit(False)), "strong_shadow_support_candidate")
        .when(supported, "manual_supported_boundary")
        .when(status == "conflicting_spectra", "manual_conflict")
        .when(status_changed, "manual_parameter_flip")
        .otherwise("stable_status_spectrum_changed")
    )


def compare_runs(
    baseline: DataFrame,
    candidate: DataFrame,
    status_changes_only: bool = False,
    order: str = "row_no",
) -> tuple[DataFrame, DataFrame]:
    """(queue, summary) of two result tables; the summary is one row."""
    # Cut once: queue and summary both read it, and the change flags become plain columns
    # instead of long expressions the optimizer would derive constraints from.
    changed = durable(_changes(pair_runs(baseline, candidate, order)))
    queued = _queued(status_changes_only)
    cand_num, base_num = number_of(changed, "cand"), number_of(changed, "base")
    cand, base = text_of(changed, "cand"), text_of(changed, "base")
    flags = review_flags(cand_num)
    tier = review_tier(
        cand_num, base_num, cand("ms2_diagnostic_status"), F.col("status_changed"), F.col("flags")
    )
    level = (
        F.when(F.col("status_changed") & F.col("evidence_changed"), "status_and_spectrum")
        .when(F.col("status_changed"), "status_only")
        .otherwise("spectrum_only")
    )
    queue = (
        changed.where(queued)
        .withColumn("flags", flags)
        .select(
            "cand.*",
            level.alias("comparison_change_level"),
            base("ms2_diagnostic_status").alias("comparison_baseline_status"),
            cand("ms2_diagnostic_status").alias("comparison_candidate_status"),
            F.col("peak_a_changed").alias("comparison_peak_a_spectrum_changed"),
            F.col("peak_b_changed").alias("comparison_peak_b_spectrum_changed"),
            base("ms2_issue_codes").alias("comparison_baseline_issue_codes"),
            tier.alias("comparison_review_tier"),
            F.concat_ws(";", "flags").alias("comparison_review_flags"),
            (cand_num("ms2_matched_peaks") - base_num("ms2_matched_peaks")).alias(
                "comparison_matched_peak_delta"
            ),
            (cand_num("ms2_cosine") - base_num("ms2_cosine")).alias("comparison_cosine_delta"),
            *[base(c).alias(f"comparison_baseline_{c}") for c in SCORE_COLUMNS],
        )
    )
    return queue, _summary(changed, queued)


def _summary(changed: DataFrame, queued: Column) -> DataFrame:
    hit = F.col("matched")
    return changed.agg(
        F.count_if(hit).alias("matched_rows"),
        F.count_if(F.col("cand").isNull()).alias("baseline_only_rows"),
        F.count_if(F.col("base").isNull()).alias("candidate_only_rows"),
        F.count_if(hit & F.col("status_changed")).alias("status_changed_rows"),
        F.count_if(hit & F.col("evidence_changed")).alias("spectrum_changed_rows"),
        F.count_if(queued).alias("queued_rows"),
    )


def run_summary(
    baseline: DataFrame, candidate: DataFrame, status_changes_only: bool = False, order: str = "row_no"
) -> DataFrame:
    """The summary of ``compare_runs`` alone: only keys and compared cells are moved and stored."""
    read = (*KEY_COLUMNS, order, *COMPARED_COLUMNS)
    sides = [df.select(*[F.col(f"`{c}`") for c in df.columns if c in read]) for df in (baseline, candidate)]
    # Cut, as there: the optimizer would derive constraints from the flags.
    changed = durable(_changes(pair_runs(*sides, order)))
    return _summary(changed, _queued(status_changes_only))


def similarity_from_text(num, text) -> Column:
    """Similarity struct rebuilt from result scalars; NULL cosine means no comparison."""

    def count(side):
        stated = num(f"{side}_fragment_count")
        stated = F.when(stated != 0, stated)
        return F.coalesce(stated, F.size(parse_fragments(text(f"{side}_MS2")))).cast("int")

    return F.struct(
        num("ms2_cosine").alias("cosine"),
        F.coalesce(num("ms2_matched_peaks"), F.lit(0)).cast("int").alias("matched"),
        count("peak_a").alias("count_a"),
        count("peak_b").alias("count_b"),
        num("peak_a_explained_intensity").alias("explained_a"),
        num("peak_b_explained_intensity").alias("explained_b"),
        num("ms2_entropy_similarity").alias("entropy"),
    )


def annotate_results(
    results: DataFrame,
    thresholds: PairThresholds = PairThresholds(),
    preserve: bool = False,
    order: str = "row_no",
) -> DataFrame:
    """Rebuild diagnostics from result scalars and add blank manual columns.

    ``preserve`` keeps supplied diagnostics untouched and only adds what is absent.
    """
    blank = [c for c in MANUAL_COLUMNS if not preserve or c not in results.columns]
    kept = results.withColumn("review_row", F.col(order) + F.lit(1))
    kept = kept.withColumns({c: F.lit("") for c in blank})
    if preserve:
        return kept
    text = text_of(results)
    kept, num = with_numbers(kept, SCORE_NUMBERS)
    ref = rules.ms1_reference(F.nullif(text("Peak1"), F.lit("")), F.nullif(text("Peak2"), F.lit("")))
    d = rules.ms2_diagnosis(
        F.col("_sim"),
        text("enantiomer_pair_status"),
        text("enantiomer_pair_reason"),
        text("peak_a_quality_flags"),
        text("peak_b_quality_flags"),
        num("dia_window_match_count"),
        thresholds,
    )
    out = (
        kept.withColumn("_sim", similarity_from_text(num, text))
        .withColumn("_d", d)
        .withColumn("ms1_reference_status", ref["status"])
        .withColumn("ms1_reference_issue_codes", ref["issue"])
        .withColumn("_issues", F.col("_d.issues"))
        .withColumn("ms2_diagnostic_status", F.col("_d.status"))
        .withColumn("ms2_review_priority", F.col("_d.priority"))
        .drop("_sim", "_d")
    )
    return mark_shared_targets(drop_numbers(out)).drop("_issues")


def mark_shared_targets(rows: DataFrame) -> DataFrame:
    """Add the shared-coordinates code where several compounds use one RT pair and window.

    Group sizes come from a partial aggregate (two distinct compounds are enough to
    decide, and min <> max says so), joined back: no group is gathered anywhere.
    """
    text = text_of(rows)
    both = has_value(text("peak_a_MS2")) & has_value(text("peak_b_MS2"))
    keys = {"_k1": text("Peak1"), "_k2": text("Peak2"), "_k3": text("dia_window_center")}
    keyed = rows.withColumns({**keys, "_both": both})
    groups = (
        keyed.where("_both")
        .groupBy(*keys)
        .agg(
            (F.min(text("Compound_ID")) != F.max(text("Compound_ID"))).alias("_shared")
        )
    )
    joined = keyed.join(groups, list(keys), "left")
    shared = F.col("_both") & F.coalesce(F.col("_shared"), F.lit(False))
    issues = F.when(
        shared, F.array_union("_issues", F.array(F.lit("SHARED_RT_DIA_TARGETS")))
    ).otherwise(F.col("_issues"))
    weaker = rules.priority_rank(F.col("ms2_review_priority")) > 2
    return (
        joined.withColumn("ms2_issue_codes", F.concat_ws(";", issues))
        .withColumn(
            "ms2_review_priority",
            F.when(shared & weaker, rules.PRIORITIES[1]).otherwise(F.col("ms2_review_priority")),
        )
        .drop(*keys, "_both", "_shared")
    )


def review_queue(annotated: DataFrame, max_spectra: int = 0) -> DataFrame:
    """Rows with a spectrum on either side, by priority then compound; 0 keeps all."""
    text = text_of(annotated)
    rows = annotated.where(has_value(text("peak_a_MS2")) | has_value(text("peak_b_MS2")))
    ordered = rows.orderBy(
        rules.priority_rank(F.col("ms2_review_priority")), text("Compound_ID"), "review_row"
    )
    if max_spectra > 0:
        ordered = ordered.limit(max_spectra)
    return ordered.select(*[text(c).alias(c) if c not in annotated.columns else F.col(f"`{c}`") for c in QUEUE_COLUMNS])


def review_summary(annotated: DataFrame) -> DataFrame:
    """(section, name, rows): statuses, issue codes, spectra availability and queue size."""
    text = text_of(annotated)
    a, b = has_value(text("peak_a_MS2")), has_value(text("peak_b_MS2"))
    tags = F.concat(
        F.array(
            F.concat(F.lit("status|"), text("ms2_diagnostic_status")),
            F.lit("rows|all"),
        ),
        F.transform(
            F.filter(F.split(text("ms2_issue_codes"), ";"), lambda c: c != ""),
            lambda c: F.concat(F.lit("issue|"), c),
        ),
        rules.codes(
            (a & b, "spectra|two"), (a != b, "spectra|one"), (a | b, "queue|manual_queue_rows")
        ),
    )
    return (
        annotated.select(F.explode_outer(tags).alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("rows"))
        .select(
            F.substring_index("tag", "|", 1).alias("section"),
            F.substring_index("tag", "|", -1).alias("name"),
            "rows",
        )
    )


def coverage_view(issue_codes: Column, match_count: Column, mz: Column, lower: Column, upper: Column) -> Column:
    """Where a target lies relative to the acquired isolation windows."""
    missed = F.array_contains(F.split(F.coalesce(issue_codes, F.lit("")), ";"), "NO_ACQUIRED_DIA_WINDOW")
    base = "acquisition_coverage/"
    inside = F.when(F.coalesce(match_count, F.lit(0)) != 0, base + "within_acquired_window").otherwise("")
    gap = (
        F.when(mz < lower, base + "no_dia_window/below_acquired_range")
        .when(mz > upper, base + "no_dia_window/above_acquired_range")
        .otherwise(base + "no_dia_window/internal_gap")
    )
    return F.when(missed & lower.isNotNull(), gap).otherwise(inside)
