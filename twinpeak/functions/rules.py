"""Rule classification: status vocabularies, issue codes, priorities and view fan-out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PairThresholds
from .scalars import folder_component, has_value

# Review priority vocabulary in rank order.
PRIORITIES = (
    "P1_conflict",
    "P2_boundary_or_interference",
    "P3_insufficient",
    "P4_supported_audit",
    "P5_not_evaluable",
)
# Diagnostic statuses in report order.
DIAGNOSTIC_STATUSES = (
    "supported_same_compound",
    "conflicting_spectra",
    "insufficient_evidence",
    "not_evaluable",
    "not_attempted",
)
# Fixed value: reason text of a pair that passes every threshold.
SUPPORTED_REASON = (
    "separated_same_precursor_peaks_with_similar_ms2;"
    "R_S_assignment_requires_authentic_enantiomer_standards"
)
ENRICHMENT_STATUS = "not_assessed_requires_input_eluate_replicates"
# Pair status -> (compound identity status, chiral doublet status).
LAYERS = {
    "candidate_enantiomer_pair": ("ms2_supported_same_compound", "candidate_chiral_doublet"),
    "ms2_not_similar": ("ms2_conflict", "not_supported"),
    "insufficient_ms2_evidence": ("insufficient_ms2_evidence", "not_evaluable"),
}
# Diagnostic status -> pair status of the older three-column output.
PAIR_OF_DIAGNOSTIC = {
    "supported_same_compound": "candidate_enantiomer_pair",
    "conflicting_spectra": "ms2_not_similar",
    "insufficient_evidence": "insufficient_ms2_evidence",
}
INTERFERENCE_CODES = (
    "OVERLAPPING_DIA_WINDOWS",
    "NEAR_DECISION_BOUNDARY",
    "ASYMMETRIC_UNMATCHED_INTENSITY",
    "SHARED_RT_DIA_TARGETS",
)


def lookup(c: Column, mapping: dict[str, str], default) -> Column:
    known = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(known, c), fallback)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def codes(*rules: tuple[Column, str]) -> Column:
    """Ordered array of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def pair_status(sim: Column, t: PairThresholds = PairThresholds()) -> Column:
    """Struct(status, reason) for one similarity struct."""
    explained = F.least(_zero(sim["explained_a"]), _zero(sim["explained_b"]))
    rules = [
        (sim["cosine"].isNull(), "not_evaluable", "one_or_both_ms2_spectra_are_empty"),
        (
            sim["matched"] < t.min_matched_peaks,
            "insufficient_ms2_evidence",
            f"matched_peaks<{t.min_matched_peaks}",
        ),
        (sim["cosine"] < t.min_cosine, "ms2_not_similar", f"cosine<{t.min_cosine:g}"),
    ]
    if t.min_entropy_similarity is not None:
        rules.append(
            (
                _zero(sim["entropy"]) < t.min_entropy_similarity,
                "ms2_not_similar",
                f"entropy_similarity<{t.min_entropy_similarity:g}",
            )
        )
    rules.append(
        (
            explained < t.min_explained_intensity,
            "ms2_not_similar",
            f"explained_intensity<{t.min_explained_intensity:g}",
        )
    )
    out = None
    for cond, status, reason in rules:
        value = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(
        F.struct(
            F.lit("candidate_enantiomer_pair").alias("status"),
            F.lit(SUPPORTED_REASON).alias("reason"),
        )
    )


def ms1_reference(rt_a: Column, rt_b: Column) -> Column:
    """Struct(status, issue): which reference RTs were supplied at all."""
    n = F.when(has_value(rt_a), 1).otherwise(0) + F.when(has_value(rt_b), 1).otherwise(0)

    def row(status, issue):
        return F.struct(F.lit(status).alias("status"), F.lit(issue).alias("issue"))

    return (
        F.when(n == 2, row("supplied_double_peak", ""))
        .when(n == 1, row("supplied_single_peak", "MS1_ONLY_ONE_RT"))
        .otherwise(row("no_supplied_peak", "MS1_NO_RT"))
    )


def review_priority(status: Column, issues: Column) -> Column:
    interference = F.arrays_overlap(issues, F.array(*[F.lit(c) for c in INTERFERENCE_CODES]))
    return (
        F.when(status == "conflicting_spectra", PRIORITIES[0])
        .when(interference, PRIORITIES[1])
        .when(status == "insufficient_evidence", PRIORITIES[2])
        .when(status == "supported_same_compound", PRIORITIES[3])
        .otherwise(PRIORITIES[4])
    )


def priority_rank(c: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.coalesce(c, F.lit("")))
    return F.when(rank > 0, rank).otherwise(F.lit(99))


def ms2_diagnosis(
    sim: Column,
    pair: Column,
    reason: Column,
    flags_a: Column,
    flags_b: Column,
    window_matches: Column,
    t: PairThresholds = PairThresholds(),
) -> Column:
    """Struct(status, issues, priority) from one row's evidence.

    ``sim`` may be NULL (no comparison was made); flags are ';' text.
    """
    reason = F.coalesce(reason, F.lit(""))
    outside = F.contains(reason, F.lit("precursor_outside_acquired_DIA_windows"))
    bad_mz = F.contains(reason, F.lit("invalid_precursor_mz"))
    same_rt = F.contains(reason, F.lit("retention_times_are_identical"))
    not_tried = pair == "not_evaluated"
    blocked = outside | bad_mz | same_rt
    status = (
        F.when(not_tried, "not_attempted")
        .when(blocked, "not_evaluable")
        .when(pair == "candidate_enantiomer_pair", "supported_same_compound")
        .when(pair == "ms2_not_similar", "conflicting_spectra")
        .when(pair == "insufficient_ms2_evidence", "insufficient_evidence")
        .otherwise("not_evaluable")
    )
    quality = F.concat_ws(";", F.coalesce(flags_a, F.lit("")), F.coalesce(flags_b, F.lit("")))

    def flagged(text):
        return F.contains(quality, F.lit(text))

    ea, eb = _zero(sim["explained_a"]), _zero(sim["explained_b"])
    explained = F.least(ea, eb)
    larger = F.greatest(sim["count_a"], sim["count_b"])
    smaller = F.least(sim["count_a"], sim["count_b"])
    compared = sim["cosine"].isNotNull()
    cosine, matched = sim["cosine"], sim["matched"]

    def judge(s):
        low_entropy = (
            F.lit(False)
            if t.min_entropy_similarity is None
            else _zero(sim["entropy"]) < t.min_entropy_similarity
        )
        near = (
            (cosine < t.min_cosine + 0.1)
            | (matched <= t.min_matched_peaks + 1)
            | (explained < t.min_explained_intensity + 0.1)
        )
        issues = F.array_distinct(
            codes(
                (not_tried, "MS2_NOT_ATTEMPTED_NO_RT_PAIR"),
                (~not_tried & outside, "NO_ACQUIRED_DIA_WINDOW"),
                (~not_tried & ~outside & bad_mz, "INVALID_PRECURSOR_MZ"),
                (~not_tried & ~outside & ~bad_mz & same_rt, "IDENTICAL_RT_COORDINATES"),
                (flagged("no_matching_DIA_window"), "NO_ACQUIRED_DIA_WINDOW"),
                (flagged("no_precursor_signal"), "NO_PRECURSOR_SIGNAL"),
                (
                    flagged("no_fragments") | F.contains(reason, F.lit("spectra_are_empty")),
                    "EMPTY_ONE_OR_BOTH_SPECTRA",
                ),
                (compared & (matched < t.min_matched_peaks), "TOO_FEW_MATCHED_FRAGMENTS"),
                (compared & (cosine < t.min_cosine), "LOW_COSINE_SIMILARITY"),
                (compared & low_entropy, "LOW_ENTROPY_SIMILARITY"),
                (compared & (explained < t.min_explained_intensity), "LOW_EXPLAINED_INTENSITY"),
                (
                    compared & (larger >= 8) & (larger >= 3 * F.greatest(smaller, F.lit(1))),
                    "FRAGMENT_COUNT_IMBALANCE",
                ),
                (
                    compared
                    & (matched >= t.min_matched_peaks)
                    & (F.abs(ea - eb) >= 0.15)
                    & (explained < 0.85),
                    "ASYMMETRIC_UNMATCHED_INTENSITY",
                ),
                (
                    compared & (s == "supported_same_compound") & near,
                    "NEAR_DECISION_BOUNDARY",
                ),
                (F.coalesce(window_matches.cast("int") > 1, F.lit(False)), "OVERLAPPING_DIA_WINDOWS"),
            )
        )
        return issues

    return F.struct(
        status.alias("status"),
        judge(status).alias("issues"),
        review_priority(status, judge(status)).alias("priority"),
    )


def status_layers(pair: Column) -> dict[str, Column]:
    identity = {k: v[0] for k, v in LAYERS.items()}
    doublet = {k: v[1] for k, v in LAYERS.items()}
    return {
        "compound_identity_status": lookup(pair, identity, "not_evaluable"),
        "chiral_doublet_status": lookup(pair, doublet, "not_evaluable"),
        "enantioselective_enrichment_status": F.lit(ENRICHMENT_STATUS),
    }


def legacy_from_diagnostic(status: Column) -> dict[str, Column]:
    """Older three-column output recovered from the diagnostic status."""
    pair = lookup(status, PAIR_OF_DIAGNOSTIC, "not_evaluable")
    layers = status_layers(pair)
    return {
        "compound_identity_status": layers["compound_identity_status"],
        "chiral_doublet_status": layers["chiral_doublet_status"],
        "enantiomer_pair_status": pair,
    }


def spectrum_availability(ms2_a: Column, ms2_b: Column) -> Column:
    a, b = has_value(ms2_a), has_value(ms2_b)
    return (
        F.when(a & b, "two_spectra")
        .when(a, "peak1_only")
        .when(b, "peak2_only")
        .otherwise("no_spectra")
    )


def comparison_status(status: Column) -> Column:
    """Fold the not-attempted state away when comparing with model statuses."""
    text = F.trim(F.coalesce(status, F.lit("unknown")))
    text = F.when(text == "", "unknown").otherwise(text)
    return F.when(text == "not_attempted", "not_evaluable").otherwise(text)


def attrition_below(row, limit: float = 0.05) -> Column:
    """Either side kept less than ``limit`` of its candidate fragments."""
    def ratio(side):
        cand, kept = row(f"{side}_candidate_fragment_count"), row(f"{side}_fragment_count")
        return F.when((cand > 0) & kept.isNotNull(), kept / cand)

    return F.coalesce(F.least(ratio("peak_a"), ratio("peak_b")) < limit, F.lit(False))


def apex_edge_distance(row, side: str) -> Column:
    apex = row(f"{side}_apex_rt")
    start, end = row(f"{side}_rt_window_start"), row(f"{side}_rt_window_end")
    return F.when(
        apex.isNotNull() & start.isNotNull() & end.isNotNull(),
        F.least(F.abs(apex - start), F.abs(apex - end)),
    )


#: The text cells that name the review folders of an MS2 row.
VIEW_TEXTS = (
    "ms2_diagnostic_status", "ms2_review_priority", "ms2_issue_codes", "source_machine_id",
    "source_pool_id", "source_machine_label", "comparison_review_tier", "comparison_change_level",
    "ml_diagnostic_status", "ml_abstention_reason", "ml_model_id", "ml_review_flags",
    "ms1_reference_status",
)


def view_facts(text, num) -> dict[str, Column]:
    """All that the review folders of an MS2 row depend on; few rows differ in these values.

    ``text(name)`` gives a text column ('' when absent) and ``num(name)`` a lenient double.
    """
    edge = F.least(apex_edge_distance(num, "peak_a"), apex_edge_distance(num, "peak_b")) <= 1.0
    sparse = (num("ms2_cosine") >= 0.7) & (num("ms2_matched_peaks") < 6)
    return {name: text(name) for name in VIEW_TEXTS} | {
        "available": spectrum_availability(text("peak_a_MS2"), text("peak_b_MS2")),
        "sparse": F.coalesce(sparse, F.lit(False)),
        "edge": F.coalesce(edge, F.lit(False)),
        "close": F.coalesce(num("rt_separation_sec") <= 20, F.lit(False)),
        "attrition": attrition_below(num),
    }


def ms2_views(text, num) -> Column:
    """Every review folder one MS2 row belongs to, as an ordered distinct array."""
    return views_of(view_facts(text, num))


def views_of(facts: dict[str, Column]) -> Column:
    """Every review folder of a row with these facts, as an ordered distinct array."""
    folder, text = folder_component, facts.__getitem__

    def path(prefix, c):
        return F.concat(F.lit(prefix + "/"), c)

    raw_status = text("ms2_diagnostic_status")
    status, priority = folder(raw_status), folder(text("ms2_review_priority"), "unassigned")
    available, sparse, edge = facts["available"], facts["sparse"], facts["edge"]
    issues = F.filter(F.split(text("ms2_issue_codes"), ";"), lambda c: c != "")

    def has(code):
        return F.array_contains(issues, code)

    def when(cond, value):
        return F.when(cond, value if isinstance(value, Column) else F.lit(value))

    def queue(cond, name):
        return when(cond, f"review_queues/{name}")

    machine, pool = text("source_machine_id"), text("source_pool_id")
    label = F.when(text("source_machine_label") == "", "UNLABELLED").otherwise(
        text("source_machine_label")
    )
    tier, level = F.trim(text("comparison_review_tier")), F.trim(text("comparison_change_level"))
    ml, reason = F.trim(text("ml_diagnostic_status")), F.trim(text("ml_abstention_reason"))
    model = F.when(text("ml_model_id") == "", "UNTRAINED").otherwise(F.trim(text("ml_model_id")))
    v2 = comparison_status(F.when(raw_status == "", "unknown").otherwise(raw_status))
    flags = F.filter(F.split(text("ml_review_flags"), ";"), lambda c: c != "")
    empty = F.array().cast("array<string>")
    head = F.array(
        path("diagnostic_status", status),
        path("review_priority", priority),
        path("spectrum_availability", available),
    )
    middle = F.array(
        when(machine != "", F.concat_ws("/", F.lit("source_machine"), folder(machine), folder(label))),
        when(pool != "", path("source_pool", folder(pool))),
        queue(priority.isin(*PRIORITIES[:3]), "core_manual_review"),
        queue(priority == PRIORITIES[3], "supported_random_audit"),
        queue(available.isin("peak1_only", "peak2_only"), "one_sided_spectrum"),
        queue(has("NO_ACQUIRED_DIA_WINDOW"), "dia_coverage_gap"),
        queue(has("EMPTY_ONE_OR_BOTH_SPECTRA"), "empty_spectrum"),
        queue(has("NEAR_DECISION_BOUNDARY"), "near_decision_boundary"),
        queue(
            has("OVERLAPPING_DIA_WINDOWS") | has("SHARED_RT_DIA_TARGETS"),
            "possible_dia_interference",
        ),
        queue(status == "conflicting_spectra", "spectral_conflict"),
        queue(has("TOO_FEW_MATCHED_FRAGMENTS"), "low_matched_fragments"),
        queue(has("LOW_EXPLAINED_INTENSITY"), "low_explained_intensity"),
        queue(has("ASYMMETRIC_UNMATCHED_INTENSITY"), "asymmetric_unmatched_intensity"),
        queue(facts["close"], "close_rt_pair_le20s"),
        queue(sparse, "high_similarity_but_sparse_lt6_matches"),
        queue(facts["attrition"], "extreme_fragment_attrition_lt5pct"),
        queue(edge, "apex_near_rt_window_edge"),
        when(
            (text("ms1_reference_status") == "supplied_double_peak")
            & (raw_status == "conflicting_spectra"),
            "cross_stage_followup/ms1_supplied_double_ms2_conflict",
        ),
        when(tier != "", path("shadow_comparison/review_tier", folder(tier))),
        when(level != "", path("shadow_comparison/change_level", folder(level))),
        when(ml != "", path("ml_diagnostic_status", folder(ml))),
        when(ml != "", path("ml_model", folder(model))),
        when(
            ml != "",
            F.concat(
                F.lit("shadow_comparison/transition/"), folder(v2), F.lit("_to_"), folder(ml)
            ),
        ),
        queue((ml != "") & (v2 != ml), "v2_ml_disagreement"),
        queue(ml == "insufficient_evidence", "ml_abstention"),
        queue(ml == "not_evaluable", "ml_not_evaluable"),
        when((ml != "") & (reason != ""), path("ml_abstention_reason", folder(reason))),
    )
    return F.array_distinct(
        F.array_compact(
            F.concat(
                head,
                F.transform(issues, lambda c: path("issue_codes", folder(c))),
                middle,
                F.when(
                    ml != "", F.transform(flags, lambda c: path("ml_review_flags", folder(c)))
                ).otherwise(empty),
            )
        )
    )


def ms1_prediction_diagnostic(
    peak1: Column, peak2: Column, predicted: Column, rts_min: Column, tolerance_min: float = 0.1
) -> Column:
    """Agreement of an automatic call with the reference RTs: class first, then place."""
    reference = reference_class(peak1, peak2)
    expected = F.when(reference == "no_peak", "not_evaluable").otherwise(reference)
    known = F.array_compact(F.array(peak1, peak2))
    close = F.forall(
        F.zip_with(known, rts_min, lambda a, b: F.abs(a - b) <= tolerance_min), lambda ok: ok
    )
    return (
        F.when(~predicted.eqNullSafe(expected), "class_mismatch")
        .when(reference == "no_peak", "exact_agreement")
        .when(F.size(known) != F.size(rts_min), "class_mismatch")
        .when(close, "exact_agreement")
        .otherwise("rt_mislocalized")
    )


def reference_class(peak1: Column, peak2: Column) -> Column:
    return (
        F.when(peak1.isNotNull() & peak2.isNotNull(), "double_peak")
        .when(peak1.isNotNull() | peak2.isNotNull(), "single_peak")
        .otherwise("no_peak")
    )


def ms1_views(row: dict[str, Column]) -> Column:
    """Review folders of one MS1 row; keys name the already computed columns."""
    base, other = row["baseline_diagnostic"], row["experimental_diagnostic"]
    agree = "exact_agreement"
    stable = row["parameter_stability"] == "stable_class_and_rt"
    machine = folder_component(row["source_machine_id"])
    label = folder_component(
        F.when(row["source_machine_label"] == "", "UNLABELLED").otherwise(
            row["source_machine_label"]
        )
    )
    known = row["source_machine_id"] != ""

    def queue(cond, name):
        return F.when(cond, F.lit(f"review_queues/{name}"))

    close = F.coalesce(F.abs(row["peak2"] - row["peak1"]) * 60 < 12, F.lit(False))
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.concat(F.lit("reference_ms1/supplied_rt/"), row["reference_status"]),
                F.concat(F.lit("auto_ms1/baseline/"), row["baseline_status"]),
                F.concat(F.lit("reference_comparison/baseline/"), base),
                F.when(
                    stable,
                    F.concat(F.lit("auto_ms1/consensus_stable/"), row["baseline_status"]),
                ).otherwise(F.concat(F.lit("review_queues/"), row["parameter_stability"])),
                queue(close, "close_or_shoulder_double"),
                queue(row["baseline_status"] == "ambiguous", "baseline_ambiguous"),
                queue(base != agree, "baseline_vs_reference"),
                queue(other != agree, "experimental_vs_reference"),
                queue((base == agree) & (other != agree), "experimental_regression"),
                queue((base != agree) & (other == agree), "experimental_improvement"),
                queue(row["low_clean_candidate"], "low_clean_signal"),
                F.when(known, F.concat_ws("/", F.lit("source_machine"), machine, label)),
                F.when(
                    known
                    & (row["source_interpretation"] == "unusable_no_peak_or_multiple_peak"),
                    F.concat(F.lit("review_queues/source_machine_"), machine, F.lit("_red_unusable")),
                ).when(
                    known & (row["source_interpretation"] == "manual_review_needed"),
                    F.concat(F.lit("review_queues/source_machine_"), machine, F.lit("_check")),
                ),
            )
        )
    )
