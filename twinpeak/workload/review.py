"""Queries over result tables: comparison, annotation, queue, views; and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..operators import compare, effects
from ..sources import projections as proj
from . import sqltext as sql
from .evidence import ms2_run, r6, unnest


def _res_sql(name: str, variant: int) -> str:
    cols = ", ".join(f'{e} AS "{n}"' for n, e in proj.result_expressions(variant).items())
    return f"{name} AS (SELECT {cols} FROM orders)"


_KEYS = ", ".join(f'trim("{k}")' for k in compare.KEY_COLUMNS)


def _pair_sql() -> str:
    return f"""
bk AS (SELECT *, concat_ws('|', {_KEYS}) AS key, row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_no) AS rn FROM base),
ck AS (SELECT *, concat_ws('|', {_KEYS}) AS key, row_number() OVER (PARTITION BY {_KEYS} ORDER BY row_no) AS rn FROM cand),
paired AS (
  SELECT b.row_no AS base_row, c.row_no AS cand_row,
    b.ms2_diagnostic_status AS bs, c.ms2_diagnostic_status AS cs,
    b.ms2_diagnostic_status <> c.ms2_diagnostic_status AS sc,
    b."peak_a_MS2" <> c."peak_a_MS2" AS ac, b."peak_b_MS2" <> c."peak_b_MS2" AS bc,
    try_cast(c.rt_separation_sec AS DOUBLE) AS sep,
    try_cast(c.peak_a_apex_rt AS DOUBLE) AS apa, try_cast(c.peak_b_apex_rt AS DOUBLE) AS apb,
    try_cast(c.peak_a_rt_window_start AS DOUBLE) AS sa, try_cast(c.peak_a_rt_window_end AS DOUBLE) AS ea,
    try_cast(c.peak_b_rt_window_start AS DOUBLE) AS sb, try_cast(c.peak_b_rt_window_end AS DOUBLE) AS eb,
    try_cast(c."Peak1" AS DOUBLE) AS p1, try_cast(c."Peak2" AS DOUBLE) AS p2,
    try_cast(c.peak_a_fragment_count AS DOUBLE) AS na, try_cast(c.peak_b_fragment_count AS DOUBLE) AS nb,
    try_cast(c.ms2_matched_peaks AS DOUBLE) AS cm, try_cast(b.ms2_matched_peaks AS DOUBLE) AS bm,
    try_cast(c.ms2_cosine AS DOUBLE) AS cc, try_cast(b.ms2_cosine AS DOUBLE) AS bcos,
    try_cast(c.peak_a_explained_intensity AS DOUBLE) AS xa, try_cast(c.peak_b_explained_intensity AS DOUBLE) AS xb
  FROM bk b FULL JOIN ck c ON b.key = c.key AND b.rn = c.rn)
"""


def _runs(spark, d):
    return proj.result_rows(spark, d, 0), proj.result_rows(spark, d, 1)


def run_comparison(spark, d):
    queue, _ = compare.compare_runs(*_runs(spark, d))
    return queue.select(
        "row_no", "comparison_change_level", "comparison_baseline_status",
        "comparison_candidate_status", "comparison_peak_a_spectrum_changed",
        "comparison_peak_b_spectrum_changed", "comparison_review_tier", "comparison_review_flags",
        r6("comparison_matched_peak_delta"), r6("comparison_cosine_delta"),
    )


RUN_COMPARISON_SQL = sql.with_ctes(
    _res_sql("base", 0), _res_sql("cand", 1), _pair_sql(),
    """fl AS (SELECT *, concat_ws(';',
      CASE WHEN sep < 30 THEN 'CLOSE_RT_PAIR_LT30S' END,
      CASE WHEN abs(apa - p1 * 60) > 6 THEN 'PEAK1_APEX_OFFSET_GT6S' END,
      CASE WHEN least(abs(apa - sa), abs(apa - ea)) < 2 THEN 'PEAK1_APEX_NEAR_WINDOW_EDGE_LT2S' END,
      CASE WHEN abs(apb - p2 * 60) > 6 THEN 'PEAK2_APEX_OFFSET_GT6S' END,
      CASE WHEN least(abs(apb - sb), abs(apb - eb)) < 2 THEN 'PEAK2_APEX_NEAR_WINDOW_EDGE_LT2S' END,
      CASE WHEN na IS NOT NULL AND nb IS NOT NULL AND greatest(na, nb) / least(na, nb) > 4 THEN 'FRAGMENT_COUNT_IMBALANCE_GT4X' END) AS flags
      FROM paired WHERE base_row IS NOT NULL AND cand_row IS NOT NULL AND (sc OR ac OR bc))""",
    select="""SELECT cand_row AS row_no,
    CASE WHEN sc AND (ac OR bc) THEN 'status_and_spectrum' WHEN sc THEN 'status_only' ELSE 'spectrum_only' END AS comparison_change_level,
    bs AS comparison_baseline_status, cs AS comparison_candidate_status, ac AS comparison_peak_a_spectrum_changed,
    bc AS comparison_peak_b_spectrum_changed,
    CASE WHEN cs = 'supported_same_compound' AND cc >= 0.9 AND cm >= 8 AND cm - coalesce(bm, 0) >= 3 AND xa >= 0.8 AND xb >= 0.8 AND flags = ''
         THEN 'strong_shadow_support_candidate' WHEN cs = 'supported_same_compound' THEN 'manual_supported_boundary'
         WHEN cs = 'conflicting_spectra' THEN 'manual_conflict' WHEN sc THEN 'manual_parameter_flip'
         ELSE 'stable_status_spectrum_changed' END AS comparison_review_tier,
    flags AS comparison_review_flags, round(cm - bm, 6) AS comparison_matched_peak_delta, round(cc - bcos, 6) AS comparison_cosine_delta
    FROM fl""",
)


def run_comparison_summary(spark, d):
    # Each run measured some targets at another m/z, so rows stay unmatched on both sides.
    base, cand = _runs(spark, d)
    moved = lambda df, mz: df.withColumn("MZ", F.when(F.col("MZ") == mz, mz + ".5").otherwise(F.col("MZ")))
    return compare.run_summary(moved(base, "281"), moved(cand, "282"))


RUN_SUMMARY_SQL = sql.with_ctes(
    _res_sql("base0", 0), _res_sql("cand0", 1),
    """base AS (SELECT * REPLACE (CASE WHEN "MZ" = '281' THEN '281.5' ELSE "MZ" END AS "MZ") FROM base0)""",
    """cand AS (SELECT * REPLACE (CASE WHEN "MZ" = '282' THEN '282.5' ELSE "MZ" END AS "MZ") FROM cand0)""",
    _pair_sql(),
    select="""SELECT count(*) FILTER (base_row IS NOT NULL AND cand_row IS NOT NULL) AS matched_rows,
    count(*) FILTER (cand_row IS NULL) AS baseline_only_rows, count(*) FILTER (base_row IS NULL) AS candidate_only_rows,
    count(*) FILTER (base_row IS NOT NULL AND cand_row IS NOT NULL AND sc) AS status_changed_rows,
    count(*) FILTER (base_row IS NOT NULL AND cand_row IS NOT NULL AND (ac OR bc)) AS spectrum_changed_rows,
    count(*) FILTER (base_row IS NOT NULL AND cand_row IS NOT NULL AND (sc OR ac OR bc)) AS queued_rows FROM paired""",
)


def _annotated(spark, d):
    return compare.annotate_results(proj.result_rows(spark, d, 0))


_ANN = (
    _res_sql("base", 0),
    """judged AS (SELECT row_no, "Compound_ID" AS compound, "Peak1" AS peak1, "Peak2" AS peak2, "MZ" AS mz,
      dia_window_center AS centre, "peak_a_MS2" AS sa, "peak_b_MS2" AS sb,
      enantiomer_pair_status AS status, enantiomer_pair_reason AS reason, peak_a_quality_flags AS flags_a,
      peak_b_quality_flags AS flags_b, try_cast(dia_window_match_count AS DOUBLE) AS window_matches,
      try_cast(ms2_cosine AS DOUBLE) AS cosine, coalesce(try_cast(ms2_matched_peaks AS DOUBLE), 0) AS matched,
      coalesce(try_cast(peak_a_fragment_count AS DOUBLE), 1) AS count_a, coalesce(try_cast(peak_b_fragment_count AS DOUBLE), 1) AS count_b,
      try_cast(peak_a_explained_intensity AS DOUBLE) AS explained_a, try_cast(peak_b_explained_intensity AS DOUBLE) AS explained_b
      FROM base)""",
    sql.DIAGNOSIS,
    """grp AS (SELECT peak1, peak2, centre, count(DISTINCT compound) > 1 AS shared FROM final WHERE sa <> '' AND sb <> '' GROUP BY 1, 2, 3)""",
    """ann AS (SELECT f.*, coalesce(g.shared, false) AND sa <> '' AND sb <> '' AS shared,
      CASE WHEN coalesce(g.shared, false) AND sa <> '' AND sb <> '' THEN concat_ws(';', nullif(issues, ''), 'SHARED_RT_DIA_TARGETS') ELSE issues END AS codes,
      CASE WHEN coalesce(g.shared, false) AND sa <> '' AND sb <> '' AND priority > 'P2_boundary_or_interference' THEN 'P2_boundary_or_interference' ELSE priority END AS prio,
      CASE WHEN f.peak1 <> '' AND f.peak2 <> '' THEN 'supplied_double_peak' WHEN f.peak1 <> '' OR f.peak2 <> '' THEN 'supplied_single_peak' ELSE 'no_supplied_peak' END AS ms1
      FROM final f LEFT JOIN grp g ON g.peak1 = f.peak1 AND g.peak2 = f.peak2 AND g.centre = f.centre)""",
)


def annotate_results(spark, d):
    return _annotated(spark, d).select(
        "row_no", "review_row", "ms1_reference_status", "ms2_diagnostic_status", "ms2_issue_codes",
        "ms2_review_priority",
    )


ANNOTATE_SQL = sql.with_ctes(
    *_ANN,
    select="""SELECT row_no, row_no + 1 AS review_row, ms1 AS ms1_reference_status, diagnostic AS ms2_diagnostic_status,
    codes AS ms2_issue_codes, prio AS ms2_review_priority FROM ann""",
)


def shared_targets(spark, d):
    return (
        _annotated(spark, d)
        .where(F.array_contains(F.split("ms2_issue_codes", ";"), "SHARED_RT_DIA_TARGETS"))
        .groupBy("Peak1", "Peak2", "dia_window_center")
        .agg(F.count("*").alias("rows"))
    )


SHARED_SQL = sql.with_ctes(
    *_ANN,
    select="""SELECT peak1 AS "Peak1", peak2 AS "Peak2", centre AS dia_window_center, count(*) AS rows
    FROM ann WHERE shared GROUP BY 1, 2, 3""",
)


def review_queue_top(spark, d):
    return compare.review_queue(_annotated(spark, d), 100).select(
        "review_row", "Compound_ID", "ms2_review_priority", "ms2_issue_codes", "peak_a_MS2"
    )


REVIEW_QUEUE_SQL = sql.with_ctes(
    *_ANN,
    select="""SELECT row_no + 1 AS review_row, compound AS "Compound_ID", prio AS ms2_review_priority, codes AS ms2_issue_codes,
    sa AS "peak_a_MS2" FROM ann WHERE sa <> '' OR sb <> '' ORDER BY prio, compound, row_no LIMIT 100""",
)


def review_summary(spark, d):
    return compare.review_summary(_annotated(spark, d))


REVIEW_SUMMARY_SQL = sql.with_ctes(
    *_ANN,
    select="""SELECT 'status' AS section, diagnostic AS name, count(*) AS rows FROM ann GROUP BY 2
    UNION ALL SELECT 'rows', 'all', count(*) FROM ann
    UNION ALL SELECT 'issue', c, count(*) FROM (SELECT unnest(string_split(codes, ';')) AS c FROM ann WHERE codes <> '') GROUP BY c
    UNION ALL SELECT 'spectra', 'two', count(*) FROM ann WHERE sa <> '' AND sb <> ''
    UNION ALL SELECT 'spectra', 'one', count(*) FROM ann WHERE (sa <> '') <> (sb <> '')
    UNION ALL SELECT 'queue', 'manual_queue_rows', count(*) FROM ann WHERE sa <> '' OR sb <> ''""",
)


def coverage_view(spark, d):
    bounds = ms2_run(spark, d).windows.agg(F.min("iso_lo").alias("lo"), F.max("iso_hi").alias("hi"))
    rows = proj.result_rows(spark, d, 0).crossJoin(F.broadcast(bounds))  # one row
    view = compare.coverage_view(
        F.col("ms2_issue_codes"), scalars.number(F.col("dia_window_match_count")),
        scalars.number(F.col("MZ")), F.col("lo"), F.col("hi"),
    )
    return rows.groupBy(view.alias("view")).agg(F.count("*").alias("rows"))


COVERAGE_SQL = sql.with_ctes(
    sql.MS2, _res_sql("base", 0), "bd AS (SELECT min(lo) AS lo, max(hi) AS hi FROM wins)",
    select="""SELECT CASE WHEN ms2_issue_codes = 'NO_ACQUIRED_DIA_WINDOW' THEN
      CASE WHEN CAST("MZ" AS DOUBLE) < lo THEN 'acquisition_coverage/no_dia_window/below_acquired_range'
           WHEN CAST("MZ" AS DOUBLE) > hi THEN 'acquisition_coverage/no_dia_window/above_acquired_range'
           ELSE 'acquisition_coverage/no_dia_window/internal_gap' END
      ELSE 'acquisition_coverage/within_acquired_window' END AS view, count(*) AS rows
    FROM base CROSS JOIN bd GROUP BY 1""",
)


def ms2_views(spark, d):
    rows, num = compare.with_numbers(_annotated(spark, d), compare.VIEW_NUMBERS)
    facts = rules.view_facts(compare.text_of(rows), num)
    # Folders are named once for all rows with the same facts, which are few.
    alike = rows.select("row_no", *[c.alias(name) for name, c in facts.items()]).groupBy(*facts).agg(
        F.count("*").alias("n"), F.sum("row_no").alias("ids")
    )
    views = rules.views_of({name: F.col(name) for name in facts})
    return unnest(alike, ["n", "ids"], views).groupBy(F.col("p").alias("view")).agg(
        F.sum("n").alias("rows"), F.sum("ids").cast("bigint").alias("id_sum")
    )


MS2_VIEWS_SQL = sql.with_ctes(
    *_ANN,
    """vr AS (SELECT a.*, b.ml_diagnostic_status AS ml, try_cast(b.rt_separation_sec AS DOUBLE) AS sep,
      least(try_cast(b.peak_a_fragment_count AS DOUBLE) / try_cast(b.peak_a_candidate_fragment_count AS DOUBLE),
            try_cast(b.peak_b_fragment_count AS DOUBLE) / try_cast(b.peak_b_candidate_fragment_count AS DOUBLE)) AS keep,
      least(abs(try_cast(b.peak_a_apex_rt AS DOUBLE) - try_cast(b.peak_a_rt_window_start AS DOUBLE)),
            abs(try_cast(b.peak_a_apex_rt AS DOUBLE) - try_cast(b.peak_a_rt_window_end AS DOUBLE)),
            abs(try_cast(b.peak_b_apex_rt AS DOUBLE) - try_cast(b.peak_b_rt_window_start AS DOUBLE)),
            abs(try_cast(b.peak_b_apex_rt AS DOUBLE) - try_cast(b.peak_b_rt_window_end AS DOUBLE))) AS edge,
      CASE WHEN sa <> '' AND sb <> '' THEN 'two_spectra' WHEN sa <> '' THEN 'peak1_only' WHEN sb <> '' THEN 'peak2_only' ELSE 'no_spectra' END AS av,
      CASE WHEN diagnostic = 'not_attempted' THEN 'not_evaluable' ELSE diagnostic END AS v2
      FROM ann a JOIN base b ON a.row_no = b.row_no)""",
    """vw AS (SELECT row_no, unnest(list_filter(list_concat(
      list_transform(list_filter(string_split(codes, ';'), lambda c: c <> ''), lambda c: 'issue_codes/' || c),
      ['diagnostic_status/' || diagnostic, 'review_priority/' || prio, 'spectrum_availability/' || av,
       CASE WHEN prio[1:2] IN ('P1', 'P2', 'P3') THEN 'review_queues/core_manual_review' END,
       CASE WHEN prio = 'P4_supported_audit' THEN 'review_queues/supported_random_audit' END,
       CASE WHEN av IN ('peak1_only', 'peak2_only') THEN 'review_queues/one_sided_spectrum' END,
       CASE WHEN contains(codes, 'NO_ACQUIRED_DIA_WINDOW') THEN 'review_queues/dia_coverage_gap' END,
       CASE WHEN contains(codes, 'EMPTY_ONE_OR_BOTH_SPECTRA') THEN 'review_queues/empty_spectrum' END,
       CASE WHEN contains(codes, 'NEAR_DECISION_BOUNDARY') THEN 'review_queues/near_decision_boundary' END,
       CASE WHEN contains(codes, 'OVERLAPPING_DIA_WINDOWS') OR shared THEN 'review_queues/possible_dia_interference' END,
       CASE WHEN diagnostic = 'conflicting_spectra' THEN 'review_queues/spectral_conflict' END,
       CASE WHEN contains(codes, 'TOO_FEW_MATCHED_FRAGMENTS') THEN 'review_queues/low_matched_fragments' END,
       CASE WHEN contains(codes, 'LOW_EXPLAINED_INTENSITY') THEN 'review_queues/low_explained_intensity' END,
       CASE WHEN contains(codes, 'ASYMMETRIC_UNMATCHED_INTENSITY') THEN 'review_queues/asymmetric_unmatched_intensity' END,
       CASE WHEN sep <= 20 THEN 'review_queues/close_rt_pair_le20s' END,
       CASE WHEN cosine >= 0.7 AND matched < 6 THEN 'review_queues/high_similarity_but_sparse_lt6_matches' END,
       CASE WHEN keep < 0.05 THEN 'review_queues/extreme_fragment_attrition_lt5pct' END,
       CASE WHEN edge <= 1 THEN 'review_queues/apex_near_rt_window_edge' END,
       CASE WHEN ms1 = 'supplied_double_peak' AND diagnostic = 'conflicting_spectra' THEN 'cross_stage_followup/ms1_supplied_double_ms2_conflict' END,
       'ml_diagnostic_status/' || ml, 'ml_model/UNTRAINED', 'shadow_comparison/transition/' || v2 || '_to_' || ml,
       CASE WHEN v2 <> ml THEN 'review_queues/v2_ml_disagreement' END,
       CASE WHEN ml = 'insufficient_evidence' THEN 'review_queues/ml_abstention' END,
       CASE WHEN ml = 'not_evaluable' THEN 'review_queues/ml_not_evaluable' END]), lambda v: v IS NOT NULL)) AS view FROM vr)""",
    select="SELECT view, count(*) AS rows, CAST(sum(row_no) AS BIGINT) AS id_sum FROM vw GROUP BY view",
)


def transition_matrix(spark, d):
    rows = proj.result_rows(spark, d, 0)
    return rows.groupBy(
        rules.comparison_status(F.col("ms2_diagnostic_status")).alias("v2_status"),
        F.col("ml_diagnostic_status").alias("ml_status"),
    ).agg(F.count("*").alias("rows"))


TRANSITION_SQL = sql.with_ctes(
    _res_sql("base", 0),
    select="""SELECT CASE WHEN ms2_diagnostic_status = 'not_attempted' THEN 'not_evaluable' ELSE ms2_diagnostic_status END AS v2_status,
    ml_diagnostic_status AS ml_status, count(*) AS rows FROM base GROUP BY 1, 2""",
)


def compound_status_lookup(spark, d):
    from ..operators.ms1_review import ms2_status_lookup

    rows = proj.result_rows(spark, d, 0).withColumnRenamed("Compound_ID", "compound_id")
    return ms2_status_lookup(rows)


LOOKUP_SQL = sql.with_ctes(
    _res_sql("base", 0),
    select="""SELECT "Compound_ID" AS compound_id, arg_max(ms2_diagnostic_status, row_no) AS ms2_status FROM base GROUP BY 1""",
)

# ---- statistics ----------------------------------------------------------------------


def _replicates(spark, d):
    return proj.table(spark, d, "events").select(
        "user_id", "event_type", F.col("value"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("input"),
        F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("eluate"),
    )


def replicate_summary(spark, d):
    rows = effects.replicate_summary(_replicates(spark, d), ["user_id", "event_type"], "value")
    return rows.select("user_id", "event_type", "n", r6("mean"), r6("sd"), r6("cv"))


REPLICATE_SQL = """
SELECT user_id, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
  CASE WHEN avg(value) <> 0 THEN round(stddev_samp(value) / abs(avg(value)), 6) END AS cv
FROM events GROUP BY 1, 2
"""


def effect_sizes(spark, d):
    g = _replicates(spark, d).groupBy("user_id").agg(
        *[
            F.sum(F.when(F.col("event_type") == t, F.col(c))).alias(f"{c}_{t}")
            for c in ("input", "eluate")
            for t in ("click", "view")
        ],
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("target"),
        F.avg(F.when(F.col("event_type") == "error", F.col("value"))).alias("control"),
    )
    in1, in2, out1, out2 = (F.col(c) for c in ("input_click", "input_view", "eluate_click", "eluate_view"))
    return g.select(
        "user_id",
        r6("enrichment", effects.enrichment_fold(F.col("target"), F.col("control"), 1.0)),
        r6("recovery", effects.recovery_fold(in1, out1, 0.5)),
        r6("input_fraction", effects.enantiomer_fraction(in1, in2)),
        r6("fraction_shift", effects.fraction_shift(in1, in2, out1, out2)),
        r6("log2_shift", effects.log2_ratio_shift(in1, in2, out1, out2, 1.0)),
    )


EFFECT_SQL = """
WITH g AS (
  SELECT user_id,
    sum(value) FILTER (event_id % 2 = 0 AND event_type = 'click') AS i1, sum(value) FILTER (event_id % 2 = 0 AND event_type = 'view') AS i2,
    sum(value) FILTER (event_id % 2 = 1 AND event_type = 'click') AS o1, sum(value) FILTER (event_id % 2 = 1 AND event_type = 'view') AS o2,
    max(value) FILTER (event_type = 'click') AS t, avg(value) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id)
SELECT user_id, round((t + 1) / (c + 1), 6) AS enrichment, round((o1 + 0.5::DOUBLE) / (i1 + 0.5::DOUBLE), 6) AS recovery,
  round(i1 / (i1 + i2), 6) AS input_fraction, round(o1 / (o1 + o2) - i1 / (i1 + i2), 6) AS fraction_shift,
  round((log2(o1 + 1) - log2(o2 + 1)) - (log2(i1 + 1) - log2(i2 + 1)), 6) AS log2_shift FROM g
"""


def bh_adjust(spark, d):
    rows = effects.benjamini_hochberg(proj.pvalues(spark, d))
    return rows.select("test_id", "p", r6("p_adjusted"))


BH_SQL = """
WITH q AS (SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 11 <> 0 THEN ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE END AS p FROM orders),
r AS (SELECT test_id, p, row_number() OVER (ORDER BY p, test_id) AS rk, count(*) OVER () AS m FROM q WHERE p IS NOT NULL),
a AS (SELECT test_id, least(1.0::DOUBLE, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
SELECT q.test_id, q.p, round(a.adj, 6) AS p_adjusted FROM q LEFT JOIN a ON a.test_id = q.test_id
"""

# ---- hashes and small scalars --------------------------------------------------------


def hash_split(spark, d):
    bucket = scalars.hash_bucket(F.col("c_name"))
    return proj.table(spark, d, "customer").select(
        "c_custkey", F.when(bucket == 0, "test").otherwise("calibration").alias("role")
    )


HASH_SPLIT_SQL = """
SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(c_name), 1, 2))::INT % 5 = 0 THEN 'test' ELSE 'calibration' END AS role FROM customer
"""


def target_uids(spark, d):
    t = proj.targets(spark, d)
    pool, name, rid = F.col("pool"), F.col("compound_id"), F.col("row_id")
    blank = F.lit("")
    return t.select(
        "row_id",
        scalars.target_uid_ms1(F.lit("run1"), name, pool, F.col("mz"), blank, blank).alias("uid_ms1"),
        scalars.target_uid_ms2(F.lit("run1"), name, pool, rid, blank, blank).alias("uid_ms2"),
    )


UID_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS,
    select="""SELECT row_id, substr(sha256('run1|' || compound_id || '|' || pool || '|' || printf('%.8f', mz) || '||'), 1, 12) AS uid_ms1,
    substr(sha256('run1|' || compound_id || '|' || pool || '|' || row_id || '||'), 1, 12) AS uid_ms2 FROM tg""",
)


def source_labels(spark, d):
    label = F.when(F.col("o_orderkey") % 5 == 0, " green ").when(F.col("o_orderkey") % 5 == 1, "Yellow").when(
        F.col("o_orderkey") % 5 == 2, "RED").when(F.col("o_orderkey") % 5 == 3, "check")
    rows = proj.table(spark, d, "orders").select(
        scalars.source_label_meaning(label).alias("meaning"),
        scalars.folder_component(F.col("o_orderpriority")).alias("folder"),
        scalars.duration_seconds(
            F.concat(F.lit("PT"), F.col("o_orderkey") % 3, F.lit("M"), F.col("o_orderkey") % 60, F.lit(".5S"))
        ).alias("seconds"),
    )
    return rows.groupBy("meaning", "folder").agg(F.count("*").alias("rows"), F.sum("seconds").alias("seconds"))


SOURCE_LABELS_SQL = """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'expected_double_peak' WHEN 1 THEN 'expected_single_peak' WHEN 2 THEN 'unusable_no_peak_or_multiple_peak'
  WHEN 3 THEN 'manual_review_needed' ELSE 'unrecognised_or_unlabelled' END AS meaning,
  regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') AS folder, count(*) AS rows,
  sum((o_orderkey % 3) * 60 + (o_orderkey % 60) + 0.5::DOUBLE) AS seconds FROM orders GROUP BY 1, 2
"""


def raw_attribute_histogram(spark, d):
    from ..sources.rawscans import attribute_histogram

    pages = proj.table(spark, d, "pages").select(F.lit("pages").alias("raw_id"), F.col("html").alias("value"))
    return attribute_histogram(pages, ("lang", "class", "charset")).select("key", "value", "rows")


ATTRIBUTE_SQL = """
WITH m AS (SELECT unnest(regexp_extract_all(html, '\\b(lang|class|charset)\\s*=\\s*"([^"]*)"')) AS t FROM pages)
SELECT trim(string_split(t, '=')[1]) AS key, regexp_extract(t, '"([^"]*)"', 1) AS value, count(*) AS rows FROM m GROUP BY 1, 2
"""

QUERIES = {
    "run_comparison": (run_comparison, RUN_COMPARISON_SQL),
    "run_comparison_summary": (run_comparison_summary, RUN_SUMMARY_SQL),
    "annotate_results": (annotate_results, ANNOTATE_SQL),
    "shared_targets": (shared_targets, SHARED_SQL),
    "review_queue_top": (review_queue_top, REVIEW_QUEUE_SQL),
    "review_summary": (review_summary, REVIEW_SUMMARY_SQL),
    "coverage_view": (coverage_view, COVERAGE_SQL),
    "ms2_views": (ms2_views, MS2_VIEWS_SQL),
    "transition_matrix": (transition_matrix, TRANSITION_SQL),
    "compound_status_lookup": (compound_status_lookup, LOOKUP_SQL),
    "replicate_summary": (replicate_summary, REPLICATE_SQL),
    "effect_sizes": (effect_sizes, EFFECT_SQL),
    "bh_adjust": (bh_adjust, BH_SQL),
    "hash_split": (hash_split, HASH_SPLIT_SQL),
    "target_uids": (target_uids, UID_SQL),
    "source_labels": (source_labels, SOURCE_LABELS_SQL),
    "raw_attribute_histogram": (raw_attribute_histogram, ATTRIBUTE_SQL),
}
