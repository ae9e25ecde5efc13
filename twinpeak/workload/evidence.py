"""Queries over spectrum pairs and over the full MS2 pair analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scalars, spectra
from ..operators import chromatograms as xic
from ..operators import dia
from ..params import ExtractionSettings
from ..plans import analyze as plan
from ..sources import projections as proj
from . import sqltext as sql

SETTINGS = ExtractionSettings(rt_half_window_sec=60.0)


def r6(name: str, source=None):
    c = F.col(name) if source is None else source
    return F.round(c, 6).alias(name)


def unnest(df: DataFrame, keep: list[str], array) -> DataFrame:
    """Rows (keep…, pos, p) of an array column.

    The outer form keeps the optimizer from copying a costly array expression into a
    non-emptiness filter below the generator.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("pos", "p"))
    return rows.where(F.col("pos").isNotNull())


def ms2_run(spark: SparkSession, d: str) -> dia.Ms2Run:
    return dia.run_from_peaks(proj.ms2_peaks(spark, d))


def compared(pairs: DataFrame) -> DataFrame:
    """The pairs with ``sim``, worked out once a row.

    An outer generator, because a filter on a score would be pushed below a plain projection with a
    copy of the comparison for every field that it reads.
    """
    sim = spectra.similarity(F.col("peaks_a"), F.col("peaks_b"))
    return pairs.select("*", F.explode_outer(F.array(sim)).alias("sim"))


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compared(proj.spectrum_pairs(spark, d)).select("a", "b", "same", "sim")


def analyzed(spark: SparkSession, d: str, **changes) -> DataFrame:
    return plan.analyze_pairs(
        proj.targets(spark, d), ms2_run(spark, d), SETTINGS.varied(**changes)
    )


# ---- spectra -------------------------------------------------------------------------


def parse_fragments(spark, d):
    text = F.concat(
        F.col("p_partkey"), F.lit(","), F.col("p_retailprice"), F.lit(";bad;"), F.col("p_size"),
        F.lit(",-1;nan,5;1_0,2; "), F.col("p_size"), F.lit(" , "), F.col("p_retailprice"),
        F.lit(";1.5d,3"),
    )
    rows = unnest(proj.table(spark, d, "part"), ["p_partkey"], spectra.parse_fragments(text))
    return rows.select("p_partkey", "pos", r6("mz", F.col("p.mz")), r6("it", F.col("p.it")))


PARSE_SQL = r"""
WITH tok AS (
  SELECT p_partkey, unnest(string_split(p_partkey || ',' || p_retailprice || ';bad;' || p_size
         || ',-1;nan,5;1_0,2; ' || p_size || ' , ' || p_retailprice || ';1.5d,3', ';')) AS t FROM part),
val AS (
  SELECT p_partkey,
    CASE WHEN regexp_full_match(trim(string_split(t, ',')[1]), '[0-9_.+-]+')
         THEN try_cast(replace(trim(string_split(t, ',')[1]), '_', '') AS DOUBLE) END AS mz,
    CASE WHEN regexp_full_match(trim(string_split(t, ',')[2]), '[0-9_.+-]+')
         THEN try_cast(replace(trim(string_split(t, ',')[2]), '_', '') AS DOUBLE) END AS it
  FROM tok WHERE len(string_split(t, ',')) = 2)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY mz, it) - 1 AS INT) AS pos,
       round(mz, 6) AS mz, round(it, 6) AS it
FROM val WHERE mz > 0 AND it > 0
"""


def tolerance_bands(spark, d):
    mz = F.lit(100.0) + F.col("p_partkey") * F.lit(0.25)
    cols = []
    for unit, tol in (("ppm", 10.0), ("Da", 0.01), ("legacy_fraction", 0.0001)):
        lo, hi = scalars.mz_bounds(mz, tol, unit)
        cols += [F.round(lo, 8).alias(f"{unit}_lo"), F.round(hi, 8).alias(f"{unit}_hi")]
    lo, hi = dia.clamped_band(mz, 10.0, "ppm", F.lit(150.0), F.lit(400.0))
    return proj.table(spark, d, "part").select(
        "p_partkey", *cols, F.round(lo, 8).alias("clamped_lo"), F.round(hi, 8).alias("clamped_hi"), (lo >= hi).alias("out_of_range")
    )


TOLERANCE_SQL = """
WITH m AS (SELECT p_partkey, 100.0::DOUBLE + p_partkey * 0.25::DOUBLE AS mz FROM part)
SELECT p_partkey,
  round(mz - mz * 10.0::DOUBLE / 1000000.0::DOUBLE, 8) AS ppm_lo, round(mz + mz * 10.0::DOUBLE / 1000000.0::DOUBLE, 8) AS ppm_hi,
  round(mz - 0.01::DOUBLE, 8) AS "Da_lo", round(mz + 0.01::DOUBLE, 8) AS "Da_hi",
  round(mz - mz * 0.0001::DOUBLE, 8) AS legacy_fraction_lo, round(mz + mz * 0.0001::DOUBLE, 8) AS legacy_fraction_hi,
  round(greatest(150.0::DOUBLE, mz - mz * 10.0::DOUBLE / 1000000.0::DOUBLE), 8) AS clamped_lo,
  round(least(400.0::DOUBLE, mz + mz * 10.0::DOUBLE / 1000000.0::DOUBLE), 8) AS clamped_hi,
  greatest(150.0::DOUBLE, mz - mz * 10.0::DOUBLE / 1000000.0::DOUBLE)
    >= least(400.0::DOUBLE, mz + mz * 10.0::DOUBLE / 1000000.0::DOUBLE) AS out_of_range
FROM m
"""


def spectrum_filter(spark, d):
    kept = spectra.prepare(F.col("peaks"), 0.01)
    return unnest(proj.spectra(spark, d), ["vec_id"], kept).select(
        "vec_id", F.col("pos").alias("idx"), r6("mz", F.col("p.mz")), F.round("p.it", 3).alias("it")
    )


SPECTRUM_FILTER_SQL = sql.with_ctes(
    sql.SPECTRA,
    select="SELECT vec_id, CAST(idx AS INT) AS idx, round(mz, 6) AS mz, round(it, 3) AS it FROM prep",
)


def exclusive_matches(spark, d):
    return unnest(scored_pairs(spark, d), ["a", "b"], F.col("sim.matches")).select(
        "a", "b", F.col("p.i").alias("i"), F.col("p.j").alias("j")
    )


EXCLUSIVE_SQL = sql.with_ctes(
    sql.SPECTRA, sql.CAND_PAIRS, sql.GREEDY,
    select="SELECT a, b, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM matches",
)

_PAIR_CTES = (sql.SPECTRA, sql.CAND_PAIRS, sql.GREEDY, sql.PAIR_SIDES, sql.SCORES)


def pair_similarity(spark, d):
    s = "sim."
    return scored_pairs(spark, d).select(
        "a", "b", F.col(s + "matched").alias("matched"), F.col(s + "count_a").alias("count_a"),
        F.col(s + "count_b").alias("count_b"),
        *[r6(n, F.col(s + n)) for n in ("cosine", "explained_a", "explained_b", "entropy")],
    )


PAIR_SIMILARITY_SQL = sql.with_ctes(
    *_PAIR_CTES,
    select="""SELECT a, b, CAST(matched AS INT) AS matched, CAST(count_a AS INT) AS count_a,
    CAST(count_b AS INT) AS count_b, round(cosine, 6) AS cosine, round(explained_a, 6) AS explained_a,
    round(explained_b, 6) AS explained_b, round(entropy, 6) AS entropy FROM scores""",
)


def _diagnosed_pairs(spark, d):
    q = scored_pairs(spark, d).withColumn("ps", rules.pair_status(F.col("sim")))
    blank = F.lit("")
    return q.select(
        "a", "b", "same", "ps",
        rules.ms2_diagnosis(
            F.col("sim"), F.col("ps.status"), F.col("ps.reason"), blank, blank,
            F.when(F.col("a") % 13 == 0, 2).otherwise(1),
        ).alias("d"),
    )


_DIAG_PAIRS = sql.STATUS.replace(
    "FROM scores)",
    "FROM (SELECT s.*, '' AS flags_a, '' AS flags_b, CASE WHEN s.a % 13 = 0 THEN 2 ELSE 1 END AS window_matches,"
    " p.same FROM scores s JOIN pairs p ON p.a = s.a AND p.b = s.b))",
)


def pair_diagnosis(spark, d):
    return _diagnosed_pairs(spark, d).select(
        "a", "b", F.col("ps.status").alias("pair_status"), F.col("ps.reason").alias("reason"),
        F.col("d.status").alias("diagnostic_status"), F.concat_ws(";", "d.issues").alias("issue_codes"),
        F.col("d.priority").alias("priority"),
    )


PAIR_DIAGNOSIS_SQL = sql.with_ctes(
    *_PAIR_CTES, _DIAG_PAIRS, sql.DIAGNOSIS,
    select="""SELECT a, b, status AS pair_status, reason, diagnostic AS diagnostic_status,
    issues AS issue_codes, priority FROM final""",
)


def pair_status_counts(spark, d):
    return (
        _diagnosed_pairs(spark, d)
        .groupBy(F.col("d.status").alias("diagnostic_status"), "same")
        .agg(F.count("*").alias("rows"))
    )


PAIR_STATUS_COUNTS_SQL = sql.with_ctes(
    *_PAIR_CTES, _DIAG_PAIRS, sql.DIAGNOSIS,
    select="SELECT diagnostic AS diagnostic_status, same, count(*) AS rows FROM final GROUP BY 1, 2",
)


def issue_histogram(spark, d):
    return (
        unnest(_diagnosed_pairs(spark, d), [], F.col("d.issues"))
        .groupBy(F.col("p").alias("issue_code"))
        .agg(F.count("*").alias("rows"))
    )


ISSUE_HISTOGRAM_SQL = sql.with_ctes(
    *_PAIR_CTES, _DIAG_PAIRS, sql.DIAGNOSIS,
    select="""SELECT issue_code, count(*) AS rows FROM
    (SELECT unnest(string_split(issues, ';')) AS issue_code FROM final WHERE issues <> '') GROUP BY 1""",
)


def legacy_status(spark, d):
    cols = rules.legacy_from_diagnostic(F.col("diagnostic_status"))
    return pair_diagnosis(spark, d).groupBy(
        "diagnostic_status", *[c.alias(n) for n, c in cols.items()]
    ).agg(F.count("*").alias("rows"))


LEGACY_STATUS_SQL = sql.with_ctes(
    *_PAIR_CTES, _DIAG_PAIRS, sql.DIAGNOSIS,
    select="""SELECT diagnostic AS diagnostic_status,
    CASE diagnostic WHEN 'supported_same_compound' THEN 'ms2_supported_same_compound'
      WHEN 'conflicting_spectra' THEN 'ms2_conflict' WHEN 'insufficient_evidence' THEN 'insufficient_ms2_evidence'
      ELSE 'not_evaluable' END AS compound_identity_status,
    CASE diagnostic WHEN 'supported_same_compound' THEN 'candidate_chiral_doublet'
      WHEN 'conflicting_spectra' THEN 'not_supported' ELSE 'not_evaluable' END AS chiral_doublet_status,
    CASE diagnostic WHEN 'supported_same_compound' THEN 'candidate_enantiomer_pair'
      WHEN 'conflicting_spectra' THEN 'ms2_not_similar' WHEN 'insufficient_evidence' THEN 'insufficient_ms2_evidence'
      ELSE 'not_evaluable' END AS enantiomer_pair_status,
    count(*) AS rows FROM final GROUP BY 1, 2, 3, 4""",
)


def centroid_clusters(spark, d):
    centres = spectra.merge_centroids(F.col("peaks"), 0.01, "Da")
    return unnest(proj.spectra(spark, d), ["vec_id"], centres).select(
        "vec_id", "pos", r6("centre", F.col("p"))
    )


CENTROID_SQL = sql.with_ctes(
    sql.SPECTRA,
    select="""
SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(centre, 6) AS centre FROM (
  SELECT vec_id, unnest(cs) AS centre, unnest(range(1, len(cs) + 1)) AS pos FROM (
    SELECT vec_id, list_append(f.d, f.m / f.w) AS cs FROM (
      SELECT vec_id, list_reduce(
        list({'d': []::DOUBLE[], 'w': it, 'm': mz * it, 'z': mz} ORDER BY mz, it),
        lambda acc, x: CASE WHEN x.z BETWEEN acc.m / acc.w - 0.01::DOUBLE AND acc.m / acc.w + 0.01::DOUBLE
          THEN {'d': acc.d, 'w': acc.w + x.w, 'm': acc.m + x.m, 'z': x.z}
          ELSE {'d': list_append(acc.d, acc.m / acc.w), 'w': x.w, 'm': x.m, 'z': x.z} END) AS f
      FROM spec GROUP BY vec_id)))""",
)

# ---- windows and traces --------------------------------------------------------------


def window_index(spark, d):
    w = ms2_run(spark, d).windows
    return w.select(
        "win", "iso_lo", "iso_hi", r6("mz_min"), r6("mz_max"), "rt_first", "rt_last", "n_scans"
    )


WINDOW_INDEX_SQL = sql.with_ctes(
    sql.MS2,
    select="""SELECT win, lo AS iso_lo, hi AS iso_hi, round(mz_min, 6) AS mz_min, round(mz_max, 6) AS mz_max,
    rt_first, rt_last, n_scans FROM wins""",
)


def window_centres(spark, d):
    scans = proj.ms2_peaks(spark, d).withColumn("scan_no", F.col("scan"))
    return dia.window_centres(scans).select("win", "first_scan_no")


WINDOW_CENTRES_SQL = sql.with_ctes(
    sql.MS2, select="SELECT win, min(scan) AS first_scan_no FROM pk GROUP BY win"
)


def dia_interval_join(spark, d):
    rows = dia.interval_join(proj.targets(spark, d), ms2_run(spark, d).windows)
    return rows.select("row_id", "win", r6("dist"), "match_count")


DIA_INTERVAL_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS,
    select="SELECT row_id, win, round(dist, 6) AS dist, CAST(match_count AS INT) AS match_count FROM routed",
)


def dia_nearest_window(spark, d):
    rows = dia.route_targets(proj.targets(spark, d), ms2_run(spark, d).windows)
    hit = F.try_element_at("hits", F.lit(1))
    return rows.select(
        "row_id", hit["win"].alias("win"), r6("dist", hit["dist"]), "match_count",
        (F.col("match_count") == 0).alias("missed"),
    )


DIA_NEAREST_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS,
    select="""SELECT t.row_id, n.win, round(n.dist, 6) AS dist,
    CAST(coalesce(n.match_count, 0) AS INT) AS match_count, n.win IS NULL AS missed
    FROM tg t LEFT JOIN nearest n ON n.row_id = t.row_id""",
)


def dia_centre_list_match(spark, d):
    bare = ms2_run(spark, d).windows.withColumn("iso_lo", F.lit(None).cast("double"))
    rows = dia.interval_join(proj.targets(spark, d), bare, 10.0)
    return rows.groupBy("win").agg(F.count("*").alias("targets"))


DIA_CENTRE_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS,
    select="""SELECT w.win, count(*) AS targets FROM tg t JOIN wins w
    ON t.mz BETWEEN w.win - 5.0::DOUBLE AND w.win + 5.0::DOUBLE GROUP BY w.win""",
)


def rt_windows(spark, d):
    rows = dia.rt_windows(proj.targets(spark, d), SETTINGS)
    return rows.select(
        "row_id", r6("rt_separation_sec"),
        *[r6(f"{s}_rt_window_{e}") for s in plan.SIDES for e in ("start", "end")],
    )


RT_WINDOWS_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS, sql.SIDES,
    select="""SELECT row_id, round(separation, 6) AS rt_separation_sec,
    CASE WHEN p2 IS NOT NULL THEN round(p1 * 60.0::DOUBLE - half, 6) END AS peak_a_rt_window_start,
    CASE WHEN p2 IS NOT NULL THEN round(p1 * 60.0::DOUBLE + half, 6) END AS peak_a_rt_window_end,
    round(p2 * 60.0::DOUBLE - half, 6) AS peak_b_rt_window_start,
    round(p2 * 60.0::DOUBLE + half, 6) AS peak_b_rt_window_end FROM sep""",
)


def _open_sides(spark, d):
    run = ms2_run(spark, d)
    sides = plan.routed_sides(proj.targets(spark, d), run, SETTINGS)
    return sides.where(F.col("blocked").isNull()), run


def sum_eic(spark, d):
    sides, run = _open_sides(spark, d)
    rows = xic.sum_eic(sides, run, dia.mz_bin_width(*SETTINGS.precursor_tolerance))
    return rows.select("row_id", "side", "scan", "rt", F.round("it", 2).alias("it"))


SUM_EIC_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS, sql.SIDES,
    select="SELECT row_id, side, scan, rt, round(it, 2) AS it FROM trace",
)


def _traces(spark, d):
    run = ms2_run(spark, d)
    sides = plan.routed_sides(proj.targets(spark, d), run, SETTINGS)
    return plan.precursor_traces(sides, run, SETTINGS).where(F.size("trace") > 0), run


def xic_summary(spark, d):
    traces, _ = _traces(spark, d)
    return traces.select("row_id", "side", xic.xic_summary(F.col("trace")).alias("x")).select(
        "row_id", "side", F.col("x.apex_rt").alias("apex_rt"),
        F.round("x.apex_intensity", 2).alias("apex_intensity"), F.round("x.area", 1).alias("area"),
        F.col("x.flag").alias("flag"),
    )


XIC_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS, sql.SIDES,
    select="""SELECT row_id, side, apex_rt, round(apex_it, 2) AS apex_intensity, round(area, 1) AS area,
    CASE WHEN n_scans < 2 THEN 'insufficient_points' ELSE 'ok' END AS flag FROM xic""",
)


def consensus_scans(spark, d):
    traces, _ = _traces(spark, d)
    return traces.select(
        "row_id", "side", F.posexplode(xic.top_scans(F.col("trace"), 3)).alias("rank", "scan")
    )


CONSENSUS_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS, sql.SIDES,
    select="""SELECT row_id, side, CAST(r - 1 AS INT) AS rank, scan FROM (
      SELECT row_id, side, scan, row_number() OVER (PARTITION BY row_id, side ORDER BY it DESC, scan) AS r
      FROM trace WHERE it > 0) WHERE r <= 3""",
)


def _window_series(spark, d):
    """Per window: two aligned series over its scans (fixed m/z groups of the projection)."""
    grouped = proj.ms2_peaks(spark, d).groupBy("win", "scan").agg(
        F.sum(F.when(F.col("mz") >= 300, F.col("it")).otherwise(0.0)).alias("x"),
        F.sum(F.when(F.floor("mz") == 140, F.col("it")).otherwise(0.0)).alias("y"),
    )
    point = F.struct("scan", "x", "y")
    return grouped.groupBy("win").agg(F.sort_array(F.collect_list(point)).alias("pts")).select(
        "win",
        F.transform("pts", lambda p: p["x"]).alias("x"),
        F.transform("pts", lambda p: p["y"]).alias("y"),
    )


def coelution_pearson(spark, d):
    return _window_series(spark, d).select(
        "win", r6("pearson", xic.pearson(F.col("x"), F.col("y"))), F.size("x").alias("scans")
    )


_SERIES = """
series AS (SELECT win, scan, sum(CASE WHEN mz >= 300 THEN it ELSE 0.0::DOUBLE END) AS x,
  sum(CASE WHEN floor(mz) = 140 THEN it ELSE 0.0::DOUBLE END) AS y FROM pk GROUP BY win, scan)
"""
COELUTION_SQL = sql.with_ctes(
    sql.MS2, _SERIES,
    select="""SELECT win, round(CASE WHEN max(x) > min(x) AND max(y) > min(y)
      THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END, 6) AS pearson,
      CAST(count(*) AS INT) AS scans FROM series GROUP BY win""",
)


def active_support(spark, d):
    x, y = F.col("x"), F.col("y")
    high = F.array_max(x) * 0.05
    return _window_series(spark, d).select(
        "win",
        xic.longest_run(F.transform(x, lambda v: v >= high)).alias("longest_run"),
        r6("correlation", xic.active_support_correlation(x, y, 0.05, 5, 1000, 3)),
        (xic.active_support_correlation(x, y, 0.05, 5, 0, 3).isNull()).alias("apex_too_far"),
    )


ACTIVE_SQL = sql.with_ctes(
    sql.MS2, _SERIES,
    """tops AS (SELECT win, max(x) AS mx, max(y) AS my, arg_max(scan, (x, -scan)) AS ax, arg_max(scan, (y, -scan)) AS ay
       FROM series GROUP BY win),
    runs AS (SELECT win, max(n) AS longest_run FROM (
      SELECT win, g, count(*) AS n FROM (
        SELECT s.win, rk - row_number() OVER (PARTITION BY s.win ORDER BY s.scan) AS g FROM (
          SELECT *, row_number() OVER (PARTITION BY win ORDER BY scan) AS rk FROM series) s
        JOIN tops t ON t.win = s.win WHERE s.x >= t.mx * 0.05::DOUBLE) GROUP BY win, g) GROUP BY win),
    sup AS (SELECT s.win, s.x, s.y FROM series s JOIN tops t ON t.win = s.win WHERE s.x >= t.mx * 0.05::DOUBLE)""",
    select="""SELECT t.win, CAST(r.longest_run AS INT) AS longest_run,
      (SELECT round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) FROM sup WHERE sup.win = t.win) AS correlation,
      t.ax <> t.ay AS apex_too_far
      FROM tops t JOIN runs r ON r.win = t.win""",
)

# ---- full analysis -------------------------------------------------------------------

_RESULT = {
    "peak_a_quality_flags": "flags_a", "peak_b_quality_flags": "flags_b",
    "peak_a_ms2_count": "ms2_count_a", "peak_b_ms2_count": "ms2_count_b",
    "peak_a_candidate_fragment_count": "cand_a", "peak_b_candidate_fragment_count": "cand_b",
    "peak_a_fragment_count": "count_a", "peak_b_fragment_count": "count_b",
    "dia_window_center": "win", "dia_window_match_count": "match_count",
    "ms2_matched_peaks": "matched", "enantiomer_pair_status": "status",
    "enantiomer_pair_reason": "reason", "ms2_diagnostic_status": "diagnostic",
    "ms2_issue_codes": "issues", "ms2_review_priority": "priority",
}
_RESULT_ROUND = {
    "ms2_cosine": ("cosine", 6), "ms2_entropy_similarity": ("entropy", 6),
    "peak_a_explained_intensity": ("explained_a", 6), "peak_b_explained_intensity": ("explained_b", 6),
    "peak_a_apex_rt": ("apex_rt_a", 6), "peak_b_apex_rt": ("apex_rt_b", 6),
    "peak_a_apex_intensity": ("apex_it_a", 2), "peak_b_apex_intensity": ("apex_it_b", 2),
    "peak_a_area": ("area_a", 1), "peak_b_area": ("area_b", 1),
}


def analyze_pairs(spark, d):
    return analyzed(spark, d).select(
        "row_id",
        *[
            F.col(n).cast("long").alias(n) if n.endswith("count") or n.endswith("peaks") else F.col(n)
            for n in _RESULT
        ],
        *[F.round(n, k).alias(n) for n, (_, k) in _RESULT_ROUND.items()],
        "compound_identity_status", "chiral_doublet_status", "chromatographic_status",
        "ms1_reference_status",
    )


ANALYZE_SQL = sql.with_ctes(
    *sql.ANALYZE_CTES,
    select="SELECT row_id, "
    + ", ".join(
        f"CAST({src} AS BIGINT) AS {n}" if n.endswith("count") or n.endswith("peaks") else f"{src} AS {n}"
        for n, src in _RESULT.items()
    )
    + ", "
    + ", ".join(f"round({src}, {k}) AS {n}" for n, (src, k) in _RESULT_ROUND.items())
    + """,
  CASE status WHEN 'candidate_enantiomer_pair' THEN 'ms2_supported_same_compound' WHEN 'ms2_not_similar' THEN 'ms2_conflict'
    WHEN 'insufficient_ms2_evidence' THEN 'insufficient_ms2_evidence' ELSE 'not_evaluable' END AS compound_identity_status,
  CASE status WHEN 'candidate_enantiomer_pair' THEN 'candidate_chiral_doublet' WHEN 'ms2_not_similar' THEN 'not_supported'
    ELSE 'not_evaluable' END AS chiral_doublet_status,
  CASE WHEN p2 IS NULL THEN 'input_single_peak' ELSE 'input_double_peak' END AS chromatographic_status,
  CASE WHEN p2 IS NULL THEN 'supplied_single_peak' ELSE 'supplied_double_peak' END AS ms1_reference_status
  FROM final""",
)


def fragment_spectra(spark, d):
    run = ms2_run(spark, d)
    rows = plan.extract_window(proj.targets(spark, d), run, SETTINGS)
    return unnest(rows, ["row_id", "side"], F.col("spectrum")).select(
        "row_id", "side", "pos", r6("mz", F.col("p.mz")), F.round("p.it", 2).alias("it")
    )


FRAGMENT_SPECTRA_SQL = sql.with_ctes(
    sql.MS2, sql.TARGETS, sql.SIDES, sql.FRAGMENTS,
    select="""SELECT row_id, side, CAST(row_number() OVER (PARTITION BY row_id, side ORDER BY mz) - 1 AS INT) AS pos,
    round(mz, 6) AS mz, round(it, 2) AS it FROM kept""",
)


def analyze_status_counts(spark, d):
    return analyzed(spark, d).groupBy("ms2_diagnostic_status", "ms2_review_priority").agg(
        F.count("*").alias("rows")
    )


ANALYZE_STATUS_SQL = sql.with_ctes(
    *sql.ANALYZE_CTES,
    select="""SELECT diagnostic AS ms2_diagnostic_status, priority AS ms2_review_priority, count(*) AS rows
    FROM final GROUP BY 1, 2""",
)

QUERIES = {
    "parse_fragments": (parse_fragments, PARSE_SQL),
    "tolerance_bands": (tolerance_bands, TOLERANCE_SQL),
    "spectrum_filter": (spectrum_filter, SPECTRUM_FILTER_SQL),
    "exclusive_matches": (exclusive_matches, EXCLUSIVE_SQL),
    "pair_similarity": (pair_similarity, PAIR_SIMILARITY_SQL),
    "pair_diagnosis": (pair_diagnosis, PAIR_DIAGNOSIS_SQL),
    "pair_status_counts": (pair_status_counts, PAIR_STATUS_COUNTS_SQL),
    "issue_histogram": (issue_histogram, ISSUE_HISTOGRAM_SQL),
    "legacy_status": (legacy_status, LEGACY_STATUS_SQL),
    "centroid_clusters": (centroid_clusters, CENTROID_SQL),
    "window_index": (window_index, WINDOW_INDEX_SQL),
    "window_centres": (window_centres, WINDOW_CENTRES_SQL),
    "dia_interval_join": (dia_interval_join, DIA_INTERVAL_SQL),
    "dia_nearest_window": (dia_nearest_window, DIA_NEAREST_SQL),
    "dia_centre_list_match": (dia_centre_list_match, DIA_CENTRE_SQL),
    "rt_windows": (rt_windows, RT_WINDOWS_SQL),
    "sum_eic": (sum_eic, SUM_EIC_SQL),
    "xic_summary": (xic_summary, XIC_SQL),
    "consensus_scans": (consensus_scans, CONSENSUS_SQL),
    "coelution_pearson": (coelution_pearson, COELUTION_SQL),
    "active_support": (active_support, ACTIVE_SQL),
    "fragment_spectra": (fragment_spectra, FRAGMENT_SPECTRA_SQL),
    "analyze_pairs": (analyze_pairs, ANALYZE_SQL),
    "analyze_status_counts": (analyze_status_counts, ANALYZE_STATUS_SQL),
}


# ---- sweep and two-stage mode --------------------------------------------------------


def sensitivity_sweep(spark, d):
    """Every value of every swept parameter."""
    from ..plans import jobs

    return jobs.sensitivity_sweep(proj.targets(spark, d), ms2_run(spark, d), jobs.sweep_settings(SETTINGS))


def _sweep_sql(name: str, value: float, s: ExtractionSettings) -> str:
    """The analysis with one variant's numbers in place of the usual ones."""
    ppm = "10.0::DOUBLE / 1000000.0::DOUBLE"
    swaps = {
        sql.SIDES: [
            (ppm, f"{s.precursor_tolerance[0]}::DOUBLE / 1000000.0::DOUBLE"),
            ("least(60.0::DOUBLE,", f"least({s.rt_half_window_sec}::DOUBLE,"), ("WHERE rn <= 1)", f"WHERE rn <= {s.consensus_scans})"),
        ],
        sql.FRAGMENTS: [
            (ppm, f"{s.fragment_eic_tolerance[0]}::DOUBLE / 1000000.0::DOUBLE"), ("r > 0.9::DOUBLE", f"r > {s.min_fragment_correlation}::DOUBLE"),
        ],
        sql.ANALYZE: [("<= 0.01::DOUBLE)", f"<= {s.fragment_mz_tol}::DOUBLE)")],
    }
    ctes = []
    for part in sql.ANALYZE_CTES:
        for old, new in swaps.get(part, []):
            if part.count(old) < 1:
                raise ValueError(f"{old} is no part of the analysis text")
            part = part.replace(old, new)
        ctes.append(part)
    return sql.with_ctes(
        *ctes,
        select=f"""SELECT '{name}' AS varied_parameter, {value}::DOUBLE AS varied_value, status AS enantiomer_pair_status, count(*) AS rows,
        count(*) FILTER (kept_a > 0 AND kept_b > 0) AS both_ms2_spectra FROM final GROUP BY status""",
    )


def _whole_sweep_sql() -> str:
    from ..plans.jobs import sweep_settings

    return " UNION ALL ".join(f"SELECT * FROM ({_sweep_sql(*v)})" for v in sweep_settings(SETTINGS))


SWEEP_SQL = _whole_sweep_sql()


def two_stage_analysis(spark, d):
    """MS1 picks supply the two RTs of the MS2 stage, on the same target rows.

    MS1 traces come from one projection and MS2 scans from another, so RTs are folded
    into the MS2 time axis; the second stage then runs unchanged.
    """
    from ..operators import ms1
    from .ms1 import LEGACY

    calls = ms1.annotate_targets(
        proj.ms1_targets(spark, d), ms1.run_from_peaks(proj.ms1_peaks(spark, d)), LEGACY
    )
    k = F.col("target_id")
    targets = calls.select(
        k.alias("row_id"), F.lit("events").alias("raw_id"),
        (F.lit(312.0) + F.lit(12.0) * (k % 5)).alias("mz"),
        (F.col("auto_peak1_rt_min") % 11).alias("peak_a_rt"),
        (F.col("auto_peak2_rt_min") % 11).alias("peak_b_rt"),
    )
    return plan.analyze_pairs(targets, ms2_run(spark, d), SETTINGS).groupBy(
        "ms2_diagnostic_status", "chromatographic_status"
    ).agg(F.count("*").alias("rows"))


QUERIES |= {
    "sensitivity_sweep": (sensitivity_sweep, SWEEP_SQL),
    "two_stage_analysis": (two_stage_analysis, None),
}
