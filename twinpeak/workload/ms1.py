"""Queries over MS1 traces: extraction, smoothing, picking, background, review."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import trace as tr
from ..operators import ms1, ms1_review
from ..params import PeakPickSettings
from ..plans import tuning
from ..session import durable
from ..sources import projections as proj
from . import sqltext as sql
from .evidence import r6, unnest

LEGACY = PeakPickSettings(min_height=20_000.0)
WIDE = PeakPickSettings(min_height=20_000.0, sg_window=11, min_distance_scans=30)
ADAPTIVE = PeakPickSettings(
    sg_window=3,
    min_height=None,
    min_prominence_ratio=0.1,
    min_support_scans=2,
    min_distance_sec=6.0,
    close_peak_max_valley_ratio=0.85,
    rank_by_prominence=True,
)


def run_and_targets(spark, d):
    return ms1.run_from_peaks(proj.ms1_peaks(spark, d)), proj.ms1_targets(spark, d)


def traced(spark, d):
    run, targets = run_and_targets(spark, d)
    return ms1.traces(targets, run, 3.0)


M1 = """
m1 AS (
  SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 10.0::DOUBLE) AS INT) AS scan,
         100.0::DOUBLE + (l_partkey % 2000) * 0.25::DOUBLE AS mz, max(l_extendedprice) AS it
  FROM lineitem GROUP BY 1, 2),
axis AS (SELECT scan, scan * 6.0::DOUBLE AS rt, row_number() OVER (ORDER BY scan) - 1 AS pos
  FROM (SELECT DISTINCT scan FROM m1)),
last AS (SELECT max(pos) AS n FROM axis),
tm AS (SELECT 100.0::DOUBLE + (p_partkey % 2000) * 0.25::DOUBLE AS mz, min(p_partkey) AS target_id FROM part GROUP BY 1),
pts AS (
  SELECT t.mz, m.scan, CAST(CAST(max(m.it) AS FLOAT) AS DOUBLE) AS it
  FROM tm t JOIN m1 m ON m.mz BETWEEN t.mz - t.mz * 3.0::DOUBLE / 1000000.0::DOUBLE AND t.mz + t.mz * 3.0::DOUBLE / 1000000.0::DOUBLE
  GROUP BY t.mz, m.scan),
tr AS (
  SELECT t.mz, a.pos, a.rt, coalesce(p.it, 0.0::DOUBLE) AS y
  FROM tm t CROSS JOIN axis a LEFT JOIN pts p ON p.mz = t.mz AND p.scan = a.scan)
"""


def smooth_sql(name: str, window: int, poly: int) -> str:
    r = window // 2
    terms = []
    for k, w in enumerate(tr.savgol_weights(window, poly)):
        off = k - r
        ref = "y" if off == 0 else f"{'lead' if off > 0 else 'lag'}(y, {abs(off)}) OVER w"
        terms.append(f"({w!r}::DOUBLE) * {ref}")
    return f"""
{name} AS (
  SELECT mz, pos, rt, y, CASE WHEN pos >= {r} AND pos <= n - {r} THEN {' + '.join(terms)} ELSE y END AS s
  FROM tr CROSS JOIN last WINDOW w AS (PARTITION BY mz ORDER BY pos))"""


def picks_sql(p: str, c: PeakPickSettings) -> str:
    """CTEs <p>sm … <p>peaks, <p>pair, <p>call for one absolute-height configuration."""
    return smooth_sql(f"{p}sm", c.sg_window, c.sg_polyorder) + f""",
{p}mx AS (
  SELECT mz, pos, s FROM (
    SELECT mz, pos, s, lag(s) OVER w AS s0, lead(s) OVER w AS s1 FROM {p}sm
    WINDOW w AS (PARTITION BY mz ORDER BY pos))
  WHERE s > s0 AND s >= s1 AND s >= {c.min_height}),
{p}nms AS (
  SELECT mz, unnest(list_reduce(list([pos] ORDER BY s DESC, pos),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: abs(o - x[1]) < {c.min_distance_scans})) > 0
                        THEN acc ELSE list_concat(acc, x) END)) AS c
  FROM {p}mx GROUP BY mz),
{p}ref AS (
  SELECT mz, apex, min(c) AS c, any_value(it) AS it FROM (
    SELECT n.mz, n.c, arg_max(t.pos, (t.y, -t.pos)) AS apex, max(t.y) AS it
    FROM {p}nms n JOIN tr t ON t.mz = n.mz AND t.pos BETWEEN n.c - {c.refine_radius_scans} AND n.c + {c.refine_radius_scans}
    GROUP BY n.mz, n.c) GROUP BY mz, apex),
""" + measured_sql(p, "it DESC, c") + f""",
{p}call AS (
  SELECT tm.mz, tm.target_id, b.top_y,
    CASE WHEN b.top_y < {c.min_height} THEN 'not_evaluable' WHEN p1.mz IS NULL THEN 'ambiguous'
         WHEN q.mz IS NULL THEN 'single_peak' ELSE 'double_peak' END AS status,
    CASE WHEN b.top_y < {c.min_height} THEN '' WHEN p1.mz IS NULL THEN 'no_qualified_peak_candidate'
         WHEN q.gap < {c.min_distance_scans} THEN 'close_peak_pair' ELSE '' END AS reasons,
    p1.rt / 60 AS m1, q.rt2 / 60 AS m2, q.resolution, q.valley_ratio, q.separation_sec, q.lo, q.hi
  FROM tm JOIN {p}base b ON b.mz = tm.mz LEFT JOIN {p}peaks p1 ON p1.mz = tm.mz AND p1.k = 1
  LEFT JOIN {p}pair q ON q.mz = tm.mz)"""


def measured_sql(p: str, rank: str) -> str:
    """CTEs <p>top … <p>pair over the refined candidates <p>ref (mz, apex, it)."""
    return f"""{p}top AS (SELECT mz, apex, it, row_number() OVER (PARTITION BY mz ORDER BY apex) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY mz ORDER BY {rank}) AS rk FROM {p}ref) WHERE rk <= 2),
{p}base AS (SELECT mz, median(y) AS b, max(y) AS top_y FROM tr GROUP BY mz),
{p}noise AS (SELECT t.mz, 1.4826::DOUBLE * median(abs(t.y - b.b)) AS noise FROM tr t JOIN {p}base b ON b.mz = t.mz GROUP BY t.mz),
{p}bounds AS (
  SELECT k.mz, k.apex, k.it, k.k, b.b,
    coalesce(max(t.pos) FILTER (t.pos < k.apex AND t.y < b.b + (k.it - b.b) / 2), 0) AS l,
    coalesce(min(t.pos) FILTER (t.pos > k.apex AND t.y < b.b + (k.it - b.b) / 2), max(t.pos)) AS r,
    k.it >= b.b + (k.it - b.b) / 2 AND k.apex > 0 AND k.apex < max(t.pos) AS ok
  FROM {p}top k JOIN {p}base b ON b.mz = k.mz JOIN tr t ON t.mz = k.mz
  GROUP BY k.mz, k.apex, k.it, k.k, b.b),
{p}seg AS (SELECT mz, pos, rt, y, lead(rt) OVER w AS rt1, lead(y) OVER w AS y1 FROM tr WINDOW w AS (PARTITION BY mz ORDER BY pos)),
{p}peaks AS (
  SELECT d.mz, d.k, d.apex AS scan, a.rt, d.it,
    CASE WHEN d.ok THEN ar.rt - al.rt END AS width,
    CASE WHEN d.ok THEN (SELECT sum((g.rt1 - g.rt) * (greatest(0.0::DOUBLE, g.y - d.b) + greatest(0.0::DOUBLE, g.y1 - d.b)) / 2)
       FROM {p}seg g WHERE g.mz = d.mz AND g.pos BETWEEN d.l AND d.r - 1) END AS area,
    CASE WHEN z.noise <> 0 THEN greatest(0.0::DOUBLE, (d.it - d.b) / z.noise) END AS snr
  FROM {p}bounds d JOIN axis a ON a.pos = d.apex JOIN axis al ON al.pos = d.l JOIN axis ar ON ar.pos = d.r
  JOIN {p}noise z ON z.mz = d.mz),
{p}pair AS (
  SELECT x.mz, x.rt AS rt1, y.rt AS rt2, least(x.it, y.it) AS lo, greatest(x.it, y.it) AS hi,
    y.rt - x.rt AS separation_sec, y.scan - x.scan AS gap,
    CASE WHEN x.width <> 0 AND y.width <> 0 AND y.rt > x.rt THEN 1.17741::DOUBLE * (y.rt - x.rt) / (x.width + y.width) END AS resolution,
    (SELECT min(t.y) FROM tr t WHERE t.mz = x.mz AND t.pos BETWEEN x.scan AND y.scan) / least(x.it, y.it) AS valley_ratio
  FROM {p}peaks x JOIN {p}peaks y ON x.mz = y.mz AND x.k = 1 AND y.k = 2)"""


def adaptive_sql(p: str, c: PeakPickSettings) -> str:
    """CTEs <p>sm … <p>ref of one configuration of the adaptive picker."""
    near = f"abs(rts[x.i + 1] - rts[o.i + 1]) < {c.min_distance_sec}"
    low = "least(ss[x.i + 1], ss[o.i + 1]) - b"
    valley = f"CASE WHEN {low} > 0 THEN greatest(0, list_min(ss[least(x.i, o.i) + 1:greatest(x.i, o.i) + 1]) - b) / ({low}) ELSE 'inf'::DOUBLE END"
    return smooth_sql(f"{p}sm", c.sg_window, c.sg_polyorder) + f""",
{p}md AS (SELECT mz, median(y) AS b FROM tr GROUP BY mz),
{p}mx AS (SELECT mz, pos, s FROM (
  SELECT mz, pos, s, lag(s) OVER w AS s0, lead(s) OVER w AS s1 FROM {p}sm WINDOW w AS (PARTITION BY mz ORDER BY pos)) WHERE s > s0 AND s >= s1),
{p}hi AS (SELECT m.mz, m.pos, m.s, coalesce(max(t.pos) FILTER (t.pos < m.pos AND t.s > m.s), -1) AS lh, min(t.pos) FILTER (t.pos > m.pos AND t.s > m.s) AS rh
  FROM {p}mx m JOIN {p}sm t ON t.mz = m.mz GROUP BY ALL),
{p}pr AS (SELECT h.mz, h.pos, h.s, d.b, greatest(0, h.s - greatest(d.b, min(t.s) FILTER (t.pos > lh AND t.pos <= h.pos),
    min(t.s) FILTER (t.pos >= h.pos AND (rh IS NULL OR t.pos < rh)))) AS prominence
  FROM {p}hi h JOIN {p}sm t ON t.mz = h.mz JOIN {p}md d ON d.mz = h.mz GROUP BY h.mz, h.pos, h.s, d.b),
{p}su AS (SELECT r.mz, r.pos, r.b, r.prominence, CASE WHEN r.s > r.b THEN least(1, prominence / (r.s - r.b)) ELSE 0 END AS ratio,
    CASE WHEN prominence > 0 THEN coalesce(min(t.pos) FILTER (t.pos > r.pos AND t.s < r.s - prominence / 2) - 1, max(t.pos))
      - coalesce(max(t.pos) FILTER (t.pos < r.pos AND t.s < r.s - prominence / 2) + 1, 0) + 1 ELSE 0 END AS support
  FROM {p}pr r JOIN {p}sm t ON t.mz = r.mz GROUP BY r.mz, r.pos, r.s, r.b, r.prominence),
{p}gate AS (SELECT * FROM {p}su WHERE ratio >= {c.min_prominence_ratio}::DOUBLE AND support >= {c.min_support_scans}),
{p}arr AS (SELECT t.mz, list(t.s ORDER BY t.pos) AS ss, list(t.rt ORDER BY t.pos) AS rts FROM {p}sm t GROUP BY t.mz),
{p}acc AS (SELECT mz, unnest(list_reduce(cand, lambda acc, y: CASE WHEN len(list_filter(acc, lambda o: list_bool_or(list_transform(y, lambda x: {near}
      AND {valley} > {c.close_peak_max_valley_ratio}::DOUBLE)))) > 0 THEN acc ELSE list_concat(acc, y) END)).i AS c
  FROM (SELECT g.mz, g.b, a.ss, a.rts, list([{{'i': g.pos}}] ORDER BY g.prominence DESC, g.pos) AS cand
    FROM {p}gate g JOIN {p}arr a ON a.mz = g.mz GROUP BY g.mz, g.b, a.ss, a.rts)),
{p}nb AS (SELECT mz, c, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM {p}acc WINDOW w AS (PARTITION BY mz ORDER BY c)),
{p}va AS (SELECT n.mz, n.c, n.c1, arg_min(t.pos, (t.s, t.pos)) AS v FROM {p}nb n JOIN {p}sm t ON t.mz = n.mz AND t.pos > n.c AND t.pos < n.c1 GROUP BY ALL),
{p}ba AS (SELECT n.mz, n.c, greatest(n.c - {c.refine_radius_scans}, 0, coalesce(l.v + 1, 0)) AS lo, least(n.c + {c.refine_radius_scans}, coalesce(r.v, n.c + {c.refine_radius_scans})) AS hi
  FROM {p}nb n LEFT JOIN {p}va l ON l.mz = n.mz AND l.c1 = n.c LEFT JOIN {p}va r ON r.mz = n.mz AND r.c = n.c),
{p}ap AS (SELECT b.mz, b.c, coalesce(arg_max(t.pos, (t.y, -t.pos)), b.c) AS apex FROM {p}ba b LEFT JOIN tr t ON t.mz = b.mz AND t.pos BETWEEN b.lo AND b.hi GROUP BY b.mz, b.c),
{p}ref AS (SELECT a.mz, a.c, a.apex, t.y AS it, u.prominence, u.ratio, u.support FROM {p}ap a JOIN tr t ON t.mz = a.mz AND t.pos = a.apex
  JOIN {p}su u ON u.mz = a.mz AND u.pos = a.c)"""


def max_eic(spark, d):
    run, targets = run_and_targets(spark, d)
    rows = ms1.max_eic_points(targets, run, 3.0)
    return rows.select("mz", "scan", F.round("it", 2).alias("it"))


MAX_EIC_SQL = sql.with_ctes(M1, select="SELECT mz, scan, round(it, 2) AS it FROM pts")


def dense_traces(spark, d):
    y = F.col("y")
    return traced(spark, d).select(
        "mz", F.size(y).alias("scans"), F.round(F.array_max(y), 2).alias("top"),
        F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 1).alias("total"),
        F.round(
            F.aggregate(F.transform(y, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v), 0
        ).alias("moment"),
        F.round(tr.median(y), 2).alias("baseline"), F.round(tr.mad(y, tr.median(y)), 2).alias("mad"),
    )


DENSE_SQL = sql.with_ctes(
    M1, "med AS (SELECT mz, median(y) AS b FROM tr GROUP BY mz)",
    select="""SELECT t.mz, CAST(count(*) AS INT) AS scans, round(max(y), 2) AS top, round(sum(y), 1) AS total,
    round(sum(y * pos), 0) AS moment, round(any_value(m.b), 2) AS baseline, round(median(abs(y - m.b)), 2) AS mad
    FROM tr t JOIN med m ON m.mz = t.mz GROUP BY t.mz""",
)


def savgol(spark, d):
    s = tr.savgol(F.col("y"), 7, 2)
    rows = traced(spark, d).withColumn("s", s)
    maxima = tr.let(F.col("s"), lambda v: tr.local_maxima(v, 20_000.0))
    rows = rows.select("mz", "s", maxima.alias("mx"))
    return rows.select(
        "mz",
        F.round(F.array_max("s"), 2).alias("top"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + F.abs(v)), 1).alias("total"),
        F.size("mx").alias("maxima"),
        F.aggregate("mx", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("maxima_sum"),
    )


SAVGOL_SQL = sql.with_ctes(
    M1, smooth_sql("sm", 7, 2),
    """nb AS (SELECT *, lag(s) OVER w AS s0, lead(s) OVER w AS s1 FROM sm WINDOW w AS (PARTITION BY mz ORDER BY pos))""",
    select="""SELECT mz, round(max(s), 2) AS top, round(sum(abs(s)), 1) AS total,
    CAST(count(*) FILTER (s > s0 AND s >= s1 AND s >= 20000.0) AS INT) AS maxima,
    CAST(coalesce(sum(pos) FILTER (s > s0 AND s >= s1 AND s >= 20000.0), 0) AS BIGINT) AS maxima_sum FROM nb GROUP BY mz""",
)


def refined_candidates(spark, d):
    rows = ms1.enumerate_candidates(traced(spark, d), LEGACY)
    return unnest(rows, ["mz"], F.col("candidates")).select(
        "mz", F.col("p.scan").alias("scan"), "p.rt", F.round("p.it", 2).alias("it")
    )


REFINED_SQL = sql.with_ctes(
    M1, picks_sql("", LEGACY),
    select="SELECT r.mz, CAST(r.apex AS INT) AS scan, a.rt, round(r.it, 2) AS it FROM ref r JOIN axis a ON a.pos = r.apex",
)


def picked_peaks(spark, d):
    rows = ms1.pick_peaks(traced(spark, d), LEGACY)
    return unnest(rows, ["mz"], F.col("peaks")).select(
        "mz", (F.col("pos") + 1).alias("k"), "p.scan", "p.rt", F.round("p.it", 2).alias("it"),
        F.round("p.width", 6).alias("width"), F.round("p.area", 1).alias("area"), r6("snr", F.col("p.snr")),
    )


PICKED_SQL = sql.with_ctes(
    M1, picks_sql("", LEGACY),
    select="""SELECT mz, CAST(k AS INT) AS k, CAST(scan AS INT) AS scan, rt, round(it, 2) AS it, round(width, 6) AS width,
    round(area, 1) AS area, round(snr, 6) AS snr FROM peaks""",
)


def annotate(spark, d):
    run, targets = run_and_targets(spark, d)
    rows = ms1.annotate_targets(targets, run, LEGACY)
    return rows.select(
        "target_id", "mz", "auto_signal_status", "auto_chromatographic_status",
        *[
            r6(n)
            for n in (
                "auto_peak1_rt_min", "auto_peak2_rt_min",
                "auto_peak_separation_sec", "auto_valley_ratio", "auto_peak1_area_fraction",
            )
        ],
        F.round("auto_peak_resolution", 9).alias("auto_peak_resolution"),
        F.round("auto_max_intensity", 2).alias("auto_max_intensity"),
        "auto_manual_review_required", "auto_review_reasons",
    )


ANNOTATE_SQL = sql.with_ctes(
    M1, picks_sql("", LEGACY),
    """areas AS (SELECT mz, sum(coalesce(area, 0)) AS t, coalesce(max(area) FILTER (k = 1), 0) AS a1 FROM peaks GROUP BY mz)""",
    select="""SELECT c.target_id, c.mz, CASE WHEN status = 'not_evaluable' THEN 'no_signal' ELSE 'detected' END AS auto_signal_status,
    status AS auto_chromatographic_status, round(m1, 6) AS auto_peak1_rt_min, round(m2, 6) AS auto_peak2_rt_min,
    round(resolution, 9) AS auto_peak_resolution, round(separation_sec, 6) AS auto_peak_separation_sec,
    round(valley_ratio, 6) AS auto_valley_ratio, CASE WHEN a.t > 0 THEN round(a.a1 / a.t, 6) END AS auto_peak1_area_fraction,
    round(top_y, 2) AS auto_max_intensity, reasons <> '' AS auto_manual_review_required, reasons AS auto_review_reasons
    FROM call c LEFT JOIN areas a ON a.mz = c.mz""",
)


def adaptive_calls(spark, d):
    rows = ms1.pick_peaks(traced(spark, d), ADAPTIVE)
    return rows.select(
        "mz", "signal_status", "chromatographic_status",
        F.concat_ws(";", "review_reasons").alias("review_reasons"), r6("resolution"),
        r6("valley_ratio"), F.size("peaks").alias("peaks"), "n_candidates",
    )


def adaptive_candidates(spark, d):
    rows = ms1.enumerate_candidates(traced(spark, d), ADAPTIVE)
    return unnest(rows, ["mz"], F.col("candidates")).select(
        "mz", "p.scan", "p.rt", F.round("p.it", 2).alias("it"), r6("prominence", F.col("p.prominence")),
        r6("prominence_ratio", F.col("p.prominence_ratio")), "p.support_scans",
    )


ADAPTIVE_CANDIDATES_SQL = sql.with_ctes(
    M1, adaptive_sql("", ADAPTIVE),
    select="""SELECT r.mz, CAST(r.apex AS INT) AS scan, a.rt, round(r.it, 2) AS it, round(r.prominence, 6) AS prominence,
    round(r.ratio, 6) AS prominence_ratio, CAST(r.support AS INT) AS support_scans FROM ref r JOIN axis a ON a.pos = r.apex""",
)
ADAPTIVE_CALLS_SQL = sql.with_ctes(
    M1, adaptive_sql("", ADAPTIVE), measured_sql("", "prominence DESC, apex"),
    "nc AS (SELECT mz, count(*) AS n FROM ref GROUP BY mz)",
    "np AS (SELECT mz, count(*) AS n FROM peaks GROUP BY mz)",
    "jd AS (SELECT b.mz, b.b, b.top_y, coalesce(nc.n, 0) AS n, coalesce(np.n, 0) AS peaks, q.* EXCLUDE (mz) FROM base b"
    " LEFT JOIN nc ON nc.mz = b.mz LEFT JOIN np ON np.mz = b.mz LEFT JOIN pair q ON q.mz = b.mz)",
    select=f"""SELECT mz, CASE WHEN n = 0 AND top_y <= b THEN 'no_signal' ELSE 'detected' END AS signal_status,
    CASE WHEN n = 0 AND top_y <= b THEN 'not_evaluable' WHEN n = 0 THEN 'ambiguous' WHEN peaks < 2 THEN 'single_peak'
      WHEN lo / nullif(hi, 0) >= 0 THEN 'double_peak' ELSE 'ambiguous' END AS chromatographic_status,
    CASE WHEN n = 0 AND top_y <= b THEN '' ELSE concat_ws(';', CASE WHEN n = 0 THEN 'no_qualified_peak_candidate' END, 'absolute_height_disabled',
      CASE WHEN peaks = 2 AND separation_sec <= {2 * ADAPTIVE.min_distance_sec} THEN 'close_peak_pair' END) END AS review_reasons,
    round(resolution, 6) AS resolution, round(valley_ratio, 6) AS valley_ratio, CAST(peaks AS INT) AS peaks, CAST(n AS INT) AS n_candidates FROM jd""",
)


def background(spark, d):
    run, targets = run_and_targets(spark, d)
    rows = ms1.traces(targets, run, 3.0).join(targets, ["raw_id", "mz"])
    protected = F.array((F.col("target_id") % 250) / 10.0, (F.col("target_id") % 90) / 10.0)
    rows = rows.select("mz", tr.background(F.col("rts"), F.col("y"), protected, 60.0).alias("b"))
    return rows.select(
        "mz",
        *[
            F.round(F.col(f"b.{n}") + 0.0013, 2).alias(n)  # off exact binary ties
            for n in ("background_median", "background_mad", "background_p95", "background_p99")
        ],
        r6("background_nonzero_fraction", F.col("b.background_nonzero_fraction")),
        r6("peak_to_background_p99", F.col("b.peak_to_background_p99")),
        F.col("b.max_half_height_support_scans").alias("support"),
        F.col("b.low_clean_candidate").alias("low_clean_candidate"),
    )


BACKGROUND_SQL = sql.with_ctes(
    M1,
    """bg AS (SELECT t.mz, t.y FROM tr t JOIN tm ON tm.mz = t.mz
      WHERE abs(t.rt - (tm.target_id % 250) / 10.0::DOUBLE * 60) > 60 AND abs(t.rt - (tm.target_id % 90) / 10.0::DOUBLE * 60) > 60)""",
    """st AS (SELECT mz, median(y) AS med, quantile_cont(y, 0.95) AS p95, quantile_cont(y, 0.99) AS p99,
      count(*) FILTER (y > 0) / count(*) AS nz FROM bg GROUP BY mz)""",
    "dev AS (SELECT b.mz, median(abs(b.y - s.med)) AS mad FROM bg b JOIN st s ON s.mz = b.mz GROUP BY b.mz)",
    "tp AS (SELECT mz, max(y) AS top, arg_max(pos, (y, -pos)) AS apex, max(pos) AS n FROM tr GROUP BY mz)",
    """sp AS (SELECT p.mz, coalesce(min(t.pos) FILTER (t.pos > p.apex AND t.y < p.top / 2), any_value(p.n) + 1) - 1
        - coalesce(max(t.pos) FILTER (t.pos < p.apex AND t.y < p.top / 2), -1) AS support
      FROM tp p JOIN tr t ON t.mz = p.mz GROUP BY p.mz)""",
    select="""SELECT s.mz, round(s.med + 0.0013::DOUBLE, 2) AS background_median, round(d.mad + 0.0013::DOUBLE, 2) AS background_mad, round(s.p95 + 0.0013::DOUBLE, 2) AS background_p95,
    round(s.p99 + 0.0013::DOUBLE, 2) AS background_p99, round(s.nz, 6) AS background_nonzero_fraction,
    round(p.top / greatest(s.p99, 1.0::DOUBLE), 6) AS peak_to_background_p99, CAST(x.support AS INT) AS support,
    p.top > 0 AND p.top < 200000 AND s.p99 <= greatest(1.0::DOUBLE, p.top * 0.05::DOUBLE) AND s.nz <= 0.15::DOUBLE AND x.support >= 3 AS low_clean_candidate
    FROM st s JOIN dev d ON d.mz = s.mz JOIN tp p ON p.mz = s.mz JOIN sp x ON x.mz = s.mz""",
)


def _review_targets(spark, d):
    k = F.col("target_id")
    return proj.ms1_targets(spark, d).select(
        "*",
        F.when(k % 9 != 0, (k % 250) / F.lit(10.0)).alias("peak1"),
        F.when((k % 9 != 0) & (k % 4 != 0), (k % 250) / F.lit(10.0) + F.lit(0.15)).alias("peak2"),
        F.when(k % 3 == 0, "IG").otherwise("").alias("source_machine_id"),
        F.element_at(
            F.array(*[F.lit(v) for v in ("GREEN", "YELLOW", "RED", "CHECK", "")]), (k % 5 + 1).cast("int")
        ).alias("source_machine_label"),
    )


def _review(spark, d):
    run, _ = run_and_targets(spark, d)
    return ms1_review.review_table(_review_targets(spark, d), run, LEGACY, WIDE, ADAPTIVE, 1.0)


def review_diagnostics(spark, d):
    return _review(spark, d).select(
        "target_id", "reference_status", "baseline_status", "experimental_status",
        "baseline_diagnostic", "experimental_diagnostic", "parameter_stability",
        "source_interpretation",
    )


_REVIEW = (
    M1, picks_sql("a_", LEGACY), picks_sql("b_", WIDE),
    """rv AS (
      SELECT a.target_id, CASE WHEN a.target_id % 9 <> 0 THEN (a.target_id % 250) / 10.0::DOUBLE END AS p1,
        CASE WHEN a.target_id % 9 <> 0 AND a.target_id % 4 <> 0 THEN (a.target_id % 250) / 10.0::DOUBLE + 0.15::DOUBLE END AS p2,
        a.status AS sa, b.status AS sb, a.m1 AS a1, a.m2 AS a2, b.m1 AS b1, b.m2 AS b2, a.resolution, a.lo, a.hi, a.top_y,
        CASE WHEN a.target_id % 3 = 0 THEN 'IG' ELSE '' END AS machine,
        (['GREEN', 'YELLOW', 'RED', 'CHECK', ''])[a.target_id % 5 + 1] AS label
      FROM a_call a JOIN b_call b ON a.mz = b.mz)""",
    """rd AS (
      SELECT *, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN 'double_peak' WHEN p1 IS NOT NULL THEN 'single_peak' ELSE 'no_peak' END AS rs,
        CASE label WHEN 'GREEN' THEN 'expected_double_peak' WHEN 'YELLOW' THEN 'expected_single_peak'
          WHEN 'RED' THEN 'unusable_no_peak_or_multiple_peak' WHEN 'CHECK' THEN 'manual_review_needed' ELSE 'unrecognised_or_unlabelled' END AS meaning
      FROM rv)""",
    """rx AS (
      SELECT *,
        CASE WHEN sa <> CASE WHEN rs = 'no_peak' THEN 'not_evaluable' ELSE rs END THEN 'class_mismatch'
             WHEN rs = 'no_peak' THEN 'exact_agreement'
             WHEN abs(p1 - a1) <= 1.0 AND (rs = 'single_peak' OR abs(p2 - a2) <= 1.0) THEN 'exact_agreement' ELSE 'rt_mislocalized' END AS da,
        CASE WHEN sb <> CASE WHEN rs = 'no_peak' THEN 'not_evaluable' ELSE rs END THEN 'class_mismatch'
             WHEN rs = 'no_peak' THEN 'exact_agreement'
             WHEN abs(p1 - b1) <= 1.0 AND (rs = 'single_peak' OR abs(p2 - b2) <= 1.0) THEN 'exact_agreement' ELSE 'rt_mislocalized' END AS db,
        CASE WHEN sa <> sb THEN 'unstable_class_across_smoothing' WHEN sa = 'ambiguous' THEN 'ambiguous_in_both_models'
             WHEN (a1 IS NULL) <> (b1 IS NULL) OR (a2 IS NULL) <> (b2 IS NULL) OR abs(a1 - b1) > 0.05::DOUBLE OR abs(a2 - b2) > 0.05::DOUBLE
             THEN 'unstable_rt_across_smoothing' ELSE 'stable_class_and_rt' END AS st
      FROM rd)""",
)
REVIEW_SQL = sql.with_ctes(
    *_REVIEW,
    select="""SELECT target_id, rs AS reference_status, sa AS baseline_status, sb AS experimental_status, da AS baseline_diagnostic,
    db AS experimental_diagnostic, st AS parameter_stability, meaning AS source_interpretation FROM rx""",
)


def review_views(spark, d):
    # The candidate-count view depends on adaptive picking and has its own query.
    rows = unnest(_review(spark, d), ["target_id"], F.col("views"))
    return (
        rows.where(
            ~F.col("p").isin(
                "review_queues/high_recall_candidate_explosion", "review_queues/low_clean_signal"
            )
        )
        .groupBy(F.col("p").alias("view"))
        .agg(F.count("*").alias("rows"), F.sum("target_id").cast("bigint").alias("id_sum"))
    )


REVIEW_VIEWS_SQL = sql.with_ctes(
    *_REVIEW,
    """vw AS (SELECT target_id, unnest(list_distinct(list_filter([
      'reference_ms1/supplied_rt/' || rs, 'auto_ms1/baseline/' || sa, 'reference_comparison/baseline/' || da,
      CASE WHEN st = 'stable_class_and_rt' THEN 'auto_ms1/consensus_stable/' || sa ELSE 'review_queues/' || st END,
      CASE WHEN abs(p2 - p1) * 60 < 12 THEN 'review_queues/close_or_shoulder_double' END,
      CASE WHEN sa = 'ambiguous' THEN 'review_queues/baseline_ambiguous' END,
      CASE WHEN da <> 'exact_agreement' THEN 'review_queues/baseline_vs_reference' END,
      CASE WHEN db <> 'exact_agreement' THEN 'review_queues/experimental_vs_reference' END,
      CASE WHEN da = 'exact_agreement' AND db <> 'exact_agreement' THEN 'review_queues/experimental_regression' END,
      CASE WHEN da <> 'exact_agreement' AND db = 'exact_agreement' THEN 'review_queues/experimental_improvement' END,
      CASE WHEN machine <> '' THEN 'source_machine/IG/' || CASE WHEN label = '' THEN 'UNLABELLED' ELSE label END END,
      CASE WHEN machine <> '' AND label = 'RED' THEN 'review_queues/source_machine_IG_red_unusable'
           WHEN machine <> '' AND label = 'CHECK' THEN 'review_queues/source_machine_IG_check' END,
      CASE WHEN resolution < 1 THEN 'review_queues/low_resolution_fwhm_lt1' END,
      CASE WHEN lo / hi < 0.1 THEN 'review_queues/weak_second_peak_ratio_lt0.1' END,
      CASE WHEN top_y >= 200000 AND top_y < 500000 THEN 'audit/intensity_0.2_to_0.5M' WHEN top_y >= 500000 AND top_y < 1000000 THEN 'audit/intensity_0.5_to_1M' END
      ], lambda v: v IS NOT NULL))) AS view FROM rx)""",
    select="SELECT view, count(*) AS rows, CAST(sum(target_id) AS BIGINT) AS id_sum FROM vw GROUP BY view",
)


def review_candidates(spark, d):
    return _review(spark, d).groupBy("candidate_pair_covers_reference", "low_clean_candidate").agg(
        F.count("*").alias("rows"), F.sum("review_candidate_count").alias("candidates")
    )


def scan_interval(spark, d):
    run, _ = run_and_targets(spark, d)
    return ms1_review.scan_intervals(run.axes)


SCAN_INTERVAL_SQL = sql.with_ctes(
    M1,
    select="""SELECT 'lineitem' AS raw_id, median(gap) AS scan_interval_sec FROM
    (SELECT rt - lag(rt) OVER (ORDER BY pos) AS gap FROM axis) WHERE gap IS NOT NULL""",
)

QUERIES = {
    "ms1_max_eic": (max_eic, MAX_EIC_SQL),
    "ms1_dense_traces": (dense_traces, DENSE_SQL),
    "ms1_savgol": (savgol, SAVGOL_SQL),
    "ms1_refined_candidates": (refined_candidates, REFINED_SQL),
    "ms1_picked_peaks": (picked_peaks, PICKED_SQL),
    "ms1_annotate": (annotate, ANNOTATE_SQL),
    "ms1_adaptive_calls": (adaptive_calls, ADAPTIVE_CALLS_SQL),
    "ms1_adaptive_candidates": (adaptive_candidates, ADAPTIVE_CANDIDATES_SQL),
    "ms1_background": (background, BACKGROUND_SQL),
    "ms1_review_diagnostics": (review_diagnostics, REVIEW_SQL),
    "ms1_review_views": (review_views, REVIEW_VIEWS_SQL),
    "ms1_review_candidates": (review_candidates, None),
    "ms1_scan_interval": (scan_interval, SCAN_INTERVAL_SQL),
}


# ---- tuning --------------------------------------------------------------------------


def _reviewed(targets):
    k = F.col("target_id")
    return targets.select(
        "*", ((k % 250) / F.lit(10.0)).alias("peak1"),
        F.when(k % 4 != 0, (k % 250) / F.lit(10.0) + F.lit(0.15)).alias("peak2"),
    )


#: The whole detection grid; its heights are a tenth, as the prices that stand for intensities are lower.
DETECTION = [replace(c, min_height=c.min_height / 10) for c in tuning.core_settings(False)]
_SETTING = ("sg_window", "min_height", "min_distance_scans")
_QUALITY = ("max_valley_ratio", "min_resolution", "min_second_peak_ratio")


def _grid_rows(spark, d):
    """Reviewed targets with their calls under every detection setting."""
    run, targets = run_and_targets(spark, d)
    calls = tuning.picked_grid(durable(ms1.traces(targets, run, 3.0)), DETECTION)
    return _reviewed(targets).join(calls, ["raw_id", "mz"])


def _grid_metrics(spark, d, adaptive):
    cells = tuning.quality_cells(_grid_rows(spark, d), tuning.LEGACY_QUALITY, 2.0)
    rows = tuning.grid_metrics(cells, tuning.LEGACY_QUALITY, adaptive)
    return rows.select(*[F.col(f"core.{n}").alias(n) for n in _SETTING], *[c for c in rows.columns if c not in ("core", "order")])


def tune_two_class(spark, d):
    """All 36 detection by all 48 quality settings."""
    return _grid_metrics(spark, d, False).select(*_SETTING, *_QUALITY, "tp", "fp", "tn", "fn", r6("balanced_accuracy"), r6("precision"))


def _grid_sql() -> str:
    """Every setting's calls, and their union <call>."""
    parts = [picks_sql(f"g{i}_", c) for i, c in enumerate(DETECTION)]
    calls = [
        f"SELECT {c.sg_window} AS sg_window, {c.min_height}::DOUBLE AS min_height, {c.min_distance_scans} AS min_distance_scans, * FROM g{i}_call"
        for i, c in enumerate(DETECTION)
    ]
    return ",\n".join(p.strip() for p in parts) + ",\ncall AS (" + " UNION ALL ".join(calls) + ")"


_TUNE = """
qg AS (SELECT v, r, s FROM (SELECT unnest([0.5, 0.7, 0.85, 1.0]::DOUBLE[]) AS v) CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS r)
  CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS s)),
tq AS (SELECT c.*, qg.v, qg.r, qg.s, c.target_id % 4 <> 0 AS truth, (c.target_id % 250) / 10.0::DOUBLE AS p1,
    (c.target_id % 250) / 10.0::DOUBLE + 0.15::DOUBLE AS p2,
    coalesce(status = 'double_peak' AND valley_ratio <= v AND (r <= 0 OR coalesce(resolution >= r, false)) AND lo / hi >= s, false) AS dbl
  FROM call c CROSS JOIN qg)
"""
TUNE_SQL = sql.with_ctes(
    M1, _grid_sql(), _TUNE,
    """tm2 AS (SELECT sg_window, min_height, min_distance_scans, v, r, s, count(*) FILTER (dbl AND truth) AS tp, count(*) FILTER (dbl AND NOT truth) AS fp,
      count(*) FILTER (NOT dbl AND NOT truth) AS tn, count(*) FILTER (NOT dbl AND truth) AS fn FROM tq GROUP BY ALL)""",
    select="""SELECT sg_window, min_height, min_distance_scans, v AS max_valley_ratio, r AS min_resolution, s AS min_second_peak_ratio, tp, fp, tn, fn,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision FROM tm2""",
)


def tune_rt_aware(spark, d):
    """All 36 detection by all 48 quality settings."""
    return _grid_metrics(spark, d, True).select(
        *_SETTING, *_QUALITY, "rows", "correct", "mislocalized", "close_double_rows", r6("macro_recall"), r6("double_peak_recall"),
    )


TUNE_RT_SQL = sql.with_ctes(
    M1, _grid_sql(), _TUNE,
    """tj AS (SELECT *, CASE WHEN truth THEN 'double_peak' ELSE 'single_peak' END AS t,
      CASE WHEN dbl THEN 'double_peak' WHEN status = 'single_peak' THEN 'single_peak' WHEN m1 IS NULL THEN 'no_peak' ELSE 'ambiguous' END AS c,
      least(greatest(abs(m1 - p1), abs(m2 - p2)), greatest(abs(m1 - p2), abs(m2 - p1))) <= 2.0 AS both_ok, abs(m1 - p1) <= 2.0 AS one_ok FROM tq)""",
    "tk AS (SELECT *, t = c AND CASE WHEN truth THEN both_ok ELSE one_ok END AS ok FROM tj)",
    select="""SELECT sg_window, min_height, min_distance_scans, v AS max_valley_ratio, r AS min_resolution, s AS min_second_peak_ratio, count(*) AS rows, count(*) FILTER (ok) AS correct,
    count(*) FILTER (t = c AND NOT ok) AS mislocalized, count(*) FILTER (truth AND abs(p2 - p1) * 60 <= 12.0) AS close_double_rows,
    round((count(*) FILTER (ok AND truth) / count(*) FILTER (truth) + count(*) FILTER (ok AND NOT truth) / count(*) FILTER (NOT truth)) / 2, 6) AS macro_recall,
    round(count(*) FILTER (ok AND truth) / count(*) FILTER (truth), 6) AS double_peak_recall FROM tk GROUP BY sg_window, min_height, min_distance_scans, v, r, s""",
)


def tune_rt_error(spark, d):
    """RT errors of every detection setting's doubles, at one quality setting."""
    rows = _grid_rows(spark, d).withColumn("q", F.struct(F.lit(1.0).alias("max_valley_ratio"), F.lit(0.0).alias("min_resolution"), F.lit(0.05).alias("min_second_peak_ratio")))
    return tuning.rt_error_summary(rows.select("*", *[F.col(f"core.{n}").alias(n) for n in _SETTING]), _SETTING).select(
        *_SETTING, "positive_rows", "predicted_double_rows", F.coalesce("both_rt_within_0_1_min", F.lit(0)).alias("within"),
        r6("median_worst_rt_error_min"), r6("p90_worst_rt_error_min"),
    )


TUNE_ERROR_SQL = sql.with_ctes(
    M1, _grid_sql(), _TUNE,
    """te AS (SELECT list(greatest(abs(m1 - p1), abs(m2 - p2)) ORDER BY greatest(abs(m1 - p1), abs(m2 - p2))) FILTER (dbl) AS e, count(*) AS n,
      sg_window, min_height, min_distance_scans FROM tq WHERE truth AND v = 1.0 AND r = 0.0 AND s = 0.05::DOUBLE GROUP BY ALL)""",
    select="""SELECT sg_window, min_height, min_distance_scans, n AS positive_rows, CAST(coalesce(len(e), 0) AS BIGINT) AS predicted_double_rows,
    CAST(coalesce(len(list_filter(e, lambda x: x <= 0.1::DOUBLE)), 0) AS BIGINT) AS within,
    round(e[len(e) // 2 + 1], 6) AS median_worst_rt_error_min, round(e[CAST(floor(0.9::DOUBLE * (len(e) - 1)) AS INT) + 1], 6) AS p90_worst_rt_error_min FROM te""",
)


def tune_adaptive(spark, d):
    """All 216 settings of the adaptive picker by all 16 quality settings."""
    run, targets = run_and_targets(spark, d)
    core = [replace(c, min_height=c.min_height and c.min_height / 10) for c in tuning.core_settings(True)]
    calls = tuning.picked_grid(durable(ms1.traces(targets, run, 3.0)), core)
    cells = tuning.quality_cells(_reviewed(targets).join(calls, ["raw_id", "mz"]), tuning.ADAPTIVE_QUALITY, 2.0)
    rows = tuning.grid_metrics(cells, tuning.ADAPTIVE_QUALITY, True)
    return rows.select(F.col("core.order").alias("setting"), "core.*", *[c for c in rows.columns if c not in ("core", "order")]).drop("order")


QUERIES |= {
    "tune_adaptive": (tune_adaptive, None),
    "tune_two_class": (tune_two_class, TUNE_SQL),
    "tune_rt_aware": (tune_rt_aware, TUNE_RT_SQL),
    "tune_rt_error": (tune_rt_error, TUNE_ERROR_SQL),
}
