"""Shared SQL fragments of the oracle statements (DuckDB dialect)."""

from __future__ import annotations

# embeddings -> long spectra, filtered spectra, neighbouring pairs
SPECTRA = """
spec AS (
  SELECT vec_id, label, i,
         100.0::DOUBLE + (i // 2) * 2.0::DOUBLE + (i % 2) * 0.006::DOUBLE
           + CASE WHEN vec_id % 4 IN (1, 2) THEN ((vec_id * (i + 1)) % 7) * 0.0021::DOUBLE
                  ELSE 0.0::DOUBLE END AS mz,
         1000.0::DOUBLE * power(10.0::DOUBLE * abs(e::DOUBLE), 2) AS it
  FROM (SELECT vec_id, label, unnest(embedding) AS e,
               unnest(range(len(embedding))) AS i FROM embeddings)
  WHERE vec_id % 5 <> 0 OR 1000.0::DOUBLE * power(10.0::DOUBLE * abs(e::DOUBLE), 2) >= 2000.0::DOUBLE),
prep AS (
  SELECT vec_id, mz, it,
         row_number() OVER (PARTITION BY vec_id ORDER BY mz, it) - 1 AS idx
  FROM (SELECT *, max(it) OVER (PARTITION BY vec_id) AS top FROM spec WHERE it > 0)
  WHERE it >= top * 0.01::DOUBLE),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS same
  FROM embeddings x JOIN embeddings y
    ON y.vec_id IN (x.vec_id + 1, x.vec_id + 2, x.vec_id + 3, x.vec_id + 4))
"""

# Greedy exclusive matching over candidates (key…, i, j, err, neg); keys are (a, b).
GREEDY = """
folded AS (
  SELECT a, b,
         list_reduce(
           list({'i': [i], 'j': [j]} ORDER BY err, neg, i, j),
           lambda acc, x: CASE WHEN list_contains(acc.i, x.i[1]) OR list_contains(acc.j, x.j[1])
                               THEN acc
                               ELSE {'i': list_concat(acc.i, x.i),
                                     'j': list_concat(acc.j, x.j)} END) AS m
  FROM cand GROUP BY a, b),
matches AS (SELECT a, b, unnest(m.i) AS i, unnest(m.j) AS j FROM folded)
"""

CAND_PAIRS = """
cand AS (
  SELECT p.a, p.b, pa.idx AS i, pb.idx AS j, abs(pa.mz - pb.mz) AS err,
         -(pa.it * pb.it) AS neg
  FROM pairs p JOIN prep pa ON pa.vec_id = p.a JOIN prep pb ON pb.vec_id = p.b
  WHERE abs(pa.mz - pb.mz) <= 0.01::DOUBLE)
"""

# Scores of pairs(a, b) given side_a(k, idx, it), side_b(k, idx, it), matches(a, b, i, j);
# left/right keys of a pair are ka and kb.
SCORES = """
prob AS (
  SELECT side, k, idx, it, it / sum(it) OVER (PARTITION BY side, k) AS p
  FROM (SELECT 'a' AS side, * FROM side_a UNION ALL SELECT 'b' AS side, * FROM side_b)),
ent AS (SELECT side, k, -sum(p * ln(p)) AS h FROM prob GROUP BY side, k),
powed AS (
  SELECT q.side, q.k, q.idx, q.it,
         CASE WHEN h < 3 THEN power(p, 0.25::DOUBLE * (1 + h)) ELSE p END AS w, h
  FROM prob q JOIN ent e ON q.side = e.side AND q.k = e.k),
wt AS (
  SELECT side, k, idx, it,
         CASE WHEN h < 3 THEN w / sum(w) OVER (PARTITION BY side, k) ELSE w END AS w
  FROM powed),
side_stats AS (
  SELECT side, k, count(*) AS n, sum(it) AS tot,
         sqrt(sum(power(it, 0.5::DOUBLE) * power(it, 0.5::DOUBLE))) AS norm,
         -sum(w * ln(w)) AS hw, -sum(w / 2 * ln(w / 2)) AS half
  FROM wt GROUP BY side, k),
hit AS (
  SELECT p.a, p.b, count(*) AS matched,
         sum(power(x.it, 0.5::DOUBLE) * power(y.it, 0.5::DOUBLE)) AS dot,
         sum(x.it) AS ita, sum(y.it) AS itb,
         sum((x.w + y.w) / 2 * ln((x.w + y.w) / 2)
             - x.w / 2 * ln(x.w / 2) - y.w / 2 * ln(y.w / 2)) AS corr
  FROM matches m JOIN keyed p ON p.a = m.a AND p.b = m.b
  JOIN wt x ON x.side = 'a' AND x.k = p.ka AND x.idx = m.i
  JOIN wt y ON y.side = 'b' AND y.k = p.kb AND y.idx = m.j
  GROUP BY p.a, p.b),
scores AS (
  SELECT p.a, p.b,
         coalesce(h.matched, 0) AS matched,
         coalesce(sa.n, 0) AS count_a, coalesce(sb.n, 0) AS count_b,
         CASE WHEN sa.n > 0 AND sb.n > 0
              THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(h.dot, 0) / (sa.norm * sb.norm)))
              END AS cosine,
         CASE WHEN sa.n > 0 AND sb.n > 0 THEN coalesce(h.ita, 0) / sa.tot END AS explained_a,
         CASE WHEN sa.n > 0 AND sb.n > 0 THEN coalesce(h.itb, 0) / sb.tot END AS explained_b,
         CASE WHEN sa.n > 0 AND sb.n > 0 THEN
           least(1.0::DOUBLE, greatest(0.0::DOUBLE,
             1 - (2 * (sa.half + sb.half - coalesce(h.corr, 0)) - sa.hw - sb.hw) / ln(4.0::DOUBLE)))
           END AS entropy
  FROM keyed p
  LEFT JOIN side_stats sa ON sa.side = 'a' AND sa.k = p.ka
  LEFT JOIN side_stats sb ON sb.side = 'b' AND sb.k = p.kb
  LEFT JOIN hit h ON h.a = p.a AND h.b = p.b)
"""

PAIR_SIDES = """
keyed AS (SELECT a, b, a AS ka, b AS kb FROM pairs),
side_a AS (SELECT vec_id AS k, idx, it FROM prep),
side_b AS (SELECT vec_id AS k, idx, it FROM prep)
"""

STATUS = """
judged AS (
  SELECT *,
    CASE WHEN cosine IS NULL THEN 'not_evaluable'
         WHEN matched < 6 THEN 'insufficient_ms2_evidence'
         WHEN cosine < 0.7 THEN 'ms2_not_similar'
         WHEN least(explained_a, explained_b) < 0.5 THEN 'ms2_not_similar'
         ELSE 'candidate_enantiomer_pair' END AS status,
    CASE WHEN cosine IS NULL THEN 'one_or_both_ms2_spectra_are_empty'
         WHEN matched < 6 THEN 'matched_peaks<6'
         WHEN cosine < 0.7 THEN 'cosine<0.7'
         WHEN least(explained_a, explained_b) < 0.5 THEN 'explained_intensity<0.5'
         ELSE 'separated_same_precursor_peaks_with_similar_ms2;R_S_assignment_requires_authentic_enantiomer_standards'
         END AS reason
  FROM scores)
"""

# diagnosis over rows with status, reason, flags_a, flags_b, window_matches and scores
DIAGNOSIS = """
diag0 AS (
  SELECT *,
    CASE WHEN status = 'not_evaluated' THEN 'not_attempted'
         WHEN reason IN ('precursor_outside_acquired_DIA_windows', 'invalid_precursor_mz',
                         'peak_retention_times_are_identical') THEN 'not_evaluable'
         WHEN status = 'candidate_enantiomer_pair' THEN 'supported_same_compound'
         WHEN status = 'ms2_not_similar' THEN 'conflicting_spectra'
         WHEN status = 'insufficient_ms2_evidence' THEN 'insufficient_evidence'
         ELSE 'not_evaluable' END AS diagnostic,
    coalesce(flags_a, '') || ';' || coalesce(flags_b, '') AS q,
    least(explained_a, explained_b) AS emin
  FROM judged),
diag AS (
  SELECT *, concat_ws(';',
    CASE WHEN status = 'not_evaluated' THEN 'MS2_NOT_ATTEMPTED_NO_RT_PAIR' END,
    CASE WHEN status <> 'not_evaluated' AND (reason = 'precursor_outside_acquired_DIA_windows'
              OR contains(q, 'no_matching_DIA_window')) THEN 'NO_ACQUIRED_DIA_WINDOW' END,
    CASE WHEN reason = 'invalid_precursor_mz' THEN 'INVALID_PRECURSOR_MZ' END,
    CASE WHEN reason = 'peak_retention_times_are_identical' THEN 'IDENTICAL_RT_COORDINATES' END,
    CASE WHEN contains(q, 'no_precursor_signal') THEN 'NO_PRECURSOR_SIGNAL' END,
    CASE WHEN contains(q, 'no_fragments') OR contains(reason, 'spectra_are_empty')
         THEN 'EMPTY_ONE_OR_BOTH_SPECTRA' END,
    CASE WHEN cosine IS NOT NULL AND matched < 6 THEN 'TOO_FEW_MATCHED_FRAGMENTS' END,
    CASE WHEN cosine < 0.7 THEN 'LOW_COSINE_SIMILARITY' END,
    CASE WHEN cosine IS NOT NULL AND emin < 0.5 THEN 'LOW_EXPLAINED_INTENSITY' END,
    CASE WHEN cosine IS NOT NULL AND greatest(count_a, count_b) >= 8
          AND greatest(count_a, count_b) >= 3 * greatest(least(count_a, count_b), 1)
         THEN 'FRAGMENT_COUNT_IMBALANCE' END,
    CASE WHEN cosine IS NOT NULL AND matched >= 6 AND abs(explained_a - explained_b) >= 0.15
          AND emin < 0.85 THEN 'ASYMMETRIC_UNMATCHED_INTENSITY' END,
    CASE WHEN cosine IS NOT NULL AND diagnostic = 'supported_same_compound'
          AND (cosine < 0.7 + 0.1 OR matched <= 7 OR emin < 0.5 + 0.1)
         THEN 'NEAR_DECISION_BOUNDARY' END,
    CASE WHEN window_matches > 1 THEN 'OVERLAPPING_DIA_WINDOWS' END) AS issues
  FROM diag0),
final AS (
  SELECT *,
    CASE WHEN diagnostic = 'conflicting_spectra' THEN 'P1_conflict'
         WHEN contains(issues, 'OVERLAPPING_DIA_WINDOWS') OR contains(issues, 'NEAR_DECISION_BOUNDARY')
           OR contains(issues, 'ASYMMETRIC_UNMATCHED_INTENSITY') THEN 'P2_boundary_or_interference'
         WHEN diagnostic = 'insufficient_evidence' THEN 'P3_insufficient'
         WHEN diagnostic = 'supported_same_compound' THEN 'P4_supported_audit'
         ELSE 'P5_not_evaluable' END AS priority
  FROM diag)
"""

# events -> MS2 centroids and windows; customer -> targets
MS2 = """
pk AS (
  SELECT win, scan, scan * 6.0::DOUBLE AS rt, mz, sum(v) AS it FROM (
    SELECT CASE event_type WHEN 'click' THEN 312.0::DOUBLE WHEN 'error' THEN 324.0::DOUBLE
                WHEN 'purchase' THEN 336.0::DOUBLE WHEN 'signup' THEN 348.0::DOUBLE
                WHEN 'view' THEN 360.0::DOUBLE END AS win,
           CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 4 + hour(ts) // 6 AS INT) AS scan,
           CASE WHEN user_id % 10 >= 6
                THEN CASE event_type WHEN 'click' THEN 312.0::DOUBLE WHEN 'error' THEN 324.0::DOUBLE
                     WHEN 'purchase' THEN 336.0::DOUBLE WHEN 'signup' THEN 348.0::DOUBLE
                     WHEN 'view' THEN 360.0::DOUBLE END + (event_id % 3) * 0.0005::DOUBLE
                ELSE 100.0::DOUBLE + 20.0::DOUBLE * (user_id % 10) + (event_id % 5) * 0.0004::DOUBLE
           END AS mz,
           value * 1000.0::DOUBLE AS v
    FROM events) WHERE win IS NOT NULL GROUP BY win, scan, mz),
heads AS (SELECT DISTINCT win, scan, rt FROM pk),
wins AS (
  SELECT win, win - 7.0::DOUBLE AS lo, win + 7.0::DOUBLE AS hi, min(mz) AS mz_min,
         max(mz) AS mz_max, min(rt) AS rt_first, max(rt) AS rt_last,
         count(DISTINCT scan) AS n_scans
  FROM pk GROUP BY win)
"""

TARGETS = """
tg AS (
  SELECT c_custkey AS row_id, c_name AS compound_id, c_mktsegment AS pool,
         CASE WHEN c_custkey % 2 = 0 THEN 312.0::DOUBLE + 12.0::DOUBLE * (c_custkey % 5)
              ELSE 290.0::DOUBLE + (c_custkey % 800) / 10.0::DOUBLE END AS mz,
         (c_custkey % 60) / 6.0::DOUBLE AS p1,
         CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 7 = 0
              THEN (c_custkey % 60) / 6.0::DOUBLE + (c_custkey % 17) / 20.0::DOUBLE END AS p2
  FROM customer),
routed AS (
  SELECT t.row_id, w.win, w.lo, w.hi, w.mz_min, w.mz_max, w.rt_first, w.rt_last,
         abs(w.win - t.mz) AS dist, count(*) OVER (PARTITION BY t.row_id) AS match_count,
         row_number() OVER (PARTITION BY t.row_id ORDER BY abs(w.win - t.mz), w.win) AS rn
  FROM tg t JOIN wins w ON t.mz BETWEEN w.lo AND w.hi),
nearest AS (SELECT * FROM routed WHERE rn = 1)
"""

# precursor side table with RT half window 60 s and 10 ppm bands
SIDES = """
sep AS (
  SELECT *, abs(p2 * 60.0::DOUBLE - p1 * 60.0::DOUBLE) AS separation,
         least(60.0::DOUBLE, abs(p2 * 60.0::DOUBLE - p1 * 60.0::DOUBLE) * 0.4::DOUBLE) AS half
  FROM tg),
sides AS (
  SELECT s.row_id, side, s.mz, n.win, n.match_count, n.mz_min, n.mz_max,
         greatest(n.mz_min, s.mz - s.mz * 10.0::DOUBLE / 1000000.0::DOUBLE) AS mz_lo,
         least(n.mz_max, s.mz + s.mz * 10.0::DOUBLE / 1000000.0::DOUBLE) AS mz_hi,
         greatest(n.rt_first, centre - half) AS rt_lo, least(n.rt_last, centre + half) AS rt_hi
  FROM (SELECT *, 'peak_a' AS side, p1 * 60.0::DOUBLE AS centre FROM sep
        UNION ALL SELECT *, 'peak_b' AS side, p2 * 60.0::DOUBLE AS centre FROM sep) s
  LEFT JOIN nearest n ON n.row_id = s.row_id
  WHERE s.separation > 0),
blocked AS (
  SELECT *, CASE WHEN win IS NULL THEN 'no_matching_DIA_window'
                 WHEN mz_lo >= mz_hi THEN 'mz_out_of_range'
                 WHEN rt_lo >= rt_hi THEN 'rt_window_out_of_range' END AS why FROM sides),
trace AS (
  SELECT b.row_id, b.side, h.scan, h.rt,
         coalesce((SELECT sum(p.it) FROM pk p WHERE p.win = b.win AND p.scan = h.scan
                   AND p.mz BETWEEN b.mz_lo AND b.mz_hi), 0.0::DOUBLE) AS it
  FROM blocked b JOIN heads h ON h.win = b.win AND h.rt BETWEEN b.rt_lo AND b.rt_hi
  WHERE b.why IS NULL),
trace_lag AS (
  SELECT *, lag(rt) OVER w AS rt0, lag(it) OVER w AS it0 FROM trace
  WINDOW w AS (PARTITION BY row_id, side ORDER BY rt)),
xic AS (
  SELECT row_id, side, count(*) AS n_scans,
         arg_max(rt, (it, -scan)) AS apex_rt, max(it) AS apex_it,
         CASE WHEN count(*) >= 2 THEN sum((rt - rt0) * (it0 + it) / 2) END AS area
  FROM trace_lag GROUP BY row_id, side),
chosen AS (
  SELECT * FROM (
    SELECT row_id, side, scan, row_number() OVER (PARTITION BY row_id, side ORDER BY it DESC, scan) AS rn
    FROM trace WHERE it > 0) WHERE rn <= 1)
"""

FRAGMENTS = """
cands AS (
  SELECT c.row_id, c.side,
         list_reduce(
           list({'d': []::DOUBLE[], 'w': p.it, 'm': p.mz * p.it, 'z': p.mz} ORDER BY p.mz, p.it),
           lambda acc, x: CASE
             WHEN x.z BETWEEN acc.m / acc.w - (acc.m / acc.w) * 10.0::DOUBLE / 1000000.0::DOUBLE
                          AND acc.m / acc.w + (acc.m / acc.w) * 10.0::DOUBLE / 1000000.0::DOUBLE
             THEN {'d': acc.d, 'w': acc.w + x.w, 'm': acc.m + x.m, 'z': x.z}
             ELSE {'d': list_append(acc.d, acc.m / acc.w), 'w': x.w, 'm': x.m, 'z': x.z} END) AS f
  FROM chosen c JOIN blocked b ON b.row_id = c.row_id AND b.side = c.side
  JOIN pk p ON p.win = b.win AND p.scan = c.scan
  WHERE p.mz < b.mz - 10 AND p.it > 0 GROUP BY c.row_id, c.side),
centres AS (
  SELECT row_id, side, unnest(list_append(f.d, f.m / f.w)) AS c,
         len(f.d) + 1 AS n_centres FROM cands),
frag AS (
  SELECT t.row_id, t.side, z.c, t.scan, t.it AS x,
         coalesce((SELECT sum(p.it) FROM pk p WHERE p.win = b.win AND p.scan = t.scan
           AND p.mz BETWEEN greatest(b.mz_min, z.c - z.c * 10.0::DOUBLE / 1000000.0::DOUBLE)
                        AND least(b.mz_max, z.c + z.c * 10.0::DOUBLE / 1000000.0::DOUBLE)), 0.0::DOUBLE) AS y
  FROM centres z JOIN trace t ON t.row_id = z.row_id AND t.side = z.side
  JOIN blocked b ON b.row_id = t.row_id AND b.side = t.side
  WHERE greatest(b.mz_min, z.c - z.c * 10.0::DOUBLE / 1000000.0::DOUBLE)
      < least(b.mz_max, z.c + z.c * 10.0::DOUBLE / 1000000.0::DOUBLE)),
corr AS (
  SELECT row_id, side, c, max(y) AS top,
         CASE WHEN max(x) > min(x) AND max(y) > min(y)
              THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS r,
         max(x) > min(x) AND max(y) > min(y) AS varies
  FROM frag GROUP BY row_id, side, c),
kept AS (SELECT row_id, side, c AS mz, top AS it FROM corr WHERE varies AND top >= 2000.0 AND r > 0.9::DOUBLE),
side_out AS (
  SELECT b.row_id, b.side, b.why, b.win, b.match_count,
         CASE WHEN b.why IS NULL THEN coalesce(x.n_scans, 0) END AS ms2_count,
         x.apex_rt, x.apex_it, x.area,
         CASE WHEN x.apex_it > 0 THEN (SELECT count(*) FROM chosen c WHERE c.row_id = b.row_id AND c.side = b.side) END AS n_cons,
         (SELECT max(n_centres) FROM centres c WHERE c.row_id = b.row_id AND c.side = b.side) AS n_cand,
         (SELECT count(*) FROM kept k WHERE k.row_id = b.row_id AND k.side = b.side) AS n_kept
  FROM blocked b LEFT JOIN xic x ON x.row_id = b.row_id AND x.side = b.side),
flagged AS (
  SELECT *, coalesce(why, nullif(concat_ws(';',
      CASE WHEN ms2_count = 0 THEN 'no_ms2_scans' END,
      CASE WHEN ms2_count = 1 THEN 'insufficient_points' END,
      CASE WHEN ms2_count > 0 AND apex_it <= 0 THEN 'no_precursor_signal' END,
      CASE WHEN apex_it > 0 AND n_cand IS NULL THEN 'no_candidate_fragments' END,
      CASE WHEN n_cand IS NOT NULL AND n_kept = 0 THEN 'no_fragments' END), ''), 'ok') AS flags
  FROM side_out)
"""

ANALYZE = """
base AS (
  SELECT row_id, side, mz, it, row_number() OVER (PARTITION BY row_id, side ORDER BY mz, it) - 1 AS idx
  FROM (SELECT *, max(it) OVER (PARTITION BY row_id, side) AS top FROM kept)
  WHERE it >= top * 0.01::DOUBLE),
keyed AS (SELECT DISTINCT row_id AS a, 0 AS b, row_id AS ka, row_id AS kb FROM blocked WHERE win IS NOT NULL),
side_a AS (SELECT row_id AS k, idx, it FROM base WHERE side = 'peak_a'),
side_b AS (SELECT row_id AS k, idx, it FROM base WHERE side = 'peak_b'),
cand AS (
  SELECT x.row_id AS a, 0 AS b, x.idx AS i, y.idx AS j, abs(x.mz - y.mz) AS err, -(x.it * y.it) AS neg
  FROM base x JOIN base y ON x.row_id = y.row_id AND x.side = 'peak_a' AND y.side = 'peak_b'
  WHERE abs(x.mz - y.mz) <= 0.01::DOUBLE)
"""

ANALYZE_JUDGED = """
judged AS (
  SELECT t.row_id, t.compound_id, t.pool, t.mz, t.p1, t.p2, s.separation, s.half,
         n.win, n.match_count, n.match_count AS window_matches,
         fa.flags AS flags_a, fb.flags AS flags_b, fa.ms2_count AS ms2_count_a, fb.ms2_count AS ms2_count_b,
         fa.apex_rt AS apex_rt_a, fb.apex_rt AS apex_rt_b, fa.apex_it AS apex_it_a, fb.apex_it AS apex_it_b,
         fa.area AS area_a, fb.area AS area_b, fa.n_cand AS cand_a, fb.n_cand AS cand_b,
         CASE WHEN n.win IS NOT NULL AND s.separation > 0 THEN coalesce(fa.n_kept, 0) END AS kept_a,
         CASE WHEN n.win IS NOT NULL AND s.separation > 0 THEN coalesce(fb.n_kept, 0) END AS kept_b,
         c.cosine, c.matched, c.entropy, c.explained_a, c.explained_b, c.count_a, c.count_b,
         CASE WHEN t.p2 IS NULL THEN 'not_evaluated'
              WHEN s.separation = 0 THEN 'not_evaluable'
              WHEN n.win IS NULL THEN 'not_evaluable'
              WHEN c.cosine IS NULL THEN 'not_evaluable'
              WHEN c.matched < 6 THEN 'insufficient_ms2_evidence'
              WHEN c.cosine < 0.7 OR least(c.explained_a, c.explained_b) < 0.5 THEN 'ms2_not_similar'
              ELSE 'candidate_enantiomer_pair' END AS status,
         CASE WHEN t.p2 IS NULL THEN 'two_peak_retention_times_required'
              WHEN s.separation = 0 THEN 'peak_retention_times_are_identical'
              WHEN n.win IS NULL THEN 'precursor_outside_acquired_DIA_windows'
              WHEN c.cosine IS NULL THEN 'one_or_both_ms2_spectra_are_empty'
              WHEN c.matched < 6 THEN 'matched_peaks<6'
              WHEN c.cosine < 0.7 THEN 'cosine<0.7'
              WHEN least(c.explained_a, c.explained_b) < 0.5 THEN 'explained_intensity<0.5'
              ELSE 'separated_same_precursor_peaks_with_similar_ms2;R_S_assignment_requires_authentic_enantiomer_standards' END AS reason
  FROM tg t JOIN sep s ON s.row_id = t.row_id
  LEFT JOIN nearest n ON n.row_id = t.row_id AND s.separation > 0
  LEFT JOIN flagged fa ON fa.row_id = t.row_id AND fa.side = 'peak_a'
  LEFT JOIN flagged fb ON fb.row_id = t.row_id AND fb.side = 'peak_b'
  LEFT JOIN scores c ON c.a = t.row_id)
"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


ANALYZE_CTES = (
    MS2, TARGETS, SIDES, FRAGMENTS, ANALYZE, GREEDY, SCORES, ANALYZE_JUDGED, DIAGNOSIS,
)
