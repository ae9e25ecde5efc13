import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from twinpeak.functions import scalars
from twinpeak.functions import trace as tr
from twinpeak.operators import ms1, ms1_review
from twinpeak.params import PeakPickSettings

ADAPTIVE = dict(sg_window=3, min_height=None, min_prominence_ratio=0.1, min_support_scans=2,
                min_distance_sec=6.0, close_peak_max_valley_ratio=0.85, rank_by_prominence=True)


def traced(spark, traces, rts=None):
    rows = [
        (k, [float(v) for v in y], [float(t) for t in (rts or range(len(y)))]) for k, y in traces.items()
    ]
    return spark.createDataFrame(rows, "k string, y array<double>, rts array<double>")


def picks(spark, traces, rts=None, **kw):
    out = ms1.pick_peaks(traced(spark, traces, rts), PeakPickSettings(**kw))
    return {r.k: r for r in out.collect()}


def two_gaussians():
    return [220e3 * math.exp(-(((i - 25) / 4) ** 2)) + 180e3 * math.exp(-(((i - 70) / 5) ** 2)) for i in range(100)]


def test_savgol_keeps_constants_and_parabolas(spark):
    df = traced(spark, {"c": [5.0] * 21, "p": [float(i * i) for i in range(21)], "s": [1.0, 4.0, 9.0, 16.0, 25.0]})
    got = {r.k: r.s for r in df.select("k", tr.savgol(F.col("y"), 7, 2).alias("s")).collect()}
    assert got["c"] == pytest.approx([5.0] * 21)
    assert got["p"] == pytest.approx([float(i * i) for i in range(21)])
    assert len(got["s"]) == 5 and got["s"][2] == pytest.approx(9.0)


def test_absolute_height_double_peak(spark):
    r = picks(spark, {"g": two_gaussians()})["g"]
    assert r.chromatographic_status == "double_peak"
    assert [p.scan for p in r.peaks] == [25, 70]
    assert r.resolution > 1 and all(p.area > 0 for p in r.peaks)


def test_low_clean_peak_needs_no_height(spark):
    y = [8 + 42 * math.exp(-(((i - 20) / 3) ** 2)) for i in range(41)]
    r = picks(spark, {"l": y}, min_height=None, min_prominence_ratio=0.8, min_support_scans=3)["l"]
    assert (r.chromatographic_status, [p.scan for p in r.peaks]) == ("single_peak", [20])
    assert r.peaks[0].prominence_ratio > 0.8 and "absolute_height_disabled" in r.review_reasons


def test_close_valley_is_a_double_peak(spark):
    y = [0.0] * 25
    y[8:17] = [1, 6, 10, 6, 2, 7, 9, 5, 1]
    r = picks(spark, {"v": y}, **ADAPTIVE)["v"]
    assert [p.scan for p in r.peaks] == [10, 14] and "close_peak_pair" in r.review_reasons


def test_spike_is_ambiguous_and_irregular_rts_use_seconds(spark):
    spike = [0.0] * 30
    spike[15] = 50.0
    r = picks(spark, {"s": spike}, sg_window=3, sg_polyorder=0, min_height=None, min_support_scans=4)["s"]
    assert r.chromatographic_status == "ambiguous" and r.peaks == []
    rts = [*range(11), *range(30, 35)]
    y = [0.0] * 16
    y[9:12], y[12:15] = [2, 10, 2], [3, 9, 3]
    two = picks(spark, {"i": y}, rts, sg_window=3, min_height=None, min_prominence_ratio=0.1,
                min_distance_sec=10.0, refine_radius_scans=0, rank_by_prominence=True)["i"]
    assert [p.scan for p in two.peaks] == [10, 13]


def test_resolution_rules(spark):
    row = spark.range(1).select(
        scalars.resolution_fwhm(F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(3.0)),
        scalars.resolution_fwhm(F.lit(0.0), F.lit(10.0), F.lit(None).cast("double"), F.lit(3.0)),
        scalars.resolution_passes(F.lit(None).cast("double"), 0.0),
        scalars.resolution_passes(F.lit(None).cast("double"), None),
        scalars.resolution_passes(F.lit(None).cast("double"), 0.5),
    ).first()
    assert row[0] == pytest.approx(2.35482) and row[1] is None
    assert list(row)[2:] == [True, True, False]


def brute_prominence(y, i, base):
    h, left, right = y[i], y[i], y[i]
    for c in range(i - 1, -1, -1):
        left = min(left, y[c])
        if y[c] > h:
            break
    for c in range(i + 1, len(y)):
        right = min(right, y[c])
        if y[c] > h:
            break
    return max(0.0, h - max(base, left, right))


def brute_support(y, i, prominence):
    if prominence == 0:
        return 0
    first = last = i
    while first > 0 and y[first - 1] >= y[i] - prominence / 2:
        first -= 1
    while last < len(y) - 1 and y[last + 1] >= y[i] - prominence / 2:
        last += 1
    return last - first + 1


@pytest.mark.parametrize("floor", [None, 6.0])
def test_prominence_equals_brute_force(spark, floor):
    """Ties, plateaus, slopes up to the borders, and traces too short to hold a maximum."""
    rng = random.Random(1)
    many = [[float(rng.randrange(k)) - 2 for _ in range(n)] for k in (2, 4, 12, 1000) for n in (0, 1, 2, 3, 5, 60, 61) for _ in range(4)]
    many += [[float(i) for i in range(20)], [float(-i) for i in range(20)], [1.0] * 9, [0.0, 5.0, 5.0, 5.0, 0.0, 5.0, 0.0]]
    rows = [(n, y, statistics.median(y) if y else 0.0) for n, y in enumerate(many)]
    df = spark.createDataFrame(rows, "n int, y array<double>, b double").repartition(4)
    got = {r.n: r.m for r in df.select("n", tr.measured_maxima(F.col("y"), F.col("b"), floor).alias("m")).collect()}
    found = 0
    for n, y, base in rows:
        want = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1] and (floor is None or y[i] >= floor)]
        prominences = [brute_prominence(y, i, base) for i in want]
        assert [m.idx for m in got[n]] == want and [m.prominence for m in got[n]] == prominences
        assert [m.support for m in got[n]] == [brute_support(y, i, p) for i, p in zip(want, prominences, strict=True)]
        assert [m.ratio for m in got[n]] == [min(1.0, p / (y[i] - base)) if y[i] > base else 0.0 for i, p in zip(want, prominences, strict=True)]
        found += len(want)
    assert found > 200


def test_candidates_before_top_k(spark):
    y = [0.0] * 80
    for c in (15, 40, 65):
        for k in range(-5, 6):
            y[c + k] = float(6 - abs(k))
    rows = ms1.enumerate_candidates(traced(spark, {"t": y}), PeakPickSettings(**ADAPTIVE)).collect()
    assert [c.scan for c in rows[0].candidates] == [15, 40, 65]


def test_traces_are_dense_and_float32(spark):
    peaks = spark.createDataFrame(
        [("r", 0, 0.0, 100.0, 0.1), ("r", 2, 2.0, 100.0002, 5.0), ("r", 2, 2.0, 100.0001, 7.0), ("r", 3, 3.0, 50.0, 1.0), ("r", 1, 1.0, 50.0, 1.0)],
        "raw_id string, scan int, rt double, mz double, it double",
    )
    targets = spark.createDataFrame([("r", 100.0), ("r", 200.0), ("r", 100.0)], "raw_id string, mz double")
    got = {r.mz: r.y for r in ms1.traces(targets, ms1.run_from_peaks(peaks)).collect()}
    import struct

    assert got == {100.0: [struct.unpack("f", struct.pack("f", 0.1))[0], 0.0, 7.0, 0.0], 200.0: [0.0] * 4}


def test_background_flags_a_low_clean_peak(spark):
    y = [0.0] * 100
    y[48:53] = [10, 60e3, 120e3, 60e3, 10]
    df = traced(spark, {"b": y})
    b = df.select(tr.background(F.col("rts"), F.col("y"), F.array(F.lit(50 / 60))).alias("b")).first().b
    assert b.low_clean_candidate and b.max_half_height_support_scans == 3


def test_pair_cover_and_double_match(spark):
    df = spark.createDataFrame(
        [([(10, 60.0), (20, 120.0)], 1.0, 2.0), ([(10, 60.0)], 1.0, 1.0), ([(10, 120.0), (20, 60.0)], 1.0, 2.0)],
        "c array<struct<scan:int,rt:double>>, a double, b double",
    )
    cover = [r[0] for r in df.select(ms1_review.candidates_cover(F.col("c"), F.col("a"), F.col("b"), 0.05)).collect()]
    assert cover == [True, False, True]
    m = spark.range(1).select(
        ms1_review.double_rts_match(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.05)), 0.1),
        ms1_review.double_rts_match(F.array(F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)), 0.1),
    ).first()
    assert list(m) == [True, False]


def test_settings_from_two_sections():
    c = PeakPickSettings.from_json('{"peak_picking_config": {"sg_window": 5}, "quality_thresholds": {"max_valley_ratio": 0.7}}')
    assert (c.sg_window, c.max_valley_ratio, c.adaptive) == (5, 0.7, False)
    with pytest.raises(ValueError):
        PeakPickSettings(sg_window=4)
    with pytest.raises(ValueError):
        PeakPickSettings.from_json('{"unknown": 1}')


@pytest.mark.parametrize("adaptive", [False, True])
def test_all_settings_in_one_job_equal_one_job_a_setting(spark, adaptive):
    """Cells, metrics and the best setting against picks of each setting judged call by call."""
    from twinpeak.plans import tuning

    rng = random.Random(6)
    rows = []
    for n in range(40):
        y = [rng.random() * 300 for _ in range(120)]
        for centre in rng.sample(range(10, 110), rng.choice([0, 1, 2, 2, 3])):
            top, wide = rng.choice([900.0, 4000.0, 60_000.0]), rng.choice([2, 4, 7])
            for k in range(-9, 10):
                y[centre + k] += top * 2.0 ** (-((k / wide) ** 2))
        rows.append(("r", float(n), [float(i) * 3 for i in range(120)], y, n))
    traces = spark.createDataFrame(rows, "raw_id string, mz double, rts array<double>, y array<double>, n int").repartition(3)
    targets = traces.select("raw_id", "mz", F.when(F.col("n") % 7 != 0, F.col("n") / 10).alias("peak1"), F.when(F.col("n") % 7 > 2, F.col("n") / 10 + 0.15).alias("peak2"))
    traces = traces.drop("n")
    core = [PeakPickSettings(**{**c.__dict__, "min_height": c.min_height and c.min_height / 100}) for c in tuning.core_settings(adaptive)]
    core = rng.sample(core, 6)
    quality = tuning.ADAPTIVE_QUALITY if adaptive else tuning.LEGACY_QUALITY
    grid = tuning.grid_metrics(tuning.quality_cells(targets.join(tuning.picked_grid(traces, core), ["raw_id", "mz"]), quality, 2.0), quality, adaptive)
    got = {(r["core"]["order"], r["order"]): r.asDict() for r in grid.collect()}
    names, best = [c for c in grid.columns if c not in ("core", "order")], None
    for i, c in enumerate(core):
        judged = tuning.with_quality(tuning.reviewed_rows(targets, traces, c), quality)
        judged = tuning.rt_aware_metrics(judged, 2.0) if adaptive else tuning.two_class_metrics(judged)
        for r in judged.collect():
            assert {n: got[i, r.order][n] for n in names} == {n: r[n] for n in names}
            order = tuning.ADAPTIVE_ORDER if adaptive else tuning.LEGACY_ORDER
            last = (c.min_support_scans or 0) if adaptive else c.min_distance_scans
            key = (*[r[n] for n in order], -c.sg_window, -last, -i, -r.order)
            best = (key, (i, r.order)) if best is None or (key, (i, r.order)) > best else best
    assert len(got) == len(core) * (16 if adaptive else 48)
    first = tuning.best_setting(grid, adaptive).first()
    assert (first.core.order, first["order"]) == best[1]
