import base64
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from twinpeak.operators import chromatograms as xic
from twinpeak.operators import dia
from twinpeak.params import ExtractionSettings
from twinpeak.plans import analyze, jobs
from twinpeak.sources import rawscans, tables

SCANS = "raw_id string, win double, scan int, rt double, iso_lo double, iso_hi double, peaks array<struct<mz:double,it:double>>"
TARGET = "row_id long, raw_id string, mz double, peak_a_rt double, peak_b_rt double"
FRAGMENTS = [(100.0 + 20 * k, 3000.0 + 1000 * k) for k in range(6)]


def two_peak_scans():
    """Zero, apex, zero around 60 s and 120 s; fragments rise with the precursor."""
    scans = []
    for centre, shift, gain in ((60.0, 0.0, 1.0), (120.0, 0.002, 1.5)):
        for rt, level in ((centre - 5, 0.0), (centre, 1.0), (centre + 5, 0.0)):
            peaks = [(m + shift, i * gain * level) for m, i in FRAGMENTS] + [(295.0, 9000.0 * gain * level)]
            scans.append((rt, [p for p in peaks if level]  or [(50.0, 1.0), (300.0, 1.0)]))
    return [("r", 300.0, n, rt, 292.0, 308.0, peaks) for n, (rt, peaks) in enumerate(scans)]


def run_of(spark, rows):
    return dia.run_from_scans(spark.createDataFrame(rows, SCANS))


def test_window_routing_prefers_the_nearest(spark):
    rows = [("r", c, 0, 1.0, lo, hi, [(50.0, 1.0)]) for c, lo, hi in ((100.0, 90.0, 110.0), (120.0, 109.0, 131.0))]
    run = run_of(spark, rows)
    targets = spark.createDataFrame([(1, "r", 109.5), (2, "r", 130.0), (3, "r", 140.0)], "row_id long, raw_id string, mz double")
    got = {r.row_id: [h.win for h in r.hits] for r in dia.route_targets(targets, run.windows).collect()}
    assert got == {1: [100.0, 120.0], 2: [120.0], 3: []}


def test_missing_bounds_fall_back_to_nominal_width(spark):
    run = run_of(spark, [("r", 100.0, 0, 1.0, None, 120.0, [(50.0, 1.0)])])
    targets = spark.createDataFrame([(1, "r", 107.0), (2, "r", 108.0)], "row_id long, raw_id string, mz double")
    got = {r.row_id: r.match_count for r in dia.route_targets(targets, run.windows, 15.0).collect()}
    assert got == {1: 1, 2: 0}


def test_full_analysis_of_a_supported_pair(spark):
    targets = spark.createDataFrame(
        [(1, "r", 295.0, 1.0, 2.0), (2, "r", 295.0, 1.0, None), (3, "r", 295.0, 1.0, 1.0),
         (4, "r", None, 1.0, 2.0), (5, "r", 400.0, 1.0, 2.0), (6, "r", 295.0, None, None)], TARGET,
    )
    out = analyze.analyze_pairs(targets, run_of(spark, two_peak_scans()), ExtractionSettings(rt_half_window_sec=8.0))
    rows = {r.row_id: r for r in out.collect()}
    r = rows[1]
    assert r.enantiomer_pair_status == "candidate_enantiomer_pair"
    assert r.ms2_matched_peaks == 6 and r.ms2_cosine == pytest.approx(1)
    assert (r.peak_a_quality_flags, r.peak_b_quality_flags) == ("ok", "ok")
    assert r.ms2_diagnostic_status == "supported_same_compound"
    assert r.ms2_review_priority == "P2_boundary_or_interference"
    assert r.peak_a_apex_rt == 60 and r.peak_b_apex_rt == 120
    assert rows[2].ms2_diagnostic_status == "not_attempted" and rows[2].chromatographic_status == "input_single_peak"
    assert rows[3].ms2_issue_codes == "IDENTICAL_RT_COORDINATES" and rows[3].rt_separation_sec == 0
    assert rows[4].ms2_issue_codes == "INVALID_PRECURSOR_MZ" and rows[4].rt_separation_sec is None
    assert rows[5].ms2_issue_codes == "NO_ACQUIRED_DIA_WINDOW"
    assert rows[5].peak_a_quality_flags == "no_matching_DIA_window"
    assert rows[6].chromatographic_status == "input_no_peak"


def one_window(spark, rows, targets, **kw):
    s = ExtractionSettings(**kw)
    t = spark.createDataFrame(targets, TARGET)
    return {(r.row_id, r.side): r for r in analyze.extract_window(t, run_of(spark, rows), s).collect()}


def ramp(mz_fragment):
    return [
        ("r", 300.0, n, float(n), None, None, [(mz_fragment, 5000.0 * f + 1.0), (295.002, 9000.0 * f + 1.0)])
        for n, f in enumerate((0.1, 1.0, 0.2))
    ]


def test_independent_precursor_and_fragment_tolerances(spark):
    # The precursor sits 6.8 ppm away, so a shared 3 ppm band misses it.
    targets = [(1, "r", 295.0, 1.0 / 60, 1000.0)]
    shared = one_window(spark, ramp(100.002), targets, mz_tol=3.0)
    split = one_window(
        spark, ramp(100.002), targets, mz_tol=3.0, precursor_eic_mz_tol=10.0, fragment_eic_mz_tol=3.0
    )
    assert shared[(1, "peak_a")].quality_flags in ("no_precursor_signal", "mz_out_of_range")
    got = split[(1, "peak_a")]
    assert [(round(p.mz, 6), p.it) for p in got.spectrum] == [(100.002, 5001.0)]
    assert split[(1, "peak_b")].quality_flags == "rt_window_out_of_range"


def test_consensus_scans_and_relative_filter(spark):
    rows = ramp(100.002)
    rows[2][6].append((150.0, 2500.0))
    targets = [(1, "r", 295.0, 1.0 / 60, 1000.0)]
    one = one_window(spark, rows, targets)[(1, "peak_a")]
    two = one_window(spark, rows, targets, consensus_scans=2)[(1, "peak_a")]
    assert (one.candidate_fragment_count, two.candidate_fragment_count) == (1, 2)
    assert (one.consensus_scan_count, two.consensus_scan_count) == (1, 2)


def test_many_targets_equal_a_brute_force_reading(spark):
    import random

    rng = random.Random(3)
    rows = []
    for n in range(30):
        level = max(0.0, 1 - abs(n - 12) / 4)
        peaks = [(100.0 + 7 * k, 4000.0 * level * (k + 1) + rng.random()) for k in range(8)] + [(295.0, 8000 * level)]
        rows.append(("r", 300.0, n, 2.0 * n, None, None, peaks))
    targets = [(k, "r", 295.0, (20 + k) / 60, 1000.0) for k in range(6)]
    got = one_window(spark, rows, targets)
    for k in range(6):
        lo, hi = max(0.0, 20 + k - 10), min(58.0, 20 + k + 10)
        inside = [r for r in rows if lo <= r[3] <= hi]
        x = [sum(i for m, i in r[6] if abs(m - 295.0) <= 0.00295) for r in inside]
        g = got[(k, "peak_a")]
        assert g.ms2_count == len(inside) and g.apex_intensity == max(x)
        area = sum((b[3] - a[3]) * (p + q) / 2 for a, b, p, q in zip(inside, inside[1:], x, x[1:]))
        assert g.area == pytest.approx(area)
        apex = inside[x.index(max(x))]
        kept = {}
        for m, _ in apex[6][:8]:
            y = [sum(i for mm, i in r[6] if abs(mm - m) <= m * 1e-5) for r in inside]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            num = sum((a - mx) * (b - my) for a, b in zip(x, y))
            den = (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
            if max(y) >= 2000 and den and num / den > 0.9:
                kept[round(m, 6)] = max(y)
        assert {round(p.mz, 6): pytest.approx(p.it) for p in g.spectrum} == kept


def test_active_support(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 2.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    row = df.select(
        xic.active_support_correlation(x, y, 0.05, 3, 1, 3), xic.active_support_correlation(x, x, 0.05, 3, 1, 3),
    ).first()
    assert row[0] is None and row[1] == pytest.approx(1.0)


def test_active_support_mode_in_the_plan(spark):
    got = one_window(
        spark, ramp(100.002), [(1, "r", 295.0, 1.0 / 60, 1000.0)], fragment_correlation_mode="active_support",
        min_correlation_scans=3,
    )
    assert len(got[(1, "peak_a")].spectrum) == 1


def test_older_layouts(spark):
    run = run_of(spark, two_peak_scans())
    one = spark.createDataFrame([(1, "r", 295.0, 1.0), (2, "r", 600.0, 1.0)], "row_id long, raw_id string, mz double, rt_min double")
    got = {r.row_id: r.MS2 for r in jobs.single_rt_fragments(one, run, 1e-5, 15.0).collect()}
    assert got[2] == "0" and got[1].startswith("100,3000;120,4000")
    both = jobs.global_window_fragments(one, run, (52.0, 68.0), (112.0, 128.0), 1e-5).collect()
    sides = {(r.row_id, r.side): len(r.spectrum) for r in both}
    assert sides[(1, "peak_a")] == sides[(1, "peak_b")] == 6 and sides[(2, "peak_a")] == 0


def payload(peaks, code=">d", squeeze=True):
    raw = b"".join(struct.pack(code, v) for p in peaks for v in p)
    return base64.b64encode(zlib.compress(raw) if squeeze else raw).decode()


def mzxml(scans):
    """Scan elements with each MS2 scan nested inside its MS1 scan."""
    out = ['<?xml version="1.0"?><mzXML><msRun><scanOrigin parentFileID="x" num="1"/>']
    for n, (rt, ms1, win, ms2) in enumerate(scans):
        out.append(f'<scan num="{2 * n + 1}" msLevel="1" retentionTime="PT{rt}S"><peaks precision="64" byteOrder="network" compressionType="zlib">{payload(ms1)}</peaks>')
        out.append(
            f'<scan num="{2 * n + 2}" msLevel="2" retentionTime="PT{rt}S"><precursorMz windowWideness="16.0" activationMethod="HCD" collisionEnergy="35.0">{win}</precursorMz>'
            f'<peaks precision="64" byteOrder="network" compressionType="zlib">{payload(ms2)}</peaks></scan></scan>'
        )
    return "".join(out) + "</msRun><index>scan text</index></mzXML>"


def mzml(scans):
    def array(values, kind):
        body = base64.b64encode(b"".join(struct.pack("<f", v) for v in values)).decode()
        return f'<binaryDataArray encodedLength="1"><cvParam cvRef="MS" accession="MS:1000521" name="f" value=""/><cvParam cvRef="MS" accession="{kind}" name="k" value=""/><binary>{body}</binary></binaryDataArray>'

    out = ["<mzML><run><spectrumList count='2'>"]
    for n, (level, minutes, win, peaks) in enumerate(scans):
        iso = "" if level == 1 else (
            f'<precursor><isolationWindow><cvParam cvRef="MS" accession="MS:1000827" name="t" value="{win}"/>'
            '<cvParam cvRef="MS" accession="MS:1000828" name="l" value="7.5"/><cvParam cvRef="MS" accession="MS:1000829" name="u" value="7.5"/></isolationWindow></precursor>'
        )
        out.append(
            f'<spectrum index="{n}" id="s{n}" defaultArrayLength="1"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="{level}"/>'
            f'<scanList><scan><cvParam cvRef="MS" accession="MS:1000016" name="t" value="{minutes}" unitAccession="UO:0000031"/></scan></scanList>{iso}'
            f'<binaryDataArrayList count="2">{array([p[0] for p in peaks], "MS:1000514")}{array([p[1] for p in peaks], "MS:1000515")}</binaryDataArrayList></spectrum>'
        )
    return "".join(out) + "</spectrumList></run></mzML>"


def test_mzxml_reader_finds_nested_scans(spark, tmp_path):
    path = str(tmp_path / "run_A01.mzXML")
    with open(path, "w") as f:
        f.write(mzxml([(62.5, [(100.25, 1234.5), (200.5, 6789.0)], 403.0, [(90.0, 2.0), (80.0, 1.0)])]))
    rows = rawscans.read_raw(spark, [path]).orderBy("scan_no").collect()
    assert [(r.ms_level, r.rt, r.raw_id) for r in rows] == [(1, 62.5, "run_A01"), (2, 62.5, "run_A01")]
    assert [(p.mz, p.it) for p in rows[0].peaks] == [(100.25, 1234.5), (200.5, 6789.0)]
    assert (rows[1].win, rows[1].iso_lo, rows[1].iso_hi) == (403.0, 395.0, 411.0)
    assert [p.mz for p in rows[1].peaks] == [80.0, 90.0]
    seen = {(r.key, r.value): r.rows for r in rawscans.acquisition_attributes(spark, [path]).collect()}
    assert seen[("msLevel", "1")] == 1 and seen[("collisionEnergy", "35.0")] == 1


def test_mzml_reader(spark, tmp_path):
    path = str(tmp_path / "b.mzML")
    with open(path, "w") as f:
        f.write(mzml([(1, 0.5, None, [(100.0, 5.0)]), (2, 1.0, 403.0, [(90.0, 2.0), (95.0, 3.0)])]))
    rows = rawscans.read_raw(spark, [path]).orderBy("scan_no").collect()
    assert [(r.ms_level, r.rt, r.win) for r in rows] == [(1, 30.0, None), (2, 60.0, 403.0)]
    assert (rows[1].iso_lo, rows[1].iso_hi) == (395.5, 410.5)
    assert [(p.mz, p.it) for p in rows[1].peaks] == [(90.0, 2.0), (95.0, 3.0)]


def test_bad_payload_fails_or_is_recorded(spark, tmp_path):
    path = str(tmp_path / "bad.mzXML")
    with open(path, "w") as f:
        f.write('<mzXML><scan num="1" msLevel="1" retentionTime="PT1S"><peaks precision="32" compressionType="lzma">QUJD</peaks></scan></mzXML>')
    rows = rawscans.read_raw(spark, [path], on_error="record").collect()
    assert "unsupported peak compression" in rows[0].error
    with pytest.raises(Exception, match="unsupported peak compression"):
        rawscans.read_raw(spark, [path]).collect()


def write_case(tmp_path, name="run_A01"):
    scans = []
    for row in two_peak_scans():
        rt = row[3]
        scans.append((rt, [(295.0, 2e5 if rt in (60.0, 120.0) else 1.0)], 300.0, row[6]))
    raw = str(tmp_path / f"{name}.mzXML")
    with open(raw, "w") as f:
        f.write(mzxml(scans))
    table = str(tmp_path / f"{name}.csv")
    with open(table, "w", encoding="utf-8-sig") as f:
        f.write("Compound_ID,MZ,Peak1,Peak2,Orginal Pooled Well\nA,295,1,2,a01\n,,,,\nB,600,1,,a01\n")
    return raw, table


def test_files_end_to_end(spark, tmp_path):
    raw, table = write_case(tmp_path)
    read = tables.read_table(spark, table)
    assert read.count() == 2 and read.columns[0] == "Compound_ID"
    out = str(tmp_path / "result")
    side = jobs.analyze_files(spark, table, [raw], out, ExtractionSettings(rt_half_window_sec=8.0))
    assert side["status_counts"] == {"candidate_enantiomer_pair": 1, "not_evaluated": 1}
    assert side["windows"]["with_raw_bounds"] == 1
    assert side["raw"]["scan_counts"] == {"ms1": 6, "ms2": 6}
    assert len(side["inputs"]) == 2 and os.path.exists(out + ".metadata.json")
    rows = {r["Compound_ID"]: r for r in tables.read_table(spark, out).collect()}
    assert rows["A"]["ms2_matched_peaks"] == "6" and rows["A"]["peak_a_MS2"].startswith("100,3000;")
    assert rows["B"]["peak_a_MS2"] == ""


def test_batch_isolates_failures_and_resumes(spark, tmp_path):
    raw, table = write_case(tmp_path)
    bad = str(tmp_path / "run_B02.mzXML")
    with open(bad, "w") as f:
        f.write('<mzXML><scan num="1" msLevel="2" retentionTime="PT1S"><precursorMz>300</precursorMz><peaks precision="16">QUJD</peaks></scan></mzXML>')
    job = {"mode": "ms2", "peaklist": table}
    manifest = [
        {**job, "sample_id": "good", "raw": raw, "output": str(tmp_path / "o1")},
        {**job, "sample_id": "bad", "raw": bad, "output": str(tmp_path / "o2")},
        {**job, "sample_id": "gone", "raw": str(tmp_path / "none.mzML"), "output": str(tmp_path / "o3")},
        {**job, "sample_id": "full", "mode": "full", "raw": raw, "output": str(tmp_path / "o4")},
    ]
    first = jobs.run_batch(spark, manifest)
    assert [r["status"] for r in first] == ["completed", "failed", "failed", "completed"]
    assert first[0]["row_count"] == 2 and "precision" in first[1]["error"]
    again = jobs.run_batch(spark, manifest)
    assert [r["status"] for r in again] == ["skipped_existing", "failed", "failed", "skipped_existing"]


def test_manifest_preparation_needs_a_unique_raw_file(spark, tmp_path):
    raw, table = write_case(tmp_path)
    rows, manifest = jobs.prepare_manifest(spark, table, str(tmp_path))
    assert [(r.sample_id, os.path.basename(r.raw)) for r in manifest.collect()] == [("A01", "run_A01.mzXML")]
    with open(str(tmp_path / "other_a01.mzML"), "w") as f:
        f.write("<mzML/>")
    with pytest.raises(Exception, match="exactly one raw file"):
        jobs.prepare_manifest(spark, table, str(tmp_path))[1].collect()


def test_sweep_variants_are_distinct():
    variants = jobs.sweep_settings()
    assert len(variants) == len({repr(v[2]) for v in variants}) == 19


def test_start_tags_may_end_in_any_white_space(spark, tmp_path):
    """Newlines and tabs after the tag name, nested scans, and longer names are all told apart."""
    peaks = '<peaks precision="32" byteOrder="network">Q5YAAEPIAAA=</peaks>'
    text = (
        f'<mzXML><scan num="1" msLevel="1" retentionTime="PT1S">{peaks}'
        f'<scan\n num="2" msLevel="2" retentionTime="PT2S"><precursorMz>300</precursorMz>{peaks}</scan></scan>\n'
        f'<scan\tnum="3" msLevel="2" retentionTime="PT3S"><scanOrigin parentFileID="x"/><precursorMz>310</precursorMz>{peaks}</scan></mzXML>'
    )
    path = tmp_path / "tags.mzXML"
    path.write_text(text)
    found = {r.scan_no: (r.ms_level, r.win) for r in rawscans.read_raw(spark, [str(path)]).collect()}
    assert found == {1: (1, None), 2: (2, 300.0), 3: (2, 310.0)}


def test_rows_are_numbered_densely_over_many_files(spark, tmp_path):
    for i in range(130):
        (tmp_path / f"part-{i:03}.csv").write_text(f"Compound_ID,MZ\nc{i},1\nd{i},2\n")
    rows = tables.read_table(spark, str(tmp_path)).collect()
    assert sorted(r.row_no for r in rows) == list(range(260))


def test_two_raw_files_give_labelled_ordered_rows(spark, tmp_path):
    first, table = write_case(tmp_path)
    second, _ = write_case(tmp_path, "run_B01")
    out = str(tmp_path / "both")
    jobs.analyze_files(spark, table, [first, second], out, ExtractionSettings(rt_half_window_sec=8.0))
    rows = tables.read_table(spark, out).orderBy("row_no").collect()
    assert [(r["raw_file"], r["Compound_ID"]) for r in rows] == [("run_A01", "A"), ("run_A01", "B"), ("run_B01", "A"), ("run_B01", "B")]


def test_patterns_are_read_once_and_scans_numbered_in_many_tasks(spark):
    """The reader's filter holds no pattern, and places run on over the parts of one raw file."""
    spectrum = "<scan num='{0}' msLevel='{1}' retentionTime='PT{0}S'><precursorMz>300</precursorMz><peaks precision='32'></peaks></scan>"
    texts = [("r", spectrum.format(n, 1 + n % 2)) for n in range(40)] + [("q", spectrum.format(7, 1))]
    scans = rawscans.mzxml_scans(spark.createDataFrame(texts, "raw_id string, value string"))
    plan = scans._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
    first = rawscans.ms1_scans(scans)
    window = first._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in window
    assert sorted((r.raw_id, r.scan_no, r.scan) for r in first.collect()) == [("q", 7, 0)] + [("r", 2 * n, n) for n in range(20)]
    second = rawscans.ms2_scans(scans)
    assert sorted((r.scan_no, r.scan) for r in second.collect()) == [(2 * n + 1, n) for n in range(20)]


def test_sweep_analyses_equal_targets_once(spark, monkeypatch):
    """Targets of equal m/z and times are one analysed row, counted as often as they come."""
    run = run_of(spark, two_peak_scans())
    targets = spark.createDataFrame([(n, "r", 300.0 - 5 * (n % 2), 1.0, 2.0) for n in range(10)], TARGET)
    seen, plain = [], analyze.routed_sides
    monkeypatch.setattr(analyze, "routed_sides", lambda t, *a: seen.append(t.count()) or plain(t, *a))
    rows = jobs.sensitivity_sweep(targets, run, jobs.sweep_settings()[:2]).collect()
    assert set(seen) == {2}
    totals = {}
    for r in rows:
        totals[r.varied_value] = totals.get(r.varied_value, 0) + r.rows
    assert set(totals.values()) == {10}
