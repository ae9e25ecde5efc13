import json
import os

import pytest
from test_analyze import write_case

from twinpeak import cli, sinks
from twinpeak.sources import tables
from twinpeak.workload import registry


def test_commands_end_to_end(spark, tmp_path):
    raw, table = write_case(tmp_path)
    out = str(tmp_path / "result")
    side = cli.main(
        ["analyze", "--peaklist", table, "--raw", raw, "--output", out, "--rt-half-window-sec", "8"], spark
    )
    assert side["parameters"]["rt_half_window_sec"] == 8.0
    same = cli.main(["compare", "--baseline", out, "--candidate", out, "--output", str(tmp_path / "cmp")], spark)
    assert (same["matched_rows"], same["queued_rows"]) == (2, 0)
    report = str(tmp_path / "report")
    cli.main(["report", "--input", out, "--output", report], spark)
    assert os.path.exists(os.path.join(report, "report.html"))
    assert tables.read_table(spark, os.path.join(report, "review_queue")).count() == 1
    gallery = os.path.join(report, "gallery", "ms2_review_priority=P2_boundary_or_interference")
    assert "<svg" in spark.read.text(gallery).first().value
    review = str(tmp_path / "review")
    cli.main(["export-review", "--input", out, "--output", review, "--sidecar", out + ".metadata.json"], spark)
    views = {r["view"] for r in tables.read_table(spark, os.path.join(review, "view_index")).collect()}
    assert "diagnostic_status/supported_same_compound" in views
    assert "acquisition_coverage/within_acquired_window" in views
    picked = cli.main(["ms1-pick", "--peaklist", table, "--raw", raw, "--output", str(tmp_path / "ms1")], spark)
    assert picked["rows"] == 2
    # The frozen source contract refuses an 8 s extraction.
    with pytest.raises(ValueError):
        cli.main(["apply-shadow", "--input", out, "--output", str(tmp_path / "x"), "--source-sidecar", out + ".metadata.json"], spark)


def test_shadow_commands(spark, tmp_path):
    raw, table = write_case(tmp_path)
    out, applied = str(tmp_path / "result"), str(tmp_path / "applied")
    cli.main(["analyze", "--peaklist", table, "--raw", raw, "--output", out], spark)
    cli.main(["apply-shadow", "--input", out, "--output", applied, "--source-sidecar", out + ".metadata.json"], spark)
    counts = cli.main(["shadow-review", "--input", applied, "--output", str(tmp_path / "rev")], spark)["transition_counts"]
    assert sum(counts.values()) == 2


def test_archive_is_reproducible(tmp_path):
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "b.txt").write_text("b")
    (folder / "a.txt").write_text("a")
    one, two = str(tmp_path / "1.zip"), str(tmp_path / "2.zip")
    assert sinks.package_directory(str(folder), one)["entries"] == 2
    sinks.package_directory(str(folder), two)
    with open(one, "rb") as a, open(two, "rb") as b:
        assert a.read() == b.read()


def test_registry_and_plan_shape(spark):
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70
    plan = queries["sum_eic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    json.dumps(sorted(queries))
