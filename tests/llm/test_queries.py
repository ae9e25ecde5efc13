"""Registered queries on the smallest tables, against their SQL or each other."""

from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def registered():
    from twinpeak.llm.registry import QUERIES

    return QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in registered().items() if sql])
def test_query_equals_sql(spark, con, name):
    fn, sql = registered()[name]
    df = fn(spark, SF)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registered()) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p
    import sentencepiece

    from twinpeak.llm import sentencepieces

    docs = p.documents(spark, SF)
    names, frames = [n for n, _ in p.STAGES], [docs]
    for _, stage in p.STAGES:
        frames.append(p.stored(stage(spark, frames[-1], SF)))
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "sentencepiece"]
    assert all(f.columns == docs.columns for f in frames[1:-1])
    passed, cut, single, mixed, tokens = frames[1:]
    judged = registered()["op7_quality_rules"][0](spark, SF).filter("kept").count()
    assert passed.count() == judged and 0 < cut.count() <= judged and single.count() <= cut.count()
    assert mixed.select("doc_id").distinct().count() <= single.count()
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in mixed.collect())
    back = {r.doc_id: r.text for r in sentencepieces.decode(tokens).collect()}
    assert back == {r.doc_id: r.text for r in mixed.collect()}
    assert sentencepiece.__name__ == "sentencepiece"
