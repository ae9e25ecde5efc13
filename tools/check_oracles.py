"""Run registered queries against DuckDB on the same parquet files.

usage: python tools/check_oracles.py SF_DIR [name …]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinpeak.session import build_session  # noqa: E402
from twinpeak.workload import registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float) and math.isnan(v):
                v = "nan"
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                v = repr(float(v) + 0.0)
            cells.append(str(v))
        out.append(tuple(cells))
    return [columns[i] for i in order], sorted(out)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracles",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
        except Exception as exc:  # noqa: BLE001
            print(f"ERROR {name}: {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows  {name}: {len(got[1])} spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            want = canonical(cur.fetchall(), [c[0] for c in cur.description])
        except Exception as exc:  # noqa: BLE001
            print(f"ORACLE-ERROR {name}: {str(exc)[:900]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time()
        same = got == want
        print(
            f"{'ok   ' if same else 'DIFF '} {name}: {len(got[1])} vs {len(want[1])} rows, "
            f"spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s",
            flush=True,
        )
        if not same:
            bad.append(name)
            print("   columns", got[0], want[0] if got[0] != want[0] else "")
            a, b = set(got[1]), set(want[1])
            for label, rows in (("spark", sorted(a - b)), ("duckdb", sorted(b - a))):
                print(f"   only {label}: {len(rows)}")
                for row in rows[:3]:
                    print("     ", row)
    print("failed:", bad)


if __name__ == "__main__":
    main()
