"""Compares registered queries with their SQL oracles: ``python tests/check_oracle.py [sf] [name …]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        return float(v) if isinstance(v, (int, float)) else v
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name, folder):
    t0 = time.time()
    got = entry.queries()[name](spark, folder).toPandas()
    t1 = time.time()
    want = con.execute(entry.oracle_sql()[name]).df()
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", t1 - t0, t2 - t1
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    if any(x != y for x, y in kinds.values()):
        return f"types {kinds}", t1 - t0, t2 - t1
    a, b = rows(got), rows(want)
    if a == b:
        return None, t1 - t0, t2 - t1
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} rows against {len(b)}; first difference {str(diff)[:700]}", t1 - t0, t2 - t1


if __name__ == "__main__":
    from lectern.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("oracle", spark__ui__showConsoleProgress="false")
    con = connect(folder)
    bad = 0
    for name in names:
        if name not in entry.oracle_sql():
            print(f"{name}: no oracle, {entry.queries()[name](spark, folder).count()} rows", flush=True)
            continue
        try:
            problem, ts, td = compare(spark, con, name, folder)
        except Exception as e:  # reported, not hidden: the run exits non-zero
            problem, ts, td = f"{type(e).__name__}: {str(e)[:900]}", 0, 0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} spark {ts:.1f}s duckdb {td:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    sys.exit(bad > 0)
