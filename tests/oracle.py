"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return f"{v:.1f}"
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf, name, fn, sql, con):
    t0 = time.time()
    df = fn(spark, sf)
    cols, got = df.columns, [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL", spent
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} vs {sorted(want_cols)}", spent
    a, b = rows_of(cols, got), rows_of(want_cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}; cols {sorted(cols)}", spent
    return len(got) > 0, f"{len(got)} rows", spent


def main():
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tessella.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            ok, text, spent = compare(spark, sf, name, fn, sqls.get(name), con)
        except Exception as e:
            ok, text, spent = False, f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}s {text}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
