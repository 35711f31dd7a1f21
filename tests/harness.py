"""Side-by-side check of the registered queries against their SQL on the given tables."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from queries.lifts import TABLES  # noqa: E402

TESTDATA = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}".rstrip("0").rstrip(".") if v != 0 else "0"
    if hasattr(v, "quantize"):
        return _norm(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), sorted(columns)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([c[0] for c in cur.description], cur.fetchall())


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, cols = spark_rows(df)
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)}", took
    t0 = time.time()
    want, wcols = duck_rows(con, sql)
    dtook = time.time() - t0
    if cols != wcols:
        return f"COLUMNS {cols} vs {wcols}", took
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return f"DIFF {len(got)} vs {len(want)}\n   cols {cols}\n   spark {extra}\n   duck  {lack}", took
    return f"ok {len(got)}" + (f" (duck {dtook:.1f}s)" if dtook > 5 else ""), took


def main(argv):
    from wirepost.plans.session import build
    import __spark_entry__ as entry
    sf = argv[0] if argv else "0.01"
    only = argv[1:]
    spark = build(os.environ.get("HARNESS_MASTER", "local[8]"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            verdict, took = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            verdict, took = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{took:6.1f}s {name}: {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
