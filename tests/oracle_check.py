"""Compare registered queries with their DuckDB text.

Usage: python tests/oracle_check.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("FAULTLINE_TESTDATA", "/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark, con, name, run, sql, sf):
    df = run(spark, f"{DATA}/{sf}")
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), f"values {got_cols}: {a} vs {b}"
    return len(got), ""


def main() -> None:
    from faultline.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    texts, bad = oracle_sql(), 0
    for name, run in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in texts:
                n, problem = differences(spark, con, name, run, texts[name], sf)
            else:
                n, problem = run(spark, f"{DATA}/{sf}").count(), ""
        except Exception as error:  # report and go on
            n, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        note = "" if name in texts else " (rows only)"
        print(f"{'BAD ' if problem else 'ok  '} {name:34s} rows={n:<7d} {time.time() - start:5.1f}s{note} {problem}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
