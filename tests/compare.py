"""Run registered queries against their SQL: ``python tests/compare.py [sf] [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.1e-6)
    return a == b


def normal(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, round(float(v), 4))
    return (3, str(v))


def compare(got, got_columns, want, want_columns):
    """None if equal up to order, else what differs."""
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    pick_a = [got_columns.index(c) for c in sorted(got_columns)]
    pick_b = [want_columns.index(c) for c in sorted(want_columns)]
    a = sorted(([r[i] for i in pick_a] for r in got), key=lambda r: [normal(v) for v in r])
    b = sorted(([r[i] for i in pick_b] for r in want), key=lambda r: [normal(v) for v in r])
    for x, y in zip(a, b):
        if not all(same(p, q) for p, q in zip(x, y)):
            return f"{sorted(got_columns)}: {x} != {y}"
    return None


def check(spark, con, folder, name):
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    middle = time.time()
    sql = con.execute(entry.oracle_sql()[name])
    want_columns = [d[0] for d in sql.description]
    difference = compare(rows, df.columns, sql.fetchall(), want_columns)
    return difference, len(rows), middle - start, time.time() - middle


if __name__ == "__main__":
    from ledgerloom import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        try:
            difference, n, t_spark, t_sql = check(spark, con, folder, name)
            print(f"{'ok  ' if difference is None else 'DIFF'} {name:32} {n:8} rows {t_spark:6.2f}s sql {t_sql:6.2f}s {difference or ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name:32} {str(error)[:1500]}", flush=True)
    spark.stop()
