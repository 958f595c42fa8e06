"""Compare registered queries with their SQL: ``python -m checks.compare [sf_dir] [query ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f + 0.0:.5f}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, statement) -> str | None:
    rows = [tuple(r) for r in spark_df.collect()]
    found = con.execute(statement)
    names, other = [d[0] for d in found.description], found.fetchall()
    a, b = table(spark_df.columns, rows), table(names, other)
    if a[0] != b[0]:
        return f"columns {a[0]} <> {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} <> {len(b[1])}"
    if a[1] != b[1]:
        pairs = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
        x, y = pairs[0]
        cells = [(n, p, q) for n, p, q in zip(a[0], x, y) if p != q]
        return f"{len(pairs)} rows differ, first: {cells[:4]} in {x[:3]}"
    return None


def main(args: list[str]) -> int:
    from vigilframe.catalog import QUERIES
    from vigilframe.session import build_session

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, con, ORACLE[name]) if name in ORACLE else f"no SQL, {len(df.collect())} rows"
        except Exception as e:  # report and go on
            problem = f"FAILED {str(e)[:500]}"
        ok = problem is None or problem.startswith("no SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
