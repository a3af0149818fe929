"""Compare every registered query with its SQL formulation.

``python -m verification.run [name part] [--sf 0.01]``
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from hearsay.session import local_session
from verification import QUERIES
from verification.core import RAW, Context, with_views


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark_rows, oracle_rows):
    (c1, r1), (c2, r2) = spark_rows, oracle_rows
    if c1 != c2:
        return f"columns differ: {c1} / {c2}"
    if len(r1) != len(r2):
        s1, s2 = set(map(repr, r1)), set(map(repr, r2))
        only = [x[:300] for x in sorted(s1 - s2)[:2] + sorted(s2 - s1)[:2]]
        return f"{len(r1)} rows / {len(r2)} rows; {str(only)[:1200]}"
    for a, b in zip(r1, r2):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(n, str(x)[:200], str(y)[:200]) for n, x, y in zip(c1, a, b) if x != y or type(x) is not type(y)]
            return f"values differ: {str(diff)[:1200]}"
    return None


def main(argv=None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("part", nargs="*", default=[])
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args(argv)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = oracle_connection(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if args.part and not any(name.startswith(p) for p in args.part):
            continue
        began = time.time()
        try:
            df = q.run(Context(spark, sf_dir))
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if q.sql is None:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            began = time.time()
            got = con.execute(with_views(q.sql))
            columns = [d[0] for d in got.description]
            problem = compare(table_of(df.columns, rows), table_of(columns, got.fetchall()))
            oracle_took = time.time() - began
        except Exception as error:  # noqa: BLE001
            problem, took, oracle_took, rows = f"{type(error).__name__}: {str(error)[:500]}", time.time() - began, 0, []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(rows)} rows {took:.1f}s / {oracle_took:.1f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
