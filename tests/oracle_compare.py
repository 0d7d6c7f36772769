"""Run registered queries on Spark and their SQL on DuckDB and compare rows exactly.

Usage: python tests/oracle_compare.py [sf dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'").fetchall()
    return con


def cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.12g}")
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(cell, value))
    return str(value)


def kind(value):
    return "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None) -> str:
    start = time.time()
    df = run(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return f"rows-only {len(rows):>7} rows {seconds:6.2f}s"
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    names = [df.columns[i] for i in order]
    relation = con.execute(sql)
    other_names = [d[0] for d in relation.description]
    other = relation.fetchall()
    other_order = sorted(range(len(other_names)), key=lambda i: other_names[i])
    if names != [other_names[i] for i in other_order]:
        return f"FAIL columns {names} vs {sorted(other_names)}"
    mine = Counter(tuple(cell(r[i]) for i in order) for r in rows)
    theirs = Counter(tuple(cell(r[i]) for i in other_order) for r in other)
    if mine != theirs:
        return (f"FAIL {len(rows)} vs {len(other)} rows {names}\n   spark {list((mine - theirs).items())[:3]}"
                f"\n   sql   {list((theirs - mine).items())[:3]}")
    kinds = []
    for i, n in zip(order, names):
        a = {kind(r[i]) for r in rows} - {"NoneType"}
        b = {kind(r[other_order[names.index(n)]]) for r in other} - {"NoneType"}
        if a != b:
            kinds.append(f"{n}: {a} vs {b}")
    note = f" TYPES {'; '.join(kinds)}" if kinds else ""
    return f"{'ok' if rows else 'EMPTY'} {len(rows):>7} rows {seconds:6.2f}s{note}"


def main(argv: list[str]) -> int:
    from hearthline.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("oracle-compare")
    con = connect(sf_dir)
    wanted = argv[1:]
    oracle, failed = oracle_sql(), []
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            result = compare(spark, con, sf_dir, name, run, oracle.get(name))
        except Exception as error:  # noqa: BLE001
            con = connect(sf_dir)
            result = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        if result.startswith(("FAIL", "EMPTY")):
            failed.append(name)
        print(f"{name:32s} {result}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
