"""Run registered queries and their SQL twins side by side.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None if both agree, else what differs."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    loose = {"bigint": {"bigint", "number"}, "double": {"double", "number"}, "string": {"varchar", "string"}}
    for c, t in df.dtypes:
        if types[c] not in loose.get(t, {t, "bool" if t == "boolean" else t}):
            return f"type of {c}: {t} != {types[c]}"
    a, b = _bag(df.columns, rows), _bag(names, expected)
    if a != b:
        return f"{len(rows)} vs {len(expected)} rows; extra {list((a - b))[:3]}; missing {list((b - a))[:3]}"
    if not rows:
        return "no rows on either side"
    return None


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="a session without any settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    builder = SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false")
    if not args.plain:
        builder = (
            builder.config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {kind:4s} {name:32s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(args.names or queries)} differ")


if __name__ == "__main__":
    main()
