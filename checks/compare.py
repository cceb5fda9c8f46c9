"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Empty when row counts, column names and all values agree exactly, else what differs."""
    start = time.time()
    df = queries()[name](spark, sf_dir)
    ours = _sorted_rows(df.collect(), df.columns)
    spent = time.time() - start
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = _sorted_rows(result.fetchall(), columns)
    con.close()
    print(f"{name}: {len(ours)} rows, {spent:.1f} s", flush=True)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if differing:
        return f"{len(differing)} rows differ, e.g. {differing[0]}"
    kinds = {
        (type(x).__name__, type(y).__name__)
        for a, b in zip(ours, theirs)
        for x, y in zip(a, b)
        if x is not None and type(x) is not type(y)
    }
    return f"types {kinds}" if kinds else ""


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = str(Path("/root/testdata") / sf)
    spark = session()
    wrong = 0
    for name in args or queries():
        try:
            problem = compare(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            wrong += 1
            print(f"  WRONG {name}: {problem[:1500]}", flush=True)
    print(f"{wrong} wrong", flush=True)
    return min(wrong, 1)


if __name__ == "__main__":
    sys.exit(main())
