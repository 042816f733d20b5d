"""Holds Spark's rows against DuckDB's over the same files. `python -m tests.compare DIR [NAME ...]` does so for all queries."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return connection


def value(x):
    """A cell in one form for both engines; doubles to nine digits."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def table(columns: list[str], rows) -> tuple[list[str], Counter]:
    """Names in order and the bag of rows."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(value(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What of df's columns or rows isn't as in the SQL's; empty if nothing."""
    got, want = table(df.columns, df.collect()), (lambda r: table([d[0] for d in r.description], r.fetchall()))(connection.execute(sql))
    if got[0] != want[0]:
        return f"columns {got[0]}, asked for {want[0]}"
    more, less = got[1] - want[1], want[1] - got[1]
    return f"{more.total()} rows too many, {less.total()} missing of {want[1].total()}: {list(more)[:2]}, {list(less)[:2]}" if more or less else ""


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = oracle(sf_dir), __spark_entry__.oracle_sql(), 0
    for name, query in __spark_entry__.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = difference(query(spark, sf_dir), connection, sql[name]) or "same" if name in sql else f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            said = f"failed: {str(e)[:1500]}"
        failed += not said.endswith(("same", "no SQL"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
