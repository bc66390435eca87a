"""Compare registered queries with their SQL twins: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return [columns[at] for at in order], sorted(tuple(plain(row[at]) for at in order) for row in rows)


def compare(spark, sf_dir: str, name: str, connection=None) -> str:
    from __spark_entry__ import oracle_sql, queries

    frame = queries()[name](spark, sf_dir)
    columns, rows = table_of(frame.columns, [tuple(row) for row in frame.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(rows)}"
    connection = connection or connect(sf_dir)
    result = connection.execute(sql)
    want_columns, want = table_of([item[0] for item in result.description], result.fetchall())
    if columns != want_columns:
        return f"MISMATCH columns {columns} != {want_columns}"
    if rows != want:
        only_left = [row for row in rows if row not in set(want)][:3]
        only_right = [row for row in want if row not in set(rows)][:3]
        return f"MISMATCH rows {len(rows)} vs {len(want)}\n   spark {only_left}\n   sql   {only_right}"
    return f"ok {len(rows)}"


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from __spark_entry__ import queries

    connection = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or list(queries()):
        started = time.time()
        try:
            outcome = compare(spark, sf_dir, name, connection)
        except Exception as error:  # noqa: BLE001
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += not (outcome.startswith("ok") or outcome.startswith("rows only"))
        print(f"{name:28s} {time.time() - started:6.2f}s  {outcome}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
