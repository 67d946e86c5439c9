"""Run registered queries beside their SQL twins: ``python tests/compare.py [sf] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([_plain(r[i]) for i in order] for r in rows)


def compare(spark, connection, query, sql, folder):
    """None when equal, else a description of the difference."""
    frame = query(spark, folder)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None, len(ours[1])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = canonical(names, result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}", len(ours[1])
    if ours[1] != theirs[1]:
        a, b = {tuple(r) for r in ours[1]}, {tuple(r) for r in theirs[1]}
        extra, missing = sorted(a - b)[:2], sorted(b - a)[:2]
        return f"{len(ours[1])} / {len(theirs[1])} rows, only ours {extra}, only SQL {missing}"[:1500], len(ours[1])
    return None, len(ours[1])


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(arguments: list[str]) -> int:
    import __spark_entry__ as contract

    folder = f"/root/testdata/sf{arguments[0] if arguments else '0.01'}"
    spark, connection = session(), connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in arguments[1:] or queries:
        start = time.time()
        try:
            problem, rows = compare(spark, connection, queries[name], oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD' if problem else 'ok '} {kind} {name} {rows} rows {time.time() - start:.1f}s", flush=True)
        if problem:
            print("    " + problem, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
