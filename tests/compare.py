"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def compare(spark, con, plan, sql, sf_dir):
    """Difference text, or None when both sides hold the same rows."""
    df = plan(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows", len(got)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = _rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a}\n  sql   {b}\n  cols {sorted(names)}", len(got)
    return None, len(got)


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if args[1:] and not any(part in name for part in args[1:]):
            continue
        start = time.time()
        try:
            diff, n = compare(spark, con, plan, sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            diff, n = f"{type(error).__name__}: {str(error)[:600]}", 0
        state = "ok " if diff is None else "BAD"
        bad += diff is not None
        print(f"{state} {name:34s} {n:8d} rows {time.time() - start:6.2f}s"
              f"{'' if name in sql else '  (rows only)'}", flush=True)
        if diff:
            print("  " + diff, flush=True)
        if diff is None and n == 0:
            print("  note: empty result", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
