"""Run queries on Spark and their reference SQL on DuckDB and compare the rows.

``python tests/compare.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(r[i] for i in order) for r in found.fetchall())


def types(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString().upper() for f in df.schema}


_SPARK_TYPE = {"VARCHAR": "STRING", "INTEGER": "INT"}


def duck_types(con, sql: str) -> dict[str, str]:
    rows = con.execute(f"DESCRIBE {sql}").fetchall()
    return {r[0]: _SPARK_TYPE.get(r[1], r[1]) for r in rows}


def difference(df, con, sql: str) -> str:
    """Empty when schema and rows agree, else what differs."""
    names, ours = spark_rows(df)
    duck_names, theirs = duck_rows(con, sql)
    if names != duck_names:
        return f"columns {names} / {duck_names}"
    if types(df) != duck_types(con, sql):
        return f"types {types(df)} / {duck_types(con, sql)}"
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        return (
            f"{ours.total()} / {theirs.total()} rows, {extra.total()} only ours, {lacking.total()} only theirs: "
            f"{[str(r)[:300] for r in list(extra)[:2]]} / {[str(r)[:300] for r in list(lacking)[:2]]}"
        )
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in names:
        start = time.time()
        df = entry.queries()[name](spark, sf_dir)
        rows = df.count()
        spent = time.time() - start
        wrong = difference(df, con, entry.oracle_sql()[name])
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name:34s} {rows:8d} rows {spent:6.2f} s {wrong}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
