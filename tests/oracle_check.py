"""Runs named queries in Spark and their SQL in DuckDB and compares the results."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as E  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


FAMILIES = {"bigint": "int", "int": "int", "integer": "int", "double": "double", "string": "text",
            "varchar": "text", "boolean": "boolean", "timestamp_ntz": "ts", "timestamp": "ts"}


def compare(spark, con, name, sf_dir):
    """None if equal, else a description of the difference."""
    df = E.queries()[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(E.oracle_sql()[name])
    kinds = {d[0]: str(d[1]).lower() for d in rel.description}
    want_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}"
    for column, kind in df.dtypes:
        if (kind, kinds[column]) not in {("bigint", "bigint"), ("int", "integer")} and \
                FAMILIES.get(kind, kind) != FAMILIES.get(kinds[column], kinds[column]) or \
                {kind, kinds[column]} in ({"int", "bigint"}, {"bigint", "integer"}):
            return f"type of {column}: {kind} vs {kinds[column]}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(sf_dir, names):
    from newsgraph.session import get_session

    if os.environ.get("PLAIN_SESSION"):  # nothing set that a caller might not set
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8",
                            spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or E.queries():
        start = time.time()
        try:
            if name in E.oracle_sql():
                result = compare(spark, con, name, sf_dir) or "ok"
            else:
                result = f"ok (no SQL) {E.queries()[name](spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        failed += not result.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s  {result[:900]}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
