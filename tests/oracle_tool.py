"""Runs a registered query on Spark and its check query on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, text):
    result = con.execute(text)
    return table_of([d[0] for d in result.description], result.fetchall())


def difference(spark_side, duck_side):
    """NULL text where both are equal, else a short account of the first differences."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} != {duck_side[0]}"
    a, b = spark_side[1], duck_side[1]
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} vs {len(b)}; only spark {len(only_a)}: {only_a[:2]}; only duckdb {len(only_b)}: {only_b[:2]}"
