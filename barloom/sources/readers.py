"""Readers for bars, labels, predictions, future returns and datasets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSystem
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import to_date, to_number
from barloom.schema import ASOF, DATE, FILE, OPTIONAL_BAR_COLUMNS, ORDER, REQUIRED_BAR_COLUMNS, SYMBOL

BAR_COLUMNS = [*REQUIRED_BAR_COLUMNS, *OPTIONAL_BAR_COLUMNS]
KNOWN = [SYMBOL, FILE, ORDER, *BAR_COLUMNS]
UNLIKE = "CANNOT_MERGE_SCHEMAS"  # Spark's name for footers whose types disagree


def read_bars(spark: SparkSession, *paths: str) -> DataFrame:
    """Bars of the whole universe as one frame: symbol, date, doubles, source file and place in it.

    A path is a folder, glob or file of parquet. Files may differ in their columns and types, such as text,
    integer, date and nanosecond dates: each layout is one scan. The symbol is the `ts_code` column, or the file
    name where there is none. Optional columns may be missing from some files. Needed columns only are read, and
    filters on date and symbol column reach the scan. A table with an order column of its own keeps that.
    Nanosecond timestamps need `session.NANOS_AS_LONG` set, as `local_session` does.
    """
    parts = [_read_bar_files(spark, schema, files) for schema, files in _layouts(spark, paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _layouts(spark: SparkSession, paths: Sequence[str]) -> list[tuple[T.StructType, Sequence[str]]]:
    """Schemas, each with the paths that have it.

    Spark merges all footers in one job. Where their types disagree, the footers are read once more, by tasks,
    and the files grouped by what they hold; the driver gets names of files, which any scan lists there.
    """
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*paths).schema, paths)]
    except (PySparkException, Py4JJavaError) as e:
        if UNLIKE not in str(e):
            raise
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("uri"))
    found = files.mapInPandas(_footers, "file string, layout string").groupBy("layout").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [(spark.read.parquet(r["files"][0]).schema, r["files"]) for r in found.orderBy("layout").collect()]


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names and types of each file's bar columns, as one text."""
    for batch in batches:
        layouts = []
        for name in batch["uri"]:
            store, path = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", name))
            fields = pq.read_schema(path, filesystem=store)
            layouts.append(", ".join(sorted(f"{f.name} {f.type}" for f in fields if f.name in KNOWN)))
        yield pd.DataFrame({"file": batch["file"], "layout": layouts})


def _read_bar_files(spark: SparkSession, found: T.StructType, files: Sequence[str]) -> DataFrame:
    if DATE not in found.names:
        raise KeyError(f"bars are missing required column: {DATE}")
    wanted = [f for f in found if f.name in KNOWN]
    raw = spark.read.schema(T.StructType(wanted)).parquet(*files)
    symbol = (
        F.col(SYMBOL)
        if SYMBOL in found.names
        else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    )
    if ORDER in found.names:  # an order over the whole table, unless it names files too
        order, file = F.col(ORDER), F.col(FILE) if FILE in found.names else F.lit("")
    else:
        order, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    given = [f.name for f in wanted]
    numbers = [c for c in BAR_COLUMNS if c != DATE and (c in given or c in OPTIONAL_BAR_COLUMNS)]
    return raw.select(
        symbol.alias(SYMBOL),
        to_date(DATE, raw.schema[DATE].dataType).alias(DATE),
        *[(to_number(c) if c in given else F.lit(None).cast("double")).alias(c) for c in numbers],
        file.alias(FILE),
        order.alias(ORDER),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from CSV with a header: dates as dates, label and confidence as numbers.

    The text of the label stays in `label_text`, so that the label checks can tell a value
    that is no number from a missing one.
    """
    raw = spark.read.csv(path, header=True)
    out = raw
    date = ASOF if ASOF in raw.columns else DATE if DATE in raw.columns else None
    if date:
        out = out.withColumn(date, to_date(date, T.StringType()))
    if "label" in raw.columns:
        out = out.withColumns({"label_text": F.col("label"), "label": to_number("label")})
    if "confidence" in raw.columns:
        out = out.withColumn("confidence", to_number("confidence"))
    return out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from CSV: ids as text, scores and classes as numbers, dates as dates."""
    raw = spark.read.csv(path, header=True)
    changed = {c: to_number(c) for c in ("y_true", "y_score", "y_pred", "score") if c in raw.columns}
    if ASOF in raw.columns:
        changed[ASOF] = to_date(ASOF, T.StringType())
    return raw.withColumns(changed) if changed else raw


def read_future_returns(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    if "future_return" not in raw.columns:
        raise KeyError("future returns are missing required column: future_return")
    out = raw.withColumn("future_return", to_number("future_return"))
    return out.withColumn(ASOF, to_date(ASOF, T.StringType())) if ASOF in raw.columns else out


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset table; a filter on `split` prunes its folders."""
    return spark.read.parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
