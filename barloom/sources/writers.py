"""Writers for bars, datasets, predictions, reports and the experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import ASOF, DATE, EXPERIMENT_SUMMARY, SAMPLE, SYMBOL
from barloom.session import shuffles_deleted


def write_bars(bars: DataFrame, path: str, files: int | None = None) -> None:
    """A compacted copy of many small symbol files: few files, each sorted by symbol and date.

    Range partitioning splits a symbol with very many rows, and the sorted files let a filter
    on symbol or date skip row groups.
    """
    keys = [SYMBOL, DATE]
    spread = bars.repartitionByRange(files, *keys) if files else bars.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_dataset(samples: DataFrame, path: str) -> None:
    """The dataset by split. Check the skip limit before calling this; pass stored rows, as the exchange by split comes on top of theirs."""
    # rebalance gives few files per split and still cuts a large split into several
    with shuffles_deleted(samples.sparkSession):
        samples.hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    with shuffles_deleted(sequences.sparkSession):
        sequences.write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str, score: str = "score") -> None:
    """Predictions as CSV; those of a scan go into folders named by their as-of date, best score first in a file."""
    if ASOF in predictions.columns and "y_true" not in predictions.columns:
        spread = predictions.hint("rebalance", ASOF)
        if score in predictions.columns:
            spread = spread.sortWithinPartitions(ASOF, F.desc_nulls_last(score), SAMPLE)
        spread.write.mode("overwrite").option("header", True).partitionBy(ASOF).csv(path)
    else:
        predictions.write.mode("overwrite").option("header", True).csv(path)


def dated_path(path: str, asof: str | None) -> str:
    """Put the as-of date before the suffix of a path."""
    if not asof:
        return path
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    dated = f"{stem}_{asof}{dot}{suffix}" if dot and stem else f"{name}_{asof}"
    return f"{folder}/{dated}" if folder else dated


def json_ready(report: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, which is all that strict JSON has for them."""
    doubles = [f.name for f in report.schema if f.dataType.typeName() in ("double", "float")]
    infinite = float("inf")
    clean = {
        c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(infinite)), F.col(c)) for c in doubles
    }
    return report.withColumns(clean) if clean else report


def write_report(report: DataFrame, path: str) -> None:
    json_ready(report).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_experiment(row: DataFrame, path: str) -> None:
    """Append one row to the experiment table, in its fixed columns."""
    fields = [
        (F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EXPERIMENT_SUMMARY
    ]
    row.select(*fields).write.mode("append").parquet(path)
