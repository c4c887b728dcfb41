"""Window sequences: for each sample the last W bars as a W x k array."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import to_number
from barloom.functions.frames import by_date
from barloom.schema import DATE, SAMPLE, SYMBOL

SEQUENCE_COLUMNS = ["open", "high", "low", "close", "vol"]


def _filled(values: Column) -> Column:
    """Fill gaps forward, then backward, then with 0, inside the array only.

    `coalesce` looks for a neighbour only where a value is missing.
    """

    def fill(x: Column, i: Column) -> Column:
        earlier = F.filter(F.slice(values, F.lit(1), i), lambda v: v.isNotNull())
        later = F.filter(F.slice(values, i + 1, F.size(values)), lambda v: v.isNotNull())
        return F.coalesce(x, F.try_element_at(earlier, F.lit(-1)), F.try_element_at(later, F.lit(1)), F.lit(0.0).cast("float"))

    return F.transform(values, fill)


def _column(matrix: Column, k: int) -> Column:
    return F.transform(matrix, lambda r: r[k])


def window_sequences(
    samples: DataFrame, bars: DataFrame, window_size: int = 120, columns: Sequence[str] = SEQUENCE_COLUMNS
) -> DataFrame:
    """(sample_id, ts_code, rn, x_sequence) for samples with `rn`, the row number of their as-of bar.

    Bars are packed once into tiles of W rows, each with the tile before it, in which every window of its
    rows lies. A sample meets one such pair and cuts its window out on the spot: windows, which overlap,
    are never exchanged, and no group is larger than W rows.
    """
    used = [c for c in columns if c in bars.columns]
    if not used:
        raise ValueError("no sequence column found in the bars")
    # a bar is one row of the matrix from here on, with a mark where a value is missing
    values = [to_number(c).cast("float") for c in used]
    numbered = bars.select(SYMBOL, DATE, F.array(*values).alias("_x"), reduce(or_, [v.isNull() for v in values]).alias("_gap")).withColumn(
        "_rn", F.row_number().over(by_date()) - 1
    )
    tiles = (
        numbered.groupBy(SYMBOL, F.floor(F.col("_rn") / window_size).alias("_tile"))
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_x"))).alias("_rows"), F.max("_gap").alias("_gap"))
        .select(SYMBOL, "_tile", F.col("_rows._x").alias("_rows"), F.col("_rows")[0]["_rn"].alias("_first"), "_gap")
    )
    by_tile = Window.partitionBy(SYMBOL).orderBy("_tile")
    before = F.coalesce(F.lag("_rows").over(by_tile), F.array().cast(tiles.schema["_rows"].dataType))
    pairs = tiles.select(
        SYMBOL, "_tile", F.concat(before, "_rows").alias("_rows"), (F.col("_first") - F.size(before)).alias("_first"),
        (F.col("_gap") | F.coalesce(F.lag("_gap").over(by_tile), F.lit(False))).alias("_gap"),
    )
    last = F.col("rn") - 1
    wanted = samples.select(SAMPLE, SYMBOL, last.alias("_last")).distinct().withColumn(
        "_tile", F.floor(F.col("_last") / window_size)
    )
    # rows are numbered without gaps, so a window starts at a known place of its pair
    start = F.col("_last") - window_size + 1 - F.col("_first")
    fetched = wanted.join(pairs, [SYMBOL, "_tile"]).where((start >= 0) & (start + window_size <= F.size("_rows")))
    whole = F.slice("_rows", start.cast("int") + 1, window_size)
    # only pairs with a gap are filled; the other windows are cut as they are
    series = [_filled(_column(whole, k)) for k in range(len(used))]
    filled = F.transform(F.arrays_zip(*series), lambda r: F.array(*[r[str(k)] for k in range(len(used))]))
    return fetched.select(SAMPLE, SYMBOL, (F.col("_last") + 1).alias("rn"), F.when(F.col("_gap"), filled).otherwise(whole).alias("x_sequence"))
