"""Window specifications per symbol. Normalised bars have one row per symbol and day, so
none of these partitions is larger than the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.schema import DATE, SYMBOL


def by_symbol() -> WindowSpec:
    return Window.partitionBy(SYMBOL)


def by_date() -> WindowSpec:
    return by_symbol().orderBy(DATE)


def newest_first() -> WindowSpec:
    return by_symbol().orderBy(F.desc(DATE))


def up_to_now() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int) -> WindowSpec:
    return by_date().rowsBetween(1 - n, 0)


def newest_rows(bars: DataFrame, rows: int) -> DataFrame:
    """The last rows of each symbol, with their age `_age` (0 is the latest) and its bar count `_bars`.

    The bare comparison of the row number lets Spark cut each symbol to its last rows before the exchange;
    the count comes from partial sums. So whole histories are read but not moved.
    """
    newest = bars.withColumn("_place", F.row_number().over(newest_first())).where(F.col("_place") <= rows)
    counts = bars.groupBy(SYMBOL).agg(F.count("*").alias("_bars"))
    return newest.join(counts, SYMBOL).withColumn("_age", F.col("_place") - 1).drop("_place")


def whole_symbol() -> WindowSpec:
    """All rows of the symbol, in the sort order that the other frames use."""
    return by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
