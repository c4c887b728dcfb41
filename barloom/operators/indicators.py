"""Indicators per bar. All of them share one exchange and one sort by symbol and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import by_date, last_rows, up_to_now
from barloom.functions.rolling import Rolling

GUARD = 1e-9  # fixed value: added to a denominator by the screener


def with_padded_return(bars: DataFrame, name: str = "ret_1d") -> DataFrame:
    """Close to close return, in which a missing close repeats the last one."""
    return (
        bars.withColumn("_padded", F.last("close", ignorenulls=True).over(up_to_now()))
        .withColumn(name, F.try_divide(F.col("_padded"), F.lag("_padded").over(by_date())) - 1.0)
        .drop("_padded")
    )


def basic_indicators(bars: DataFrame) -> DataFrame:
    return with_padded_return(bars).withColumns(
        {f"ma_{n}": F.avg("close").over(last_rows(n)) for n in (5, 20)}
    )


def screener_indicators(bars: DataFrame) -> DataFrame:
    """Moving averages, true range and base statistics; NULL until a frame is full."""
    roll = Rolling()
    out: dict[str, Column] = {}
    for n in (5, 10, 20, 30, 60, 120):
        out[f"ma{n}"] = roll.full_mean("close", n)
        out[f"vma{n}"] = roll.full_mean("vol", n)
    out["atr14"] = roll.full_mean("_true_range", 14)
    out["hhv90_prev"] = F.when(roll.count("high", 90, 1) == 90, roll.highest("high", 90, 1))
    out["llv100"] = F.when(roll.count("low", 100) == 100, roll.lowest("low", 100))
    out["hhv100"] = F.when(roll.count("high", 100) == 100, roll.highest("high", 100))
    out["vol_mean_20"] = roll.full_mean("vol", 20)
    out["vol_mean_100"] = roll.full_mean("vol", 100)
    out["vol_std_100"] = F.when(roll.count("vol", 100) == 100, roll.std("vol", 100, sample=True))

    before = F.lag("close").over(by_date())
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    wide = roll.attach(bars.withColumn("_true_range", true_range)).withColumns(out)
    return wide.withColumns(
        {
            "vol_cv_100": F.col("vol_std_100") / (F.col("vol_mean_100") + GUARD),
            "base_range_pct_100": (F.col("hhv100") - F.col("llv100")) / (F.col("llv100") + GUARD),
            "vol_shrink_ratio": F.col("vol_mean_20") / (F.col("vol_mean_100") + GUARD),
        }
    ).drop("_true_range", *roll.scratch_columns)
