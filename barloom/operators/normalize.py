"""From source bars to contract bars: dates, numbers, units, duplicates, derived closes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import to_date, to_number
from barloom.functions.frames import by_date, whole_symbol
from barloom.schema import DATE, FILE, NORMALIZED_NUMBERS, ORDER, SYMBOL

@dataclass(frozen=True)
class BarUnits:
    """Units of the source; the contract is shares and yuan."""

    vol_unit: str = "lots"
    amount_unit: str = "thousand_yuan"
    vol_lot_size: float = 100.0
    amount_thousand_size: float = 1000.0

    def factor(self, column: str) -> float:
        if column == "vol" and self.vol_unit == "lots":
            return self.vol_lot_size
        if column == "amount" and self.amount_unit == "thousand_yuan":
            return self.amount_thousand_size
        return 1.0


SOURCE_UNITS = BarUnits()
CONTRACT_UNITS = BarUnits(vol_unit="shares", amount_unit="yuan")


def coerce_bars(bars: DataFrame) -> DataFrame:
    """Keep the contract columns; a bad number becomes NULL, a row without a date is dropped."""
    if DATE not in bars.columns:
        raise KeyError(f"bars are missing required column: {DATE}")
    dtype = bars.schema[DATE].dataType
    return bars.select(
        SYMBOL,
        to_date(DATE, dtype).alias(DATE),
        *[to_number(c).alias(c) for c in NORMALIZED_NUMBERS if c in bars.columns],
        *[c for c in (FILE, ORDER) if c in bars.columns],
    ).where(F.col(DATE).isNotNull())


def convert_units(bars: DataFrame, units: BarUnits = SOURCE_UNITS) -> DataFrame:
    changed = {
        c: F.col(c) * F.lit(units.factor(c))
        for c in ("vol", "amount")
        if c in bars.columns and units.factor(c) != 1.0
    }
    return bars.withColumns(changed) if changed else bars


def duplicate_dates(bars: DataFrame) -> DataFrame:
    """Symbols that have a date twice, with the first five such dates."""
    repeated = bars.groupBy(SYMBOL, DATE).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.groupBy(SYMBOL).agg(
        F.count("*").alias("n_duplicate_dates"),
        F.array_join(
            F.slice(F.array_sort(F.collect_list(F.date_format(DATE, "yyyy-MM-dd"))), 1, 5), ", "
        ).alias("preview"),
    )


def one_bar_per_date(bars: DataFrame, policy: str = "raise") -> DataFrame:
    """Apply the duplicate policy and make (symbol, date) unique.

    `first` and `last` go by the order of the files, and in a file by that of its rows. `raise` removes every bar of a symbol that has a
    duplicate (see `duplicate_dates`), where a single-symbol job would stop.

    All policies aggregate on (symbol, date) before anything is grouped by symbol alone, so
    copies are combined before the shuffle and no symbol has more rows than the calendar days.
    """
    values = [c for c in bars.columns if c not in (SYMBOL, DATE, FILE, ORDER)]
    if policy == "raise":
        merged = bars.groupBy(SYMBOL, DATE).agg(
            *[F.first(c).alias(c) for c in values], F.count("*").alias("_copies")
        )
        worst = merged.withColumn("_worst", F.max("_copies").over(whole_symbol()))
        return worst.where("_worst = 1").drop("_copies", "_worst")
    if policy not in ("first", "last"):
        raise ValueError(f"unknown duplicate policy: {policy}")
    if ORDER not in bars.columns:
        raise KeyError(f"duplicate policy {policy} needs the file order column {ORDER}")
    # one struct of a whole row, led by the file order, so that ties never mix two rows
    row = F.struct(*[c for c in (FILE, ORDER) if c in bars.columns], *values)
    kept = (F.min if policy == "first" else F.max)(row).alias("_bar")
    return bars.groupBy(SYMBOL, DATE).agg(kept).select(SYMBOL, DATE, *[F.col(f"_bar.{c}").alias(c) for c in values])


def derive_previous_close(bars: DataFrame) -> DataFrame:
    previous = F.lag("close").over(by_date())
    return bars.withColumn("pre_close", previous).withColumns(
        {
            "change": F.col("close") - F.col("pre_close"),
            "pct_chg_calc": F.try_divide(F.col("close") - F.col("pre_close"), F.col("pre_close")) * 100.0,
        }
    )


def normalize_bars(
    bars: DataFrame,
    units: BarUnits = SOURCE_UNITS,
    duplicate_policy: str = "raise",
    derive_optional_fields: bool = False,
) -> DataFrame:
    out = convert_units(one_bar_per_date(coerce_bars(bars), duplicate_policy), units)
    return derive_previous_close(out) if derive_optional_fields and "close" in out.columns else out
