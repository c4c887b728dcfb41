"""Result shaping that the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Ties such as 0.0234375 at six digits fall to either side by the last bit of a sum, and
# engines add in different orders; this share of a unit moves them off the edge.
NUDGE = 0.137


def rounded(df: DataFrame, digits: int = 6, quick: bool = False) -> DataFrame:
    """Round every double, so that engines that add in another order agree. `quick` suits many rows of a few columns."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    unit = NUDGE * 10.0**-digits
    to_digits = quick_round if quick else F.round
    return df.withColumns({c: to_digits(F.col(c).cast("double") + unit, digits) for c in doubles}) if doubles else df


def quick_round(x: Column, digits: int) -> Column:
    """`F.round` of a double without its decimal arithmetic, but where a value is large, no number or next to a tie.

    A whole number below 1e9 over a power of ten is divided to the nearest double, which is the one that the decimal gives.
    """
    scaled = x * 10.0**digits
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.4999)
    return F.when(plain, whole / 10.0**digits + 0.0).otherwise(F.round(x, digits))


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
