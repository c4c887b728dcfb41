"""Column expressions that fix NULL, NaN, date and identity semantics once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import ASOF, SAMPLE, SYMBOL

TINY = 1e-12  # fixed value: a denominator of at most this size yields NULL


def to_number(column: str | Column) -> Column:
    """Double or NULL: text that is no number and NaN both become NULL."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_date(column: str, dtype: T.DataType) -> Column:
    """Date or NULL, by the type the source column has.

    Integers are yyyymmdd where they have eight digits, else nanoseconds since 1970
    (which is how nanosecond parquet timestamps arrive).
    """
    value = F.col(column)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    if isinstance(dtype, T.IntegralType):
        digits = value.between(10_000_101, 99_991_231)
        return F.when(digits, _text_date(value.cast("string"))).otherwise(
            F.timestamp_micros(F.expr(f"`{column}` div 1000")).cast("date")
        )
    return _text_date(value.cast("string"))


def _text_date(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(trimmed, F.lit("yyyyMMdd")),
        F.try_to_timestamp(trimmed),
    ).cast("date")


def safe_div(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) > TINY, top / bottom)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def holds(condition: Column) -> Column:
    """A rule over NULL does not hold, as a comparison with NaN does not."""
    return F.coalesce(condition, F.lit(False))


def count_if(condition: Column) -> Column:
    return F.count_if(holds(condition))


def pick_column(df: DataFrame, names: Iterable[str], required: bool = True) -> str | None:
    """The first of `names` that the frame has, whatever its letter case."""
    present = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in present:
            return present[name.lower()]
    if required:
        raise KeyError(f"missing required column, any of {list(names)}")
    return None


def rename_aliases(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    chosen = {}
    for target, names in aliases.items():
        found = pick_column(df, names, required=False)
        if found is None:
            raise KeyError(f"missing required column: {target}")
        chosen[found] = target
    return df.withColumnsRenamed(chosen)


def sample_id(symbol: str = SYMBOL, asof: str = ASOF) -> Column:
    return F.concat(F.col(symbol), F.lit("_"), F.date_format(F.col(asof), "yyyy-MM-dd"))


def sample_id_or_flag(symbol: str = SYMBOL, asof: str = ASOF) -> Column:
    """The contract checker's id: a bad date shows in the id."""
    return F.concat(
        F.col(symbol), F.lit("_"), F.coalesce(F.date_format(F.col(asof), "yyyy-MM-dd"), F.lit("INVALID_DATE"))
    )


def fill_sample_id(df: DataFrame) -> DataFrame:
    if SAMPLE not in df.columns:
        return df.withColumn(SAMPLE, sample_id())
    return df.withColumn(SAMPLE, F.coalesce(F.nullif(F.col(SAMPLE), F.lit("")), sample_id()))


def join_key(df: DataFrame) -> Column:
    """The key by which two prediction sets are compared."""
    if SAMPLE in df.columns:
        return F.col(SAMPLE).cast("string")
    return F.concat_ws("|", F.col(SYMBOL).cast("string"), F.col(ASOF).cast("string"))


def merge_rows(*rows: DataFrame) -> DataFrame:
    """One row out of several one-row frames with different columns."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
