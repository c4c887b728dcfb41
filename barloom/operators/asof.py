"""As-of join of labels to bars: the last row at or before a date, never a later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import ASOF, DATE, SYMBOL


def asof_rows(dates: DataFrame, rows: DataFrame) -> DataFrame:
    """For each distinct (symbol, as-of date): the columns of the row in force, NULL before the first.

    `symbol_rows` tells how many rows the symbol has at all.

    Rows and dates form one timeline per symbol, along which the last row is carried
    forward: linear in both, with no pairing. `rows` already partitioned by symbol (the
    output of a window) is not shuffled again: both sides name the symbol anew, as a union does
    not recognise a partitioning by a column that SQL text has qualified. Neither side has more than one entry per
    symbol and day, so a symbol's timeline is bounded by the calendar.
    """
    values = [c for c in rows.columns if c != SYMBOL]
    asked = (
        dates.select(F.col(SYMBOL).alias("_key"), F.col(ASOF).alias("_at"))
        .where(F.col("_at").isNotNull())
        .distinct()
        .repartition("_key")
        .withColumn("_asked", F.lit(1))
    )
    known = rows.select(
        F.col(SYMBOL).alias("_key"), F.col(DATE).alias("_at"), F.lit(0).alias("_asked"), *[F.col(c).alias(f"_row_{c}") for c in values]
    )
    timeline = known.unionByName(asked, allowMissingColumns=True)
    line = Window.partitionBy("_key").orderBy("_at", "_asked")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # only a row that is directly followed by a question is in force for one
    needed = timeline.withColumns(
        {"_next": F.lead("_asked").over(line), "symbol_rows": F.sum(1 - F.col("_asked")).over(whole)}
    ).where((F.col("_asked") == 1) | (F.col("_next") == 1))
    # a row and the questions after it are one run; a column apiece, so that one nobody reads is not made
    since = Window.partitionBy("_key", "_run").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return (
        needed.withColumn("_run", F.sum(1 - F.col("_asked")).over(upto))
        .withColumns({f"_row_{c}": F.first(f"_row_{c}").over(since) for c in values})
        .where("_asked = 1")
        .select(F.col("_key").alias(SYMBOL), F.col("_at").alias(ASOF), "symbol_rows", *[F.col(f"_row_{c}").alias(c) for c in values])
    )


def asof_join(labels: DataFrame, rows: DataFrame, how: str = "left") -> DataFrame:
    """Attach to each label the columns of the bar in force at its as-of date.

    Copies of a (symbol, date) pair are resolved once; the final equi-join on the pair is
    the only place where they meet again, and AQE splits a pair that is very frequent.
    """
    found = asof_rows(labels, rows)
    if how == "inner":
        found = found.where(F.col(DATE).isNotNull())
    return labels.join(found, [SYMBOL, ASOF], how)
