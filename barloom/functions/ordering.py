"""Exact ranks without a one-task window.

A global `row_number` or an exact percentile puts all rows into one task. Here the rows
are range-partitioned on a unique key, so equal values may lie in several partitions, and
each row's position is its place in the partition plus the size of the partitions before
it. The sorted run is written once, so both uses of it see the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize


def positions(df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = ()) -> DataFrame:
    """Add `pos`, the 0-based place of each row in its group, and `group_rows`.

    `order` must end in a key that is unique in the group. This runs one job.
    """
    keys = [*group, *order]
    run = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "run",
    )
    # one row per partition and group that touches it; written, so that Spark knows its
    # size from the files and broadcasts it only where it is small
    sizes = materialize(
        run.groupBy(*group, "_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first")),
        "run-sizes",
    )
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumns(
        {
            "_before": F.coalesce(
                F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "group_rows": F.sum("_size").over(whole),
        }
    ).drop("_size")
    left, right = run.alias("l"), offsets.alias("r")
    match = F.col("l._part") == F.col("r._part")
    for name in group:
        match = match & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return left.join(right, match).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("r._before") + F.col("l._row") - F.col("r._first")).alias("pos"),
        F.col("r.group_rows"),
    )


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None, **sums: Column) -> DataFrame:
    """The rank dictionary: a row per group and distinct value, with further `sums` of its rows.

    A row stands for `weight` rows, if given. `n` rows have the value, `before` have a smaller one, `rank` is the 1-based mean of their places, and
    `group_rows` the size of the group. NULL is the smallest value.

    Rows are counted by value before anything is ordered, so copies of a value never leave their task
    one by one; the counts are added up inside range partitions of the values, and then over these.
    """
    rows = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*group, value).agg(rows.alias("n"), *[s.alias(c) for c, s in sums.items()])
    run = materialize(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "value-counts")
    inside = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    parts = run.groupBy(*group, "_part").agg(F.sum("n").alias("_size"))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)],
        F.col("_part").alias("_in"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias("group_rows"),
    )
    match = F.col("_part") == F.col("_in")
    for k, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    placed = run.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, match)
    before = F.col("_offset") + F.col("_inside")
    return placed.select(
        *group, value, "n", *sums, before.alias("before"), (before + (F.col("n") + 1) / 2.0).alias("rank"), "group_rows"
    )


def average_ranks(df: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based rank of `value`; equal values share the mean of their places."""
    keys = [*group, value]
    ranks = value_ranks(df, value, group).select(
        *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], F.col("rank").alias(name)
    )
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)])
    # a value held by very many rows is a skewed key of this join, which AQE splits
    return df.join(ranks, match).drop(*[f"_k{k}" for k in range(len(keys))])
