"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ordering import positions
from barloom.schema import ASOF, SAMPLE

TIME_METHODS = ("time", "time_by_asof_date")
STRATIFIED_METHODS = ("stratified_random", "stratified")


def _cut(n: Column, n_train: Column, n_valid: Column, place: Column) -> Column:
    """The split of the 0-based place, given the sizes of the first two splits."""
    return F.when(place < n_train, "train").when(place < n_train + n_valid, "valid").otherwise("test")


def time_split(labels: DataFrame, train_ratio: float = 0.7, valid_ratio: float = 0.15) -> DataFrame:
    """Split the distinct as-of dates in order; all samples of a date go together."""
    dates = labels.where(F.col(ASOF).isNotNull()).select(ASOF).distinct()
    # one row per calendar day at most, so one task ranks them and the map can be broadcast
    everything = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everything)
    place = F.row_number().over(everything.orderBy(ASOF)) - 1
    n_train = F.least(F.col("_n") - 2, F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train_ratio))))
    n_valid = F.least(
        F.col("_n") - F.col("_train") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(valid_ratio)))
    )
    split = F.when(F.col("_n") < 3, "train").otherwise(
        _cut(F.col("_n"), F.col("_train"), F.col("_valid"), F.col("_place"))
    )
    mapped = (
        dates.withColumns({"_n": n, "_place": place})
        .withColumn("_train", n_train)
        .withColumn("_valid", n_valid)
        .select(ASOF, split.alias("split"))
    )
    return labels.join(F.broadcast(mapped), ASOF, "left").withColumn(
        "split", F.coalesce("split", F.lit("train"))
    )


def stratified_split(
    labels: DataFrame, train_ratio: float = 0.7, valid_ratio: float = 0.15, seed: int = 42
) -> DataFrame:
    """Per label value, cut a seeded order of the samples at the rounded ratios.

    The order is the md5 of seed and sample id, so it does not depend on partitioning.
    """
    shuffled = labels.where(F.col("label").isNotNull()).withColumn(
        "_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.col(SAMPLE)))
    )
    placed = positions(shuffled, ["_mix", SAMPLE], group=["label"])
    n = F.col("group_rows")

    def rounded(ratio: float) -> Column:
        return F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0).cast("bigint"))

    n_train = F.when(n < 3, F.greatest(F.lit(1), n - 1)).otherwise(F.least(n - 2, rounded(train_ratio)))
    n_valid = F.when(n < 3, n - F.col("_train")).otherwise(
        F.least(n - F.col("_train") - 1, rounded(valid_ratio))
    )
    split = (
        placed.withColumn("_train", n_train)
        .withColumn("_valid", n_valid)
        .withColumn("split", _cut(n, F.col("_train"), F.col("_valid"), F.col("pos")))
    )
    unlabelled = labels.where(F.col("label").isNull()).withColumn("split", F.lit("train"))
    return split.select(*labels.columns, "split").unionByName(unlabelled)


def assign_split(
    labels: DataFrame,
    method: str = "time",
    train_ratio: float = 0.7,
    valid_ratio: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    name = (method or "time").lower()
    if name in TIME_METHODS:
        return time_split(labels, train_ratio, valid_ratio)
    if name in STRATIFIED_METHODS:
        return stratified_split(labels, train_ratio, valid_ratio, seed)
    raise ValueError(f"unsupported split method: {method}")


def training_roles(samples: DataFrame, tail: float = 0.2) -> DataFrame:
    """Add `role` (train, valid or NULL): validate on valid, else on test, else on the train tail.

    Reads the split counts first, as the choice depends on which splits exist.
    """
    counts = {r["split"]: r["n"] for r in samples.groupBy("split").agg(F.count("*").alias("n")).collect()}
    n_train = counts.get("train", 0)
    if not n_train:
        raise ValueError("no train samples found in the split column")
    held_out = "valid" if counts.get("valid") else "test" if counts.get("test") else None
    if held_out:
        role = F.when(F.col("split") == "train", "train").when(F.col("split") == held_out, "valid")
        return samples.withColumn("role", role)
    return train_tail_roles(samples, tail)


def train_tail_roles(samples: DataFrame, tail: float = 0.2) -> DataFrame:
    """The last fifth of the train samples by as-of date becomes the validation set."""
    train = samples.where(F.col("split") == "train")
    placed = positions(train, [ASOF, SAMPLE])
    n = F.col("group_rows")
    size = F.greatest(F.lit(1), F.bround(n * F.lit(tail), 0).cast("bigint"))
    size = F.when(size >= n, F.lit(1)).otherwise(size)
    role = F.when(F.col("pos") >= n - size, "valid").otherwise("train")
    rest = samples.where(~F.coalesce(F.col("split") == "train", F.lit(False))).withColumn("role", F.lit(None).cast("string"))
    return placed.withColumn("role", role).select(*samples.columns, "role").unionByName(rest)


def infer_split_method(samples: DataFrame) -> DataFrame:
    """One row: `time_by_asof_date` where the splits follow each other in time, else `unknown`."""

    def edge(pick, split: str) -> Column:
        return pick(F.when(F.col("split") == split, F.col(ASOF)))

    edges = samples.agg(
        edge(F.max, "train").alias("train_max"),
        edge(F.min, "valid").alias("valid_min"),
        edge(F.max, "valid").alias("valid_max"),
        edge(F.min, "test").alias("test_min"),
    )
    overlap = F.coalesce(F.col("train_max") > F.col("valid_min"), F.lit(False)) | F.coalesce(
        F.col("valid_max") > F.col("test_min"), F.lit(False)
    )
    seen = F.coalesce("train_max", "valid_max", "test_min").isNotNull()
    return edges.withColumn(
        "split_method", F.when(seen & ~overlap, "time_by_asof_date").otherwise("unknown")
    )
