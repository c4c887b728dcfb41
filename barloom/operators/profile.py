"""Profiles of a dataset: shapes, labels, splits, missing values, spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import count_if, to_number
from barloom.functions.selection import quantiles
from barloom.schema import ASOF, FEATURES, SAMPLE, SYMBOL

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}  # fixed values


def shape_check(meta: DataFrame, features: DataFrame) -> DataFrame:
    """One row: row counts, whether feature ids are unique and the same as in the metadata."""
    ids = (
        meta.groupBy(SAMPLE)
        .agg(F.count("*").alias("_m"))
        .join(features.groupBy(SAMPLE).agg(F.count("*").alias("_x")), SAMPLE, "full")
        .na.fill(0, ["_m", "_x"])
    )
    return ids.agg(
        F.coalesce(F.sum("_m"), F.lit(0)).alias("meta_rows"),
        F.coalesce(F.sum("_x"), F.lit(0)).alias("feature_rows"),
        (count_if(F.col("_x") > 1) == 0).alias("feature_ids_unique"),
        (count_if(F.col("_m") != F.col("_x")) == 0).alias("ids_aligned"),
    ).withColumn("is_consistent", F.col("meta_rows") == F.col("feature_rows"))


def label_profile(samples: DataFrame) -> DataFrame:
    """One row: class counts and the positive share of all rows."""
    return samples.agg(
        F.count("*").alias("n"),
        count_if(F.col("label") == 1).alias("positive_count"),
        count_if(F.col("label") == 0).alias("negative_count"),
    ).withColumn("positive_ratio", F.try_divide(F.col("positive_count").cast("double"), F.col("n")))


def split_label_counts(samples: DataFrame) -> DataFrame:
    """Rows per split and label; a missing split shows as <NA>."""
    named = samples.select(F.coalesce("split", F.lit("<NA>")).alias("split"), "label")
    return named.groupBy("split", "label").agg(F.count("*").alias("n"))


def _per_feature(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate with columns `feature.field` into one row per feature."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}.{f}`").alias(f) for f in fields])
                    for c in columns
                ]
            )
        )
    )


def missingness(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Missing values per feature."""
    counts = features.agg(
        *[count_if(to_number(c).isNull()).alias(f"{c}.missing_count") for c in columns],
        *[F.count("*").alias(f"{c}.n") for c in columns],
    )
    return _per_feature(counts, columns, ["missing_count", "n"]).select(
        "feature",
        "missing_count",
        F.try_divide(F.col("missing_count").cast("double"), F.col("n")).alias("missing_ratio"),
    )


def top_missing(features: DataFrame, n: int = 10, columns: Sequence[str] = FEATURES) -> DataFrame:
    return missingness(features, columns).orderBy(F.desc("missing_ratio"), "feature").limit(n)


def global_missingness(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row: missing cells of the whole table."""
    missing = sum((to_number(c).isNull().cast("bigint") for c in columns), F.lit(0))
    return features.agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
        (F.count("*") * len(columns)).alias("cells"),
    ).withColumn("missing_ratio", F.try_divide(F.col("missing_cells").cast("double"), F.col("cells")))


def feature_spread(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Population variance per feature, and whether it holds one value only (NULL is a value)."""
    stats = features.agg(
        *[F.var_pop(to_number(c)).alias(f"{c}.variance") for c in columns],
        *[F.min(to_number(c)).alias(f"{c}.low") for c in columns],
        *[F.max(to_number(c)).alias(f"{c}.high") for c in columns],
        *[F.count(to_number(c)).alias(f"{c}.seen") for c in columns],
        *[F.count("*").alias(f"{c}.n") for c in columns],
    )
    alone = (F.col("seen") == 0) | ((F.col("seen") == F.col("n")) & (F.col("low") == F.col("high")))
    return _per_feature(stats, columns, ["variance", "low", "high", "seen", "n"]).select(
        "feature", "variance", alone.alias("is_constant")
    )


def low_variance(features: DataFrame, n: int = 10, columns: Sequence[str] = FEATURES) -> DataFrame:
    return feature_spread(features, columns).orderBy(F.asc_nulls_last("variance"), "feature").limit(n)


def numeric_summary(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean, sample deviation, range and quartiles per feature; what is undefined is 0."""
    long = features.select(*[to_number(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    moments = {
        "mean": F.avg("value"),
        "std": F.stddev_samp("value"),
        "min": F.min("value"),
        "max": F.max("value"),
    }
    found = quantiles(long, "value", QUARTILES, ["feature"], moments)
    # a feature without any value has no row among the quantiles
    names = features.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left").na.fill(0.0, [*moments, *QUARTILES])


def dataset_snapshot(samples: DataFrame) -> DataFrame:
    """One row for the experiment log: sizes, positive shares, dates, symbols, label sources.

    One aggregate; names of sources are listed after they are made distinct, so the list grows with their
    kinds, not with the rows.
    """
    split, label = F.col("split"), F.col("label")
    positive = (label == 1).cast("double")
    sources = F.array_join(F.array_sort(F.expr("collect_list(distinct label_source)")), "|")
    return samples.agg(
        F.count("*").alias("n_samples"),
        *[count_if(split == s).alias(f"n_{s}") for s in ("train", "valid", "test")],
        F.avg(positive).alias("positive_ratio_all"),
        *[F.avg(F.when(split == s, positive)).alias(f"positive_ratio_{s}") for s in ("train", "valid", "test")],
        F.min(ASOF).alias("date_min"),
        F.max(ASOF).alias("date_max"),
        F.count_distinct(SYMBOL).alias("n_unique_ts_code"),
        F.coalesce(F.nullif(sources, F.lit("")), F.lit("unknown")).alias("label_source"),
    )
