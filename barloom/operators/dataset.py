"""The labelled dataset: labels, as-of windows, features and splits in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import count_if, fill_sample_id, rename_aliases, to_date
from barloom.operators.asof import asof_join
from barloom.operators.features import build_features
from barloom.operators.quality import keep_sound_symbols
from barloom.operators.sequence import SEQUENCE_COLUMNS, window_sequences
from barloom.operators.splits import assign_split
from barloom.schema import ASOF, DATE, FEATURES, LABEL_ALIASES, SAMPLE, SAMPLE_META, SYMBOL
from barloom.session import shuffles_deleted


def prepare_labels(labels: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """Contract names, dates, sample ids and default attributes.

    Labels without a date are left out, and those without a symbol unless `keep_unnamed`.
    """
    named = rename_aliases(labels, LABEL_ALIASES)
    named = named.withColumn(ASOF, to_date(ASOF, named.schema[ASOF].dataType)).where(F.col(ASOF).isNotNull())
    if not keep_unnamed:
        named = named.where(F.col(SYMBOL).isNotNull())
    out = fill_sample_id(named)
    if "label_source" not in out.columns:
        out = out.withColumn("label_source", F.lit("labels.csv"))
    if "confidence" not in out.columns:
        out = out.withColumn("confidence", F.lit(1.0))
    return out.withColumn("label", F.col("label").try_cast("int"))


def sample_windows(
    labels: DataFrame, bars: DataFrame, window_size: int = 120, closes_complete: bool = True
) -> DataFrame:
    """Each label with the window that ends at its as-of bar; `rn` tells how long the history is."""
    return asof_join(labels, build_features(bars, window_size, closes_complete))


def build_samples(
    labels: DataFrame,
    bars: DataFrame,
    window_size: int = 120,
    min_history: int = 80,
    split_method: str = "time",
    train_ratio: float = 0.7,
    valid_ratio: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """All labels with their features and split; `skip_reason` is NULL for the samples.

    `bars` are normalised. Bars of symbols that break a quality rule are left out here, in
    the shuffle that the feature windows use. The split is made on all labels, before any
    is skipped.
    """
    if window_size <= 0 or min_history <= 0:
        raise ValueError("window_size and min_history must be positive")
    ready = prepare_labels(labels)
    split = assign_split(ready, split_method, train_ratio, valid_ratio, seed)
    sound = keep_sound_symbols(bars)
    # a label before the first bar has no bar in force, but its symbol is not missing
    reason = F.when(F.col("symbol_rows") == 0, "no_usable_bars").when(
        F.coalesce(F.col("rn"), F.lit(0)) < max(window_size, min_history), "insufficient_history"
    )
    return (
        sample_windows(split, sound, window_size)
        .withColumn("skip_reason", reason)
        .withColumnRenamed(DATE, "window_end")
        .drop("symbol_rows")
    )


def dataset_rows(built: DataFrame) -> DataFrame:
    """The dataset table: sample metadata, row number of the as-of bar, and features."""
    meta = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SAMPLE_META]
    return built.where(F.col("skip_reason").isNull()).select(*meta, "rn", *FEATURES)


def skipped_rows(built: DataFrame) -> DataFrame:
    return built.where(F.col("skip_reason").isNotNull()).select(SAMPLE, SYMBOL, ASOF, "skip_reason")


def skip_report(built: DataFrame) -> DataFrame:
    """One row: labels, samples, skips by kind, and the ratio that the limit applies to.

    A history that is too short leaves a label out of the dataset, but is not an error and
    does not count towards the ratio.
    """
    return built.agg(
        F.count("*").alias("num_labels"),
        count_if(F.col("skip_reason").isNull()).alias("num_samples"),
        count_if(F.col("skip_reason") == "no_usable_bars").alias("num_skipped"),
        count_if(F.col("skip_reason") == "insufficient_history").alias("num_short_history"),
    ).withColumn(
        "skip_ratio",
        F.coalesce(F.try_divide(F.col("num_skipped").cast("double"), F.col("num_labels")), F.lit(0.0)),
    )


def skip_examples(built: DataFrame, n: int = 10) -> DataFrame:
    errors = skipped_rows(built).where(F.col("skip_reason") != "insufficient_history")
    return errors.orderBy(ASOF, SAMPLE).limit(n)


def check_skip_limit(report: DataFrame, max_skip_ratio: float | None) -> None:
    """Stops a build that produced nothing or skipped too much; run it before writing."""
    row = report.first()
    if row["num_samples"] == 0:
        raise RuntimeError("no valid samples built from labels")
    if max_skip_ratio is not None and row["skip_ratio"] > max_skip_ratio:
        raise RuntimeError(f"skip ratio exceeds limit: {row['skip_ratio']:.2%} > {max_skip_ratio:.2%}")


def misaligned_ids(left: DataFrame, right: DataFrame, key: str = SAMPLE) -> DataFrame:
    """Ids that only one of two tables has, with the side that has them."""
    only_left = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def align_features(meta: DataFrame, features: DataFrame) -> DataFrame:
    """Metadata with its features; a sample without features is an error."""
    for name, df in (("metadata", meta), ("features", features)):
        if SAMPLE not in df.columns:
            raise KeyError(f"{name} is missing required column: {SAMPLE}")
    with shuffles_deleted(meta.sparkSession):
        missing = meta.join(features.select(SAMPLE), SAMPLE, "left_anti").count()
    if missing:
        raise KeyError(f"features are missing sample ids: count={missing}")
    return meta.join(features, SAMPLE)


@dataclass(frozen=True)
class Dataset:
    samples: DataFrame
    skipped: DataFrame
    report: DataFrame
    sequences: DataFrame | None


def build_dataset(
    labels: DataFrame,
    bars: DataFrame,
    window_size: int = 120,
    min_history: int = 80,
    split_method: str = "time",
    save_sequence: bool = True,
    sequence_columns: Sequence[str] = SEQUENCE_COLUMNS,
    **split: float | int,
) -> Dataset:
    built = build_samples(labels, bars, window_size, min_history, split_method, **split)
    return dataset_parts(built, bars, window_size, save_sequence, sequence_columns)


def dataset_parts(
    built: DataFrame,
    bars: DataFrame,
    window_size: int = 120,
    save_sequence: bool = True,
    sequence_columns: Sequence[str] = SEQUENCE_COLUMNS,
) -> Dataset:
    """What a build hands out, from the rows of `build_samples`; each part reads them, so store them first to make them once."""
    samples = dataset_rows(built)
    sequences = (
        window_sequences(samples, keep_sound_symbols(bars), window_size, sequence_columns) if save_sequence else None
    )
    return Dataset(samples, skipped_rows(built), skip_report(built), sequences)
