"""Splits: sizes, order, fallbacks."""

import datetime

import pandas as pd
import pytest

from barloom.operators import splits as s


def labels(spark, n, ones=0.5, dates=None):
    start = datetime.date(2025, 1, 1)
    frame = pd.DataFrame(
        {
            "sample_id": [f"s{i:03d}" for i in range(n)],
            "asof_date": [start + datetime.timedelta(days=i % (dates or n)) for i in range(n)],
            "label": [1 if i < n * ones else 0 for i in range(n)],
        }
    )
    return spark.createDataFrame(frame)


def sizes(n, a=0.7, b=0.15):
    train = min(n - 2, max(1, int(n * a)))
    valid = min(n - train - 1, max(1, int(n * b)))
    return train, valid, n - train - valid


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 20, 57])
def test_time_split_sizes_and_order(spark, n):
    got = s.time_split(labels(spark, n)).toPandas().sort_values("asof_date")
    counts = got.split.value_counts()
    if n < 3:
        assert set(got.split) == {"train"}
    else:
        assert tuple(counts.get(x, 0) for x in ("train", "valid", "test")) == sizes(n)
        assert list(got.split) == sorted(got.split, key=["train", "valid", "test"].index)


def test_samples_of_a_date_stay_together(spark):
    got = s.assign_split(labels(spark, 60, dates=7), "time_by_asof_date").toPandas()
    assert got.groupby("asof_date").split.nunique().max() == 1 and got.split.nunique() == 3


@pytest.mark.parametrize("n,ones,want", [(1, 1.0, (1, 0, 0)), (2, 1.0, (1, 1, 0)), (3, 1.0, (1, 1, 1)), (5, 1.0, (3, 1, 1)), (40, 1.0, (28, 6, 6))])
def test_stratified_sizes(spark, n, ones, want):
    counts = s.stratified_split(labels(spark, n, ones)).toPandas().split.value_counts()
    assert tuple(counts.get(x, 0) for x in ("train", "valid", "test")) == want


def test_stratified_is_per_class_and_repeatable(spark):
    frame = labels(spark, 100, 0.2)
    first = s.stratified_split(frame, seed=1).toPandas()
    again = s.stratified_split(frame.repartition(7), seed=1).toPandas()
    other = s.stratified_split(frame, seed=2).toPandas()
    key = lambda f: dict(zip(f.sample_id, f.split))
    assert key(first) == key(again) != key(other)
    assert first.groupby(["label", "split"]).size().to_dict() == {
        (0, "train"): 56, (0, "valid"): 12, (0, "test"): 12, (1, "train"): 14, (1, "valid"): 3, (1, "test"): 3,
    }


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        s.assign_split(labels(spark, 3), "random")


def roles(frame):
    return frame.toPandas().role.value_counts(dropna=False).to_dict()


def test_validation_falls_back_to_test_then_to_the_tail(spark):
    from pyspark.sql import functions as F

    frame = labels(spark, 20)
    by_row = frame.withColumn("split", F.when(F.col("sample_id") < "s015", "train").otherwise("test"))
    assert roles(s.training_roles(by_row)) == {"train": 15, "valid": 5}
    only_train = frame.withColumn("split", F.lit("train"))
    got = s.training_roles(only_train).toPandas()
    assert sorted(got[got.role == "valid"].sample_id) == ["s016", "s017", "s018", "s019"]
    with pytest.raises(ValueError):
        s.training_roles(frame.withColumn("split", F.lit("test")))


def test_inferred_method(spark):
    frame = s.time_split(labels(spark, 30))
    assert s.infer_split_method(frame).first().split_method == "time_by_asof_date"
    mixed = s.stratified_split(labels(spark, 30))
    assert s.infer_split_method(mixed).first().split_method == "unknown"
