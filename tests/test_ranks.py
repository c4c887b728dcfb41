"""Ordering, metrics and comparison against plain computation, with ties and hot values."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ordering import average_ranks, positions, value_ranks
from barloom.functions.selection import quantiles
from barloom.operators import compare as c
from barloom.operators import metrics as m
from barloom.operators import ranking as k


def scored(n=400, seed=1, hot=0.4):
    """Scores of which a large share is one value."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"sample_id": [f"s{i:04d}" for i in range(n)], "y_score": rng.random(n).round(2)})
    frame.loc[rng.random(n) < hot, "y_score"] = 0.5
    frame["y_true"] = (rng.random(n) < 0.3 + 0.4 * frame.y_score).astype(int)
    frame["g"] = rng.integers(0, 3, n)
    return frame


def test_positions_are_a_permutation_per_group(spark):
    frame = scored()
    got = positions(spark.createDataFrame(frame), ["y_score", "sample_id"], ["g"]).toPandas()
    want = frame.sort_values(["y_score", "sample_id"])
    want["pos"] = want.groupby("g").cumcount()
    both = got.merge(want[["sample_id", "pos"]], on="sample_id")
    assert (both.pos_x == both.pos_y).all() and len(both) == len(frame)
    assert (both.group_rows == both.groupby("g").g.transform("size")).all()


def test_positions_with_null_group(spark):
    frame = spark.createDataFrame([("a", None), ("b", None), ("c", 1)], "sample_id string, g int")
    got = {r.sample_id: (r.pos, r.group_rows) for r in positions(frame, ["sample_id"], ["g"]).collect()}
    assert got == {"a": (0, 2), "b": (1, 2), "c": (0, 1)}


def test_average_ranks(spark):
    frame = scored()
    got = average_ranks(spark.createDataFrame(frame), "y_score", "r").toPandas().set_index("sample_id").r
    want = frame.set_index("sample_id").y_score.rank()
    assert (got.sort_index() == want.sort_index()).all()


def test_value_ranks_by_group_with_nulls(spark):
    rows = [(None, 0.5), (None, 0.5), (None, -1.0), ("g", None), ("g", 2.0), ("g", 2.0), ("g", 3.0), ("h", 7.0)]
    found = value_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], total=F.sum("v"))
    got = {(r.g, r.v): (r.n, r.before, r.rank, r.group_rows, r.total) for r in found.collect()}
    assert got == {
        (None, -1.0): (1, 0, 1.0, 3, -1.0),
        (None, 0.5): (2, 1, 2.5, 3, 1.0),
        ("g", None): (1, 0, 1.0, 4, None),
        ("g", 2.0): (2, 1, 2.5, 4, 4.0),
        ("g", 3.0): (1, 3, 4.0, 4, 3.0),
        ("h", 7.0): (1, 0, 1.0, 1, 7.0),
    }


def test_value_ranks_over_many_partitions(spark):
    """Values spread over all range partitions, one of them held by a third of the rows."""
    values = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(5)).alias("v"))
    frame = values.toPandas()
    got = {r.v: r["rank"] for r in value_ranks(spark.createDataFrame(frame), "v").collect()}
    assert frame.v.map(got).equals(frame.v.rank())


def test_rank_dictionary_orders_no_rows(spark):
    """What follows the written counts has neither ids nor rows of the input."""
    frame = spark.createDataFrame(scored()).repartition(3)
    plan = m.roc_auc(frame)._jdf.queryExecution().toString()
    assert "y_true" not in plan and "sample_id" not in plan


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_quantiles(spark, n):
    frame = scored(n)
    probabilities = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0}
    row = quantiles(spark.createDataFrame(frame), "y_score", probabilities).first().asDict()
    for name, p in probabilities.items():
        assert row[name] == pytest.approx(frame.y_score.quantile(p))


def pairwise_auc(frame):
    pos, neg = frame[frame.y_true == 1].y_score, frame[frame.y_true == 0].y_score
    wins = [1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)]
    return np.mean(wins)


def test_auc_counts_ties_half(spark):
    frame = scored()
    assert m.roc_auc(spark.createDataFrame(frame)).first().auc == pytest.approx(pairwise_auc(frame))
    by_group = {r.g: r.auc for r in m.roc_auc(spark.createDataFrame(frame), group=["g"]).collect()}
    for g, part in frame.groupby("g"):
        assert by_group[g] == pytest.approx(pairwise_auc(part))


def test_auc_of_one_class_is_null(spark):
    frame = scored(20).assign(y_true=1)
    assert m.roc_auc(spark.createDataFrame(frame)).first().auc is None


def test_confusion_and_zero_division(spark):
    rows = [("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.5), ("d", 0, 0.2), ("e", None, 0.2), ("f", 1, None)]
    frame = spark.createDataFrame(rows, "sample_id string, y_true int, y_score double")
    row = m.confusion_metrics(frame).first()
    assert (row.n, row.tp, row.fp, row.fn, row.tn) == (4, 2, 1, 0, 1)
    assert (row.accuracy, row.precision, row.recall) == (0.75, pytest.approx(2 / 3), 1.0)
    none = m.confusion_metrics(frame, threshold=2.0).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_mode_and_score_column(spark):
    frame = spark.createDataFrame([("a", 0.1)], "sample_id string, score double")
    assert m.prediction_mode(frame) == "scan" and m.score_column(frame) == "score"
    with pytest.raises(KeyError):
        m.score_column(frame, "other")
    with pytest.raises(KeyError):
        m.score_column(frame.drop("score"))


def test_given_class_is_used_when_asked(spark):
    frame = spark.createDataFrame([("a", 1, 0.9, 0)], "sample_id string, y_true int, y_score double, y_pred int")
    assert m.confusion_metrics(frame, use_given=True).first().fn == 1
    assert m.confusion_metrics(frame).first().tp == 1


def pair(spark, n=300):
    a, b = scored(n, 1), scored(n + 20, 2)
    b = b.rename(columns={"y_score": "score"})
    return a, b, c.align_predictions(spark.createDataFrame(a.drop(columns="g")), spark.createDataFrame(b.drop(columns="g")))


def test_comparison_of_two_sets(spark):
    a, b, aligned = pair(spark)
    both = a.merge(b, on="sample_id", suffixes=("_a", "_b"))
    assert aligned.count() == len(both) == 300
    assert c.pearson(aligned).first().pearson == pytest.approx(both.y_score.corr(both.score))
    assert c.spearman(aligned).first().spearman == pytest.approx(both.y_score.rank().corr(both.score.rank()))
    top = {s: set(both.sort_values([s, "sample_id"], ascending=[False, True]).head(40).sample_id) for s in ("y_score", "score")}
    row = c.overlap_counts(aligned, 40).first()
    shared = top["y_score"] & top["score"]
    assert (row.overlap_count, row.overlap_ratio) == (len(shared), pytest.approx(len(shared) / 40))
    assert {r.sample_id for r in c.only_in_top(aligned, "a", 40).collect()} == top["y_score"] - top["score"]
    assert {r.sample_id for r in c.only_in_top(aligned, "b", 40).collect()} == top["score"] - top["y_score"]
    assert c.label_mismatches(aligned).first().label_mismatch_count == (both.y_true_a != both.y_true_b).sum()


def test_future_returns_by_bucket(spark):
    a, b, aligned = pair(spark)
    rng = np.random.default_rng(5)
    future = pd.DataFrame({"sample_id": a.sample_id, "future_return": rng.normal(0, 1, len(a))}).iloc[::2]
    got = {r.bucket: r for r in c.future_return_buckets(aligned, spark.createDataFrame(future), 40).collect()}
    assert set(got) == set(c.BUCKETS)
    flags = c.top_n_membership(aligned, 40).toPandas().merge(future, on="sample_id")
    part = flags[flags.in_a & ~flags.in_b].future_return
    row = got["a_only_topN"]
    assert row["count"] == len(part)
    assert (row["mean"], row["median"], row["std"]) == pytest.approx((part.mean(), part.median(), part.std(ddof=0)))


def test_empty_buckets_are_kept(spark):
    _, _, aligned = pair(spark)
    none = spark.createDataFrame([("zzz", 1.0)], "sample_id string, future_return double")
    rows = c.future_return_buckets(aligned, none, 10).collect()
    assert len(rows) == 5 and all(r["count"] == 0 and r["mean"] is None and r["median"] is None for r in rows)


def test_winner_rules(spark):
    rows = [("a", 0.5, 0.7, None), ("b", 0.5, 0.6, 0.2)]
    metrics = spark.createDataFrame(rows, "model string, accuracy double, f1 double, auc double")
    assert {r.metric: r.winner for r in c.metric_winner(metrics).collect()} == {"accuracy": "tie", "f1": "a", "auc": "b"}


def test_sets_that_cannot_be_aligned(spark):
    a = spark.createDataFrame([("a", 0.1)], "sample_id string, score double")
    with pytest.raises(KeyError):
        c.align_predictions(a, a.withColumnRenamed("sample_id", "id"))
    with pytest.raises(ValueError):
        c.align_predictions(a, spark.createDataFrame([("a", 0.1, 1)], "sample_id string, score double, y_true int"))


def test_intersection_keeps_all_with_zero(spark):
    frame = pd.DataFrame({"sample_id": list("abc"), "ts_code": list("ABC"), "asof_date": pd.Timestamp("2025-01-01").date(), "score": [0.1, 0.9, 0.5]})
    one = spark.createDataFrame(frame)
    two = spark.createDataFrame(frame.assign(score=[0.8, 0.2, 0.5]).iloc[:2])
    rows = k.intersect_models({"x": one, "y": two}, 0).collect()
    assert [(r.sample_id, r.rank_x, r.rank_y, r.rank_sum) for r in rows] == [("b", 1, 2, 3), ("a", 3, 1, 4)]
    assert [r.score_min for r in rows] == [0.2, 0.1]
    assert k.intersect_models({"x": one, "y": two}, 1).count() == 1


def test_whole_comparison(spark):
    a, b, _ = pair(spark)
    result = c.compare_predictions(spark.createDataFrame(a.drop(columns="g")), spark.createDataFrame(b.drop(columns="g")), 10)
    assert result.sections["basic_info"].first().rows_aligned == 300
    assert {r.model for r in result.sections["metrics"].collect()} == {"a", "b"}
    assert result.sections["false_positive_a"].count() <= 10


def test_summary_of_a_feature_without_values(spark):
    from barloom.operators.profile import feature_spread, missingness, numeric_summary

    rows = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, None)], "sample_id string, x double, y double")
    got = {r.feature: r for r in numeric_summary(rows, ["x", "y"]).collect()}
    assert (got["x"]["mean"], got["x"]["q25"], got["y"]["mean"], got["y"]["max"]) == (2.0, 1.5, 0.0, 0.0)
    assert {r.feature: r.is_constant for r in feature_spread(rows, ["x", "y"]).collect()} == {"x": False, "y": True}
    assert {r.feature: r.missing_count for r in missingness(rows, ["x", "y"]).collect()} == {"x": 0, "y": 2}
