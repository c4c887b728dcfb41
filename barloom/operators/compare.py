"""Comparison of two prediction sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import count_if, holds, join_key, to_number
from barloom.functions.ordering import value_ranks
from barloom.operators.metrics import binary_metrics, prediction_mode, score_column, score_summary
from barloom.schema import ASOF, SAMPLE, SYMBOL
from barloom.session import materialize

KEY = "join_key"


def _alignment_keys(a: DataFrame, b: DataFrame) -> list[str]:
    for keys in ([SAMPLE], [SYMBOL, ASOF]):
        if all(k in a.columns and k in b.columns for k in keys):
            return keys
    raise KeyError("cannot align two prediction sets: no shared sample_id, nor ts_code and asof_date")


def align_predictions(
    a: DataFrame, b: DataFrame, score_a: str | None = None, score_b: str | None = None
) -> DataFrame:
    """Inner join of two sets: keys, `join_key`, score_a and score_b, and truth and class of either.

    Score columns are renamed before the join, so they may have any names. Rows without
    both scores are dropped.
    """
    if prediction_mode(a) != prediction_mode(b):
        raise ValueError("prediction sets differ in mode: only one of them has y_true")
    keys = _alignment_keys(a, b)

    def side(df: DataFrame, tag: str, explicit: str | None) -> DataFrame:
        numbers = {"score": score_column(df, explicit), "y_true": "y_true", "y_pred": "y_pred"}
        ids = [c for c in (SYMBOL, ASOF) if c in df.columns and c not in keys and tag == "a"]
        return df.select(
            *keys, *ids, *[to_number(s).alias(f"{n}_{tag}") for n, s in numbers.items() if s in df.columns]
        )

    joined = side(a, "a", score_a).join(side(b, "b", score_b), keys, "inner")
    return joined.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull()).withColumn(
        KEY, join_key(joined)
    )


def alignment_info(a: DataFrame, b: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: sizes before and after the alignment."""
    parts = [df.agg(F.count("*").alias("n")).withColumn("part", F.lit(p)) for p, df in
             (("rows_a", a), ("rows_b", b), ("rows_aligned", aligned))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(
        *[F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in ("rows_a", "rows_b", "rows_aligned")]
    )


def pearson(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.corr("score_a", "score_b").alias("pearson"))


def spearman(aligned: DataFrame) -> DataFrame:
    """Correlation of the average ranks, from distinct pairs of scores and how often each occurs.

    Ranks are taken from their mean, (rows + 1) / 2, so that no large squares cancel out.
    """
    pairs = materialize(aligned.groupBy("score_a", "score_b").agg(F.count("*").alias("_times")), "score-pairs")

    def ranks(score: str, name: str) -> DataFrame:
        counts = pairs.groupBy(score).agg(F.sum("_times").alias("_times"))
        placed = value_ranks(counts, score, weight="_times")
        return placed.select(score, (F.col("rank") - (F.col("group_rows") + 1) / 2.0).alias(name))

    both = pairs.join(ranks("score_a", "_a"), "score_a").join(ranks("score_b", "_b"), "score_b")
    sums = both.agg(*[F.sum(F.col("_times") * F.col(x) * F.col(y)).alias(x + y) for x, y in (("_a", "_a"), ("_b", "_b"), ("_a", "_b"))])
    return sums.select(F.try_divide(F.col("_a_b"), F.sqrt(F.col("_a_a")) * F.sqrt(F.col("_b_b"))).alias("spearman"))


def top_n_of(aligned: DataFrame, model: str, n: int) -> DataFrame:
    """The n best rows of model `a` or `b`; n is a report size, so this is one bounded top-k."""
    return aligned.orderBy(F.desc_nulls_last(f"score_{model}"), KEY).limit(n)


def top_n_membership(aligned: DataFrame, n: int) -> DataFrame:
    """Rows in either top n, with flags for both. Both inputs have at most n rows."""
    both = (
        top_n_of(aligned, "a", n).withColumn("in_a", F.lit(True)).unionByName(
            top_n_of(aligned, "b", n).withColumn("in_b", F.lit(True)), allowMissingColumns=True
        )
    )
    values = [c for c in both.columns if c not in (KEY, "in_a", "in_b")]
    return both.groupBy(KEY).agg(
        *[F.first(c).alias(c) for c in values],
        F.coalesce(F.max("in_a"), F.lit(False)).alias("in_a"),
        F.coalesce(F.max("in_b"), F.lit(False)).alias("in_b"),
    )


def top_n_overlap(aligned: DataFrame, n: int) -> DataFrame:
    """Keys in both top lists, best average score first."""
    shared = top_n_membership(aligned, n).where(F.col("in_a") & F.col("in_b")).drop("in_a", "in_b")
    return shared.withColumn("avg_score", (F.col("score_a") + F.col("score_b")) / 2.0).orderBy(
        F.desc("avg_score"), KEY
    )


def overlap_counts(aligned: DataFrame, n: int) -> DataFrame:
    """One row: overlap, its share of n, and what only one side has."""
    a, b = F.col("in_a"), F.col("in_b")
    return top_n_membership(aligned, n).agg(
        F.lit(n).alias("top_n"),
        count_if(a & b).alias("overlap_count"),
        (count_if(a & b) / F.lit(float(n)) if n > 0 else F.lit(0.0)).alias("overlap_ratio"),
        count_if(a & ~b).alias("a_only_count"),
        count_if(b & ~a).alias("b_only_count"),
    )


def only_in_top(aligned: DataFrame, model: str, n: int) -> DataFrame:
    """Rows in the top n of one model and not of the other."""
    other = "b" if model == "a" else "a"
    rows = top_n_membership(aligned, n).where(F.col(f"in_{model}") & ~F.col(f"in_{other}"))
    return rows.drop("in_a", "in_b").orderBy(F.desc(f"score_{model}"), KEY)


def with_delta(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("delta", F.col("score_a") - F.col("score_b"))


def disagreement(aligned: DataFrame, n: int) -> DataFrame:
    """The n rows that a scores most above b, and the n most below."""
    rows = with_delta(aligned)
    above = rows.orderBy(F.desc("delta"), KEY).limit(n).withColumn("side", F.lit("a_more_bullish"))
    below = rows.orderBy(F.asc("delta"), KEY).limit(n).withColumn("side", F.lit("b_more_bullish"))
    return above.unionByName(below)


def label_mismatches(aligned: DataFrame) -> DataFrame:
    differ = F.col("y_true_a") != F.col("y_true_b")
    return aligned.agg(count_if(differ).alias("label_mismatch_count"))


def with_classes(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows with truth and both classes: the given class where there is one, else by threshold."""
    classes = {}
    for m in ("a", "b"):
        given = F.col(f"y_pred_{m}") if f"y_pred_{m}" in aligned.columns else F.col(f"score_{m}") >= threshold
        classes[f"y_pred_{m}"] = given.cast("int")
    out = aligned.withColumns(classes).withColumn("y_true", F.col("y_true_a").cast("int"))
    return out.where(
        F.col("y_true").isNotNull() & F.col("y_pred_a").isNotNull() & F.col("y_pred_b").isNotNull()
    )


def error_kind(model: str) -> Column:
    truth, guess = F.col("y_true"), F.col(f"y_pred_{model}")
    return F.when((truth == 0) & (guess == 1), "false_positive").when((truth == 1) & (guess == 0), "false_negative")


def worst_errors(aligned: DataFrame, model: str, kind: str, n: int, threshold: float = 0.5) -> DataFrame:
    """The n most confident errors of one kind."""
    rows = with_classes(aligned, threshold).where(holds(error_kind(model) == kind))
    order = F.desc if kind == "false_positive" else F.asc
    return rows.orderBy(order(f"score_{model}"), KEY).limit(n)


def misclassified(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows that one or both models get wrong, with `wrong`: both, only_a or only_b."""
    rows = with_classes(aligned, threshold)
    a, b = F.col("y_pred_a") != F.col("y_true"), F.col("y_pred_b") != F.col("y_true")
    kind = F.when(a & b, "both").when(a, "only_a").when(b, "only_b")
    return rows.withColumn("wrong", kind).where(F.col("wrong").isNotNull())


def model_metrics(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per model: rates and AUC against the truth of set a."""
    out = None
    for m in ("a", "b"):
        rows = aligned.select(KEY, F.col("y_true_a").alias("y_true"), F.col(f"score_{m}").alias("y_score"))
        row = binary_metrics(rows, threshold).withColumn("model", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out


def metric_winner(metrics: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """Per metric the better model; a missing value loses, equal values tie."""
    names = ["accuracy", "f1", "auc"]

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(name)))

    pairs = metrics.agg(
        *[of(m, n).alias(f"{n}_{m}") for n in names for m in ("a", "b")]
    )

    def winner(n: str) -> Column:
        a, b = F.coalesce(F.col(f"{n}_a"), F.lit(-1.0)), F.coalesce(F.col(f"{n}_b"), F.lit(-1.0))
        return F.when(a > b, name_a).when(b > a, name_b).otherwise("tie")

    return pairs.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), winner(n).alias("winner")) for n in names]))
    )


def label_wise_scores(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per model: mean score of either class and the gap."""
    rows = with_classes(aligned, threshold)
    means = rows.agg(
        *[
            F.avg(F.when(F.col("y_true") == y, F.col(f"score_{m}"))).alias(f"{m}{y}")
            for m in ("a", "b")
            for y in (0, 1)
        ]
    )
    parts = [
        F.struct(
            F.lit(m).alias("model"),
            F.col(f"{m}1").alias("positive_mean_score"),
            F.col(f"{m}0").alias("negative_mean_score"),
            (F.col(f"{m}1") - F.col(f"{m}0")).alias("pos_neg_gap"),
        )
        for m in ("a", "b")
    ]
    return means.select(F.inline(F.array(*parts)))


# The key sets that future returns are summarised for.
BUCKETS = ["topN_a", "topN_b", "overlap_topN", "a_only_topN", "b_only_topN"]


def future_return_buckets(aligned: DataFrame, future: DataFrame, n: int) -> DataFrame:
    """Count, mean, median and deviation of the future return in each of the five key sets.

    The key sets are at most five lists of n keys, a size set by the caller and not by the
    data; the join carries no hint, so their measured size decides how it is done.
    """
    a, b = F.col("in_a"), F.col("in_b")
    tests = dict(zip(BUCKETS, [a, b, a & b, a & ~b, b & ~a]))
    names = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    members = top_n_membership(aligned, n).select(KEY, F.explode(names).alias("bucket"))
    # the key is that of the alignment, whatever else the returns carry
    keys = [SAMPLE] if SAMPLE in aligned.columns else [SYMBOL, ASOF]
    missing = [k for k in keys if k not in future.columns]
    if missing:
        raise KeyError(f"future returns lack the key of the alignment: {missing}")
    returns = future.select(
        join_key(future.select(*keys)).alias(KEY), to_number("future_return").alias("future_return")
    ).where(F.col("future_return").isNotNull())
    # at most n keys a bucket, so an exact percentile fits one buffer
    found = members.join(returns, KEY)
    stats = found.groupBy("bucket").agg(
        F.count("*").alias("count"),
        F.avg("future_return").alias("mean"),
        F.percentile("future_return", 0.5).alias("median"),
        F.stddev_pop("future_return").alias("std"),
    )
    spark = aligned.sparkSession
    buckets = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in BUCKETS])).alias("bucket"))
    return (
        buckets.join(stats, "bucket", "left")
        .select("bucket", F.coalesce("count", F.lit(0)).alias("count"), "mean", "median", "std")
    )


@dataclass(frozen=True)
class Comparison:
    """The sections of a comparison, each its own frame, evaluated when read."""

    sections: dict[str, DataFrame]


def compare_predictions(
    a: DataFrame,
    b: DataFrame,
    top_n: int = 50,
    threshold: float = 0.5,
    future: DataFrame | None = None,
    score_a: str | None = None,
    score_b: str | None = None,
) -> Comparison:
    """All sections of a comparison; validation sections where the truth is known."""
    aligned = materialize(align_predictions(a, b, score_a, score_b), "aligned")
    if aligned.isEmpty():
        raise ValueError("the two prediction sets share no key with both scores")
    scores = aligned.unpivot(KEY, ["score_a", "score_b"], "model", "y_score")
    sections = {
        "basic_info": alignment_info(a, b, aligned),
        "score_distribution": score_summary(scores, group=["model"]),
        "pearson": pearson(aligned),
        "spearman": spearman(aligned),
        "top_n_overlap": overlap_counts(aligned, top_n),
        "consensus_top": top_n_overlap(aligned, top_n),
        "top_a": top_n_of(aligned, "a", top_n),
        "top_b": top_n_of(aligned, "b", top_n),
        "only_in_top_a": only_in_top(aligned, "a", top_n),
        "only_in_top_b": only_in_top(aligned, "b", top_n),
        "disagreement": disagreement(aligned, top_n),
    }
    if prediction_mode(a) == "validation":
        metrics = model_metrics(aligned, threshold)
        sections |= {
            "label_mismatch": label_mismatches(aligned),
            "metrics": metrics,
            "metric_winner": metric_winner(metrics),
            "misclassified": misclassified(aligned, threshold),
            "label_wise_scores": label_wise_scores(aligned, threshold),
        }
        for m in ("a", "b"):
            for kind in ("false_positive", "false_negative"):
                sections[f"{kind}_{m}"] = worst_errors(aligned, m, kind, top_n, threshold)
    if future is not None:
        sections["future_return_buckets"] = future_return_buckets(aligned, future, top_n)
    return Comparison(sections)
