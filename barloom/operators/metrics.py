"""Metrics and summaries of prediction sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import count_if, ratio_or_zero, to_number
from barloom.functions.ordering import value_ranks
from barloom.functions.selection import quantiles
from barloom.schema import SAMPLE

# The quantiles of a score summary.
SCORE_QUANTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99}


def score_column(predictions: DataFrame, explicit: str | None = None) -> str:
    if explicit:
        if explicit not in predictions.columns:
            raise KeyError(f"requested score column not found: {explicit}")
        return explicit
    for name in ("y_score", "score"):
        if name in predictions.columns:
            return name
    raise KeyError("cannot detect the score column, expected y_score or score")


def prediction_mode(predictions: DataFrame) -> str:
    return "validation" if "y_true" in predictions.columns else "scan"


def with_prediction(
    predictions: DataFrame, threshold: float = 0.5, score: str = "y_score", use_given: bool = False
) -> DataFrame:
    """Numeric truth and score, and a predicted class: the given one or score >= threshold."""
    out = predictions.withColumns({"y_true": to_number("y_true"), score: to_number(score)})
    if use_given and "y_pred" in predictions.columns:
        return out.withColumn("y_pred", to_number("y_pred").cast("int"))
    return out.withColumn("y_pred", (F.col(score) >= threshold).cast("int"))


def confusion_metrics(
    predictions: DataFrame,
    threshold: float = 0.5,
    score: str = "y_score",
    group: Sequence[str] = (),
    use_given: bool = False,
) -> DataFrame:
    """Counts, accuracy, precision, recall and f1; a rate without cases is 0."""
    rows = with_prediction(predictions, threshold, score, use_given).where(
        F.col("y_true").isNotNull() & F.col(score).isNotNull() & F.col("y_pred").isNotNull()
    )
    truth, guess = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        count_if(truth & guess).alias("tp"),
        count_if(~truth & guess).alias("fp"),
        count_if(truth & ~guess).alias("fn"),
        count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio_or_zero(tp + tn, F.col("n")),
            "precision": ratio_or_zero(tp, tp + fp),
            "recall": ratio_or_zero(tp, tp + fn),
            "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def roc_auc(predictions: DataFrame, score: str = "y_score", group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums over the distinct scores; ties count half, NULL with one class."""
    rows = predictions.select(*group, to_number("y_true").alias("y_true"), to_number(score).alias("_score")).where(
        F.col("y_true").isNotNull() & F.col("_score").isNotNull()
    )
    by_score = value_ranks(rows, "_score", group, _pos=F.sum("y_true"))
    sums = by_score.groupBy(*group).agg(
        F.sum("_pos").alias("_p"),
        F.sum(F.col("n") - F.col("_pos")).alias("_q"),
        F.sum(F.col("_pos") * F.col("rank")).alias("_ranks"),
    )
    auc = F.try_divide(F.col("_ranks") - F.col("_p") * (F.col("_p") + 1) / 2.0, F.col("_p") * F.col("_q"))
    return sums.select(*group, auc.alias("auc"))


def binary_metrics(
    predictions: DataFrame, threshold: float = 0.5, score: str = "y_score", use_given: bool = False
) -> DataFrame:
    """One row with the rates and the AUC."""
    named = predictions.withColumn("_all", F.lit(1))
    rates = confusion_metrics(named, threshold, score, ["_all"], use_given)
    return rates.join(roc_auc(named, score, ["_all"]), "_all", "left").drop("_all")


def score_summary(predictions: DataFrame, score: str = "y_score", group: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, range and exact quantiles of a score."""
    groups = list(group) or ["_all"]
    named = predictions if group else predictions.withColumn("_all", F.lit(1))
    rows = named.select(*groups, to_number(score).alias("_v"))
    moments = {"mean": F.avg("_v"), "std": F.stddev_pop("_v"), "min": F.min("_v"), "max": F.max("_v")}
    out = quantiles(rows, "_v", SCORE_QUANTILES, groups, moments)
    return out if group else out.drop("_all")


def label_score_means(predictions: DataFrame, score: str = "y_score", group: Sequence[str] = ()) -> DataFrame:
    """Mean score of either class, and the gap between them."""
    truth, value = to_number("y_true"), to_number(score)
    return (
        predictions.groupBy(*group)
        .agg(
            F.avg(F.when(truth == 1, value)).alias("positive_mean_score"),
            F.avg(F.when(truth == 0, value)).alias("negative_mean_score"),
        )
        .withColumn("pos_neg_gap", F.col("positive_mean_score") - F.col("negative_mean_score"))
    )


def error_rows(
    predictions: DataFrame,
    kind: str,
    n: int,
    threshold: float = 0.5,
    score: str = "y_score",
    use_given: bool = True,
) -> DataFrame:
    """The n most confident errors of one kind: `false_positive` or `false_negative`."""
    rows = with_prediction(predictions, threshold, score, use_given)
    if kind == "false_positive":
        wrong = rows.where((F.col("y_true") == 0) & (F.col("y_pred") == 1))
        return wrong.orderBy(F.desc_nulls_last(score), SAMPLE).limit(n)
    wrong = rows.where((F.col("y_true") == 1) & (F.col("y_pred") == 0))
    return wrong.orderBy(F.asc_nulls_last(score), SAMPLE).limit(n)
