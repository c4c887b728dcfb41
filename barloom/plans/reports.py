"""Reports as named sections; a section is a frame that is evaluated when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics, profile, quality
from barloom.operators.ranking import bottom_scores, top_scores
from barloom.schema import FEATURES, RECOMMENDED_LABEL_COLUMNS
from barloom.sources.writers import write_report


def inspect_dataset(meta: DataFrame, features: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Shape, labels, splits, missing values and spread of a dataset."""
    columns = [c for c in FEATURES if c in features.columns]
    if not columns:
        raise ValueError("the features have no feature columns")
    shape = profile.shape_check(meta, features)
    if not shape.first()["is_consistent"]:
        raise ValueError("metadata and features differ in their number of rows")
    return {
        "shape_check": shape,
        "label_distribution": quality.label_distribution(meta),
        "label_profile": profile.label_profile(meta),
        "split_distribution": profile.split_label_counts(meta),
        "missingness": profile.missingness(features, columns),
        "top_missing": profile.top_missing(features, top_n, columns),
        "global_missingness": profile.global_missingness(features, columns),
        "constant_columns": profile.feature_spread(features, columns).where("is_constant"),
        "top_low_variance": profile.low_variance(features, top_n, columns),
        "numeric_summary": profile.numeric_summary(features, columns),
    }


def inspect_predictions(
    predictions: DataFrame, top_n: int = 20, threshold: float = 0.5, score: str | None = None
) -> dict[str, DataFrame]:
    """Distribution and extremes of one prediction set, and its errors where the truth is known."""
    name = metrics.score_column(predictions, score)
    sections = {
        "basic_info": predictions.agg(F.count("*").alias("num_rows")).withColumns(
            {"mode": F.lit(metrics.prediction_mode(predictions)), "score_column": F.lit(name)}
        ),
        "score_distribution": metrics.score_summary(predictions, name),
        "top_high_score": top_scores(predictions, top_n, name),
        "top_low_score": bottom_scores(predictions, top_n, name),
    }
    if metrics.prediction_mode(predictions) == "validation":
        sections |= {
            "validation_metrics": metrics.binary_metrics(predictions, threshold, name, use_given=True),
            "label_score_mean": metrics.label_score_means(predictions, name),
            "false_positives": metrics.error_rows(predictions, "false_positive", top_n, threshold, name),
            "false_negatives": metrics.error_rows(predictions, "false_negative", top_n, threshold, name),
        }
    return sections


def check_contract(labels: DataFrame, bars: DataFrame, min_history: int = 80) -> dict[str, DataFrame]:
    """The lenient contract check: statistics, issues by severity, and the verdict."""
    findings = quality.contract_findings(labels, bars, min_history)
    present = [c in labels.columns for c in RECOMMENDED_LABEL_COLUMNS]
    return {
        "recommended_columns": labels.sparkSession.createDataFrame(
            list(zip(RECOMMENDED_LABEL_COLUMNS, present)), "column string, present boolean"
        ),
        "daily_directory": quality.universe_summary(bars),
        "label_contract": quality.label_contract(labels),
        "label_distribution": quality.label_distribution(labels),
        "inconsistent_sample_ids": quality.inconsistent_sample_ids(labels),
        "alignment": quality.contract_alignment(labels, bars, min_history),
        "findings": findings,
        "verdict": quality.contract_verdict(findings),
    }


def save_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section."""
    for name, section in sections.items():
        write_report(section, f"{path}/{name}")
