"""End-to-end jobs: check, build, train, scan, compare."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import merge_rows, rename_aliases, sample_id, to_date
from barloom.operators.dataset import Dataset, build_samples, check_skip_limit, dataset_parts, prepare_labels
from barloom.operators.features import latest_features
from barloom.operators.metrics import binary_metrics
from barloom.operators.models import load_model, save_model, score, train_model
from barloom.operators.normalize import SOURCE_UNITS, BarUnits, normalize_bars
from barloom.operators.profile import dataset_snapshot
from barloom.operators.quality import (
    alignment_counts,
    keep_sound_symbols,
    label_alignment,
    raise_unless_ok,
    validate_labels,
)
from barloom.operators.ranking import intersect_models, latest_asof, sort_by_score
from barloom.operators.splits import infer_split_method, training_roles
from barloom.schema import ASOF, DATE, FEATURES, LABEL_ALIASES, SAMPLE, SYMBOL
from barloom.session import materialize
from barloom.sources.readers import read_bars, read_dataset, read_labels
from barloom.sources.writers import (
    append_experiment,
    dated_path,
    write_dataset,
    write_predictions,
    write_report,
    write_sequences,
)


def check_inputs(labels: DataFrame, bars: DataFrame, min_history: int = 80) -> DataFrame:
    """The strict precheck of a build: labels must be valid, then alignment is counted.

    Symbols with faulty bars count as missing here, where a single-symbol job would stop.
    """
    labels = rename_aliases(labels, LABEL_ALIASES)
    raise_unless_ok(validate_labels(labels, require_sample_id=False), "label check")
    return alignment_counts(label_alignment(prepare_labels(labels, keep_unnamed=True), keep_sound_symbols(bars), min_history))


def run_build(
    spark: SparkSession,
    labels_path: str,
    bars_path: str,
    output: str,
    window_size: int = 120,
    min_history: int = 80,
    split_method: str = "time",
    units: BarUnits = SOURCE_UNITS,
    duplicate_policy: str = "raise",
    save_sequence: bool = True,
    max_skip_ratio: float | None = None,
    precheck: bool = True,
    **split: float | int,
) -> dict[str, object]:
    """Read, check, build and write a dataset; returns the paths and the counts."""
    labels = rename_aliases(read_labels(spark, labels_path), LABEL_ALIASES)
    bars = normalize_bars(read_bars(spark, bars_path), units, duplicate_policy)
    if precheck:
        raise_unless_ok(check_inputs(labels, bars, min_history), "data precheck")
    raise_unless_ok(validate_labels(labels, require_sample_id=False), "label check")
    bars = materialize(bars, "bars")  # precheck, samples and sequences read them
    # windows and as-of join run once: the report, the samples and the sequences read what they gave
    rows = materialize(build_samples(labels, bars, window_size, min_history, split_method, **split), "built")
    built: Dataset = dataset_parts(rows, bars, window_size, save_sequence)
    check_skip_limit(built.report, max_skip_ratio)
    paths = {"samples": f"{output}/samples"}
    write_dataset(built.samples, paths["samples"])
    if built.sequences is not None:
        paths["sequences"] = f"{output}/sequences"
        write_sequences(built.sequences, paths["sequences"])
    return paths | built.report.first().asDict()


@dataclass(frozen=True)
class Training:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame


def train_and_validate(
    samples: DataFrame, name: str = "logistic_regression", threshold: float = 0.5, **params: object
) -> Training:
    """Fit on train, score the validation rows, and measure them at one threshold."""
    rows = training_roles(samples)
    model = train_model(rows.where(F.col("role") == "train"), name, **params)
    scored = score(model, rows.where(F.col("role") == "valid"), output="y_score")
    predictions = scored.select(
        SAMPLE,
        F.col("label").alias("y_true"),
        "y_score",
        (F.col("y_score") >= threshold).cast("int").alias("y_pred"),
    )
    return Training(model, predictions, binary_metrics(predictions, threshold))


def experiment_row(samples: DataFrame, metrics: DataFrame, split_method: str | None = None, **facts: str) -> DataFrame:
    """The experiment-log row of a training run; `facts` fill columns that are not measured."""
    now = datetime.now(timezone.utc)
    snapshot = dataset_snapshot(samples).select("n_train", "n_valid", "n_test", "label_source")
    rates = metrics.select("accuracy", "precision", "recall", "f1", "auc")
    row = merge_rows(snapshot, rates, infer_split_method(samples).select("split_method"))
    if split_method:
        row = row.withColumn("split_method", F.lit(split_method))
    stem = facts.get("train_config_path", "run").rpartition("/")[2].rpartition(".")[0] or "run"
    return row.withColumns(
        {
            "exp_id": F.lit(f"{now:%Y%m%d_%H%M%S}_{stem}"),
            "created_at": F.lit(f"{now:%Y-%m-%d %H:%M:%S}"),
            "n_features": F.lit(len(FEATURES)),
            **{k: F.lit(v) for k, v in facts.items()},
        }
    )


def run_training(
    spark: SparkSession,
    dataset_path: str,
    output: str,
    name: str = "logistic_regression",
    threshold: float = 0.5,
    experiments: str | None = None,
    split_method: str | None = None,
    facts: dict[str, str] | None = None,
    **params: object,
) -> Training:
    """Train, write model and predictions, and log the run.

    `split_method` is the configured one, logged before one inferred from the rows; `facts` fill further
    columns of the log, such as the data set's name and the paths of the configuration.
    """
    samples = read_dataset(spark, dataset_path)
    result = train_and_validate(samples, name, threshold, **params)
    save_model(result.model, f"{output}/model")
    write_predictions(result.predictions, f"{output}/valid_predictions")
    if experiments:
        known = {"model_name": name, "model_output_dir": output, **(facts or {})}
        row = experiment_row(samples, result.metrics, split_method, **known)
        append_experiment(row, experiments)
    return result


def scan_features(bars: DataFrame, window_size: int = 120, min_history: int = 160) -> DataFrame:
    """The latest window of every symbol, ready to be scored by any number of models."""
    return latest_features(bars, window_size, min_history).withColumn(SAMPLE, sample_id())


def scan_skips(bars: DataFrame, window_size: int = 120, min_history: int = 160, duplicate_policy: str = "raise") -> DataFrame:
    """Symbols that a scan of these bars leaves out, each with its first reason that applies."""
    dated = bars.withColumn(DATE, to_date(DATE, bars.schema[DATE].dataType))
    counts = dated.groupBy(SYMBOL, DATE).agg(F.count("*").alias("_copies")).groupBy(SYMBOL).agg(
        F.count(DATE).alias("num_dates"), F.max(F.when(F.col(DATE).isNotNull(), F.col("_copies"))).alias("_worst")
    )
    reason = F.when(F.col("num_dates") == 0, "no_valid_date")
    if duplicate_policy == "raise":
        reason = reason.when(F.col("_worst") > 1, "duplicate_dates")
    reason = reason.when(F.col("num_dates") < max(window_size, min_history), "insufficient_history")
    return counts.select(SYMBOL, "num_dates", reason.alias("reason")).where(F.col("reason").isNotNull())


def skips_path(output: str) -> str:
    """Where a scan that names no place reports the symbols it left out."""
    folder, slash, name = output.rpartition("/")
    return f"{folder}{slash}skips_{name.rpartition('.')[0] or name}.json"


def scan(model: PipelineModel, features: DataFrame) -> DataFrame:
    return sort_by_score(score(model, features).select(SAMPLE, SYMBOL, ASOF, "score"))


def run_scan(
    spark: SparkSession,
    bars_path: str,
    model_path: str,
    output: str,
    window_size: int = 120,
    min_history: int = 160,
    units: BarUnits = SOURCE_UNITS,
    duplicate_policy: str = "raise",
    skips: str | None = None,
) -> DataFrame:
    """Score the latest window of every symbol and write it.

    Symbols left out are written first, each with its reason, to `skips` or else beside the output.
    """
    raw = read_bars(spark, bars_path)
    write_report(scan_skips(raw, window_size, min_history, duplicate_policy), skips or skips_path(output))
    bars = normalize_bars(raw, units, duplicate_policy)
    features = scan_features(bars, window_size, min_history)
    scored = score(load_model(model_path), features).select(SAMPLE, SYMBOL, ASOF, "score")
    found = materialize(scored, "scan")
    newest = latest_asof(found).first()["latest_asof_date"]
    if newest is None:
        raise ValueError("no symbol has enough bars to be scored")
    write_predictions(found, dated_path(output, str(newest)))
    return sort_by_score(found)


def scan_intersection(models: dict[str, PipelineModel], bars: DataFrame, top_n: int = 200, **window: int) -> DataFrame:
    """Score the same features with every model and rank the candidates they share."""
    features = materialize(scan_features(bars, **window), "scan-features")
    return intersect_models({m: scan(model, features) for m, model in models.items()}, top_n)


def run_scan_intersection(
    spark: SparkSession,
    bars_path: str,
    model_paths: dict[str, str],
    output: str,
    top_n: int = 200,
    units: BarUnits = SOURCE_UNITS,
    duplicate_policy: str = "raise",
    skips: str | None = None,
    **window: int,
) -> DataFrame:
    """Scan with several saved models and write the candidates they share, dated by the newest window.

    Symbols left out are reported as by `run_scan`.
    """
    raw = read_bars(spark, bars_path)
    write_report(scan_skips(raw, duplicate_policy=duplicate_policy, **window), skips or skips_path(output))
    bars = normalize_bars(raw, units, duplicate_policy)
    models = {name: load_model(path) for name, path in model_paths.items()}
    found = materialize(scan_intersection(models, bars, top_n, **window), "intersection")
    newest = latest_asof(found).first()["latest_asof_date"]
    if newest is None:
        raise ValueError("the models share no candidate")
    write_predictions(found, dated_path(output, str(newest)), "score_mean")
    return found.orderBy(F.desc("score_mean"), F.desc("score_min"), F.asc("rank_sum"), SAMPLE)
