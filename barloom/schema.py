"""Column contracts of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOL = "ts_code"
DATE = "trade_date"
ASOF = "asof_date"
SAMPLE = "sample_id"
FILE = "_file"  # source file of a bar; files come in the order of their paths
ORDER = "_ord"  # position of a bar in its source file

# The columns of bars and labels.
PRICES = ["open", "high", "low", "close"]
REQUIRED_BAR_COLUMNS = [DATE, *PRICES, "vol"]
OPTIONAL_BAR_COLUMNS = ["amount", "turnover_rate", "pct_chg"]
NORMALIZED_NUMBERS = [*PRICES, "vol", "amount", "pct_chg"]

REQUIRED_LABEL_COLUMNS = [SYMBOL, ASOF, "label"]
RECOMMENDED_LABEL_COLUMNS = [SAMPLE, "label_source", "confidence"]

# Names under which a label column may arrive, best first.
LABEL_ALIASES = {
    "ts_code": ["ts_code", "code", "ticker"],
    "asof_date": ["asof_date", "trade_date", "date"],
    "label": ["label", "y", "target"],
}

# The features of one window, in model order.
FEATURES = [
    "base_range_pct",
    "base_vol_cv",
    "vol_shrink_ratio",
    "recent_return_5",
    "recent_return_10",
    "breakout_distance_20",
    "breakout_distance_60",
    "volume_spike_ratio",
    "above_ma10_ratio",
    "above_ma20_ratio",
    "volatility_20",
]

# What is known of a sample beside its features.
SAMPLE_META = T.StructType(
    [
        T.StructField(SAMPLE, T.StringType()),
        T.StructField(SYMBOL, T.StringType()),
        T.StructField(ASOF, T.DateType()),
        T.StructField("window_start", T.DateType()),
        T.StructField("window_end", T.DateType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("split", T.StringType()),
    ]
)

# One row per training run.
EXPERIMENT_SUMMARY = T.StructType(
    [
        T.StructField("exp_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("data_config_path", T.StringType()),
        T.StructField("train_config_path", T.StringType()),
        T.StructField("label_source", T.StringType()),
        T.StructField("split_method", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("model_output_dir", T.StringType()),
        T.StructField("experiment_dir", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("python_version", T.StringType()),
    ]
)
