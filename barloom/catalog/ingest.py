"""Queries over sources, sinks, normalisation and label preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived, labelled_windows, model_predictions, of_model, predictions, scored_windows
from barloom.catalog.oracle import r, r_all, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import rounded
from barloom.functions.columns import join_key
from barloom.operators.dataset import build_samples, dataset_rows, prepare_labels
from barloom.operators.metrics import confusion_metrics
from barloom.operators.models import fill_features
from barloom.operators.normalize import CONTRACT_UNITS, BarUnits, coerce_bars, duplicate_dates, normalize_bars
from barloom.operators.screener import ScreenRules, bars_in_range, price_ok
from barloom.operators.features import latest_bars
from barloom.plans.jobs import experiment_row, scan_features
from barloom.schema import FEATURES
from barloom.session import discard, materialize, rewrite, scratch_path
from barloom.sources import readers, writers

NUMBERS = ["open", "high", "low", "close", "vol", "amount"]
BAR_SQL = f"select ts_code, trade_date, {r_all(NUMBERS)} from price_bars"


@query("bars_write_and_read", sql(BAR_SQL))
def bars_write_and_read(spark, sf):
    path = scratch_path(spark, "bars")
    writers.write_bars(derived(spark, sf, "price_bars"), path)
    return rounded(readers.read_bars(spark, path).select("ts_code", "trade_date", *NUMBERS))


def _in_four_layouts(bars, path):
    """Four folders below `path` by symbol: text, eight-digit, date and nanosecond dates; two lack the amount."""
    day = F.col("trade_date")
    nanos = F.unix_date(day).cast("bigint") * 86_400_000_000_000
    layouts = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd").cast("int"), day, nanos]
    for k, date in enumerate(layouts):
        part = bars.where(F.substring("ts_code", -1, 1).cast("int") % 4 == k).withColumn("trade_date", date)
        if k % 2:
            part = part.drop("amount")
        part.write.parquet(f"{path}/{k}")
    return f"{path}/*"


@query(
    "bars_of_mixed_files",
    sql(
        f"select ts_code, trade_date, {r_all(NUMBERS[:-1])}, "
        + r("case when cast(right(ts_code, 1) as int) % 4 % 2 = 0 then amount end", "amount")
        + " from price_bars"
    ),
)
def bars_of_mixed_files(spark, sf):
    """One read of files whose columns and date types differ."""
    files = _in_four_layouts(derived(spark, sf, "price_bars"), scratch_path(spark, "mixed-bars"))
    return rounded(readers.read_bars(spark, files).select("ts_code", "trade_date", *NUMBERS))


@query(
    "labels_csv",
    sql("select sample_id, ts_code, asof_date, cast(label as double) as label, label_source, confidence from bar_labels"),
)
def labels_csv(spark, sf):
    path = scratch_path(spark, "labels")
    derived(spark, sf, "bar_labels").drop("future_return").write.option("header", True).csv(path)
    labels = readers.read_labels(spark, path)
    return labels.select("sample_id", "ts_code", "asof_date", "label", "label_source", "confidence")


@query(
    "predictions_csv",
    sql("select sample_id, ts_code, asof_date, cast(y_true as double) as y_true, score_a as y_score from preds"),
)
def predictions_csv(spark, sf):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(model_predictions(spark, sf, "a"), path)
    found = readers.read_predictions(spark, path)
    return found.select("sample_id", "ts_code", "asof_date", "y_true", "y_score")


@query(
    "future_returns_csv",
    sql(
        f"""select sample_id, ts_code, asof_date,
        {r('case when cast(substr(ts_code, 2) as bigint) % 7 <> 2 then future_return end', 'future_return')} from bar_labels"""
    ),
)
def future_returns_csv(spark, sf):
    """Returns from a file with eight-digit dates, in which some are no numbers."""
    path = scratch_path(spark, "returns")
    known = F.substring("ts_code", 2, 99).cast("bigint") % 7 != 2
    rows = derived(spark, sf, "bar_labels").select(
        "sample_id",
        "ts_code",
        F.date_format("asof_date", "yyyyMMdd").alias("asof_date"),
        F.when(known, F.col("future_return").cast("string")).otherwise("n/a").alias("future_return"),
    )
    rows.write.option("header", True).csv(path)
    return rounded(readers.read_future_returns(spark, path))


@query(
    "scan_csv_by_date",
    sql(
        f"""select concat(ts_code, '_', cast(trade_date as string)) as sample_id, ts_code, trade_date as asof_date,
        {r('volatility_20', 'score')} from price_features
        where rn >= 160 and trade_date = (select max(trade_date) from price_bars p where p.ts_code = price_features.ts_code)"""
    ),
)
def scan_csv_by_date(spark, sf):
    """A feature stands in for the model score."""
    path = scratch_path(spark, "scan")
    found = scan_features(derived(spark, sf, "price_bars"), 120, 160)
    scores = found.select("sample_id", "ts_code", "asof_date", F.col("volatility_20").alias("score"))
    writers.write_predictions(scores, path)
    again = readers.read_predictions(spark, path)
    return rounded(again.select("sample_id", "ts_code", F.col("asof_date").cast("date"), "score"))


TIME_SPLIT_SQL = """
select asof_date, case when n < 3 then 'train' when rn <= n_train then 'train'
                       when rn <= n_train + n_valid then 'valid' else 'test' end as split
from (select *, least(n - n_train - 1, greatest(1, floor(n * 0.15e0))) as n_valid
      from (select *, least(n - 2, greatest(1, floor(n * 0.7e0))) as n_train
            from (select asof_date, row_number() over (order by asof_date) as rn, count(*) over () as n
                  from (select distinct asof_date from bar_labels) a) b) c) d
"""


@query(
    "dataset_write_and_read",
    sql(
        f"""select w.sample_id, s.split, w.label, w.window_start, w.trade_date as window_end, {r_all(FEATURES, 'w.')}
        from windows w join splits s on w.asof_date = s.asof_date where rn >= 120""",
        splits=TIME_SPLIT_SQL,
    ),
)
def dataset_write_and_read(spark, sf):
    path = scratch_path(spark, "dataset")
    built, folder = rewrite(dataset_rows(labelled_windows(spark, sf)), "built")  # as `run_build` does
    writers.write_dataset(built, path)
    discard(spark, folder)
    rows = readers.read_dataset(spark, path)
    return rounded(rows.select("sample_id", "split", "label", "window_start", "window_end", *FEATURES))


@query(
    "report_json",
    sql(
        """select model, count(*) as n, """ + r("sum(case when (y_score >= 0.5) = (y_true = 1) then 1.0e0 else 0 end) / count(*)", "accuracy") + """ from long_preds group by model"""
    ),
)
def report_json(spark, sf):
    path = scratch_path(spark, "report")
    scored = predictions(spark, sf)
    for_model = lambda m: of_model(scored, m).withColumn("model", F.lit(m))
    both = for_model("a").unionByName(for_model("b"))
    writers.write_report(confusion_metrics(both, group=["model"]), path)
    return rounded(readers.read_report(spark, path).select("model", "n", "accuracy"))


@query(
    "experiment_append",
    sql(
        """select 'demo' as model_name, sum(case when s.split = 'train' then 1 else 0 end)::bigint as n_train,
        sum(case when s.split = 'valid' then 1 else 0 end)::bigint as n_valid,
        sum(case when s.split = 'test' then 1 else 0 end)::bigint as n_test,
        11::bigint as n_features, 'derived' as label_source, 'time_by_asof_date' as split_method
        from windows w join splits s on w.asof_date = s.asof_date where rn >= 120""",
        splits=TIME_SPLIT_SQL,
    ),
)
def experiment_append(spark, sf):
    path = scratch_path(spark, "experiments")
    windows = materialize(labelled_windows(spark, sf), "windows")  # the row of the log is three aggregates of them
    samples = dataset_rows(windows)
    rates = confusion_metrics(of_model(scored_windows(windows), "a")).withColumn("auc", F.lit(None).cast("double"))
    writers.append_experiment(experiment_row(samples, rates, model_name="demo"), path)
    columns = ["model_name", "n_train", "n_valid", "n_test", "n_features", "label_source", "split_method"]
    return spark.read.parquet(path).select(*columns)


DATED = "select * from bad_bars where trade_date is not null"


def _norm(vol: float, amount: float) -> str:
    named = {c: f"b.{c}" for c in NUMBERS}
    named["vol"], named["amount"] = f"b.vol * {vol}", f"b.amount * {amount}"
    return "b.ts_code, b.trade_date, " + ", ".join(r(e, c) for c, e in named.items())


@query("coerce_bars", sql(f"select {_norm(1, 1)}, _ord from bad_bars b where trade_date is not null"))
def coerced(spark, sf):
    """Numbers and dates arrive as text here, as from a text export."""
    text = derived(spark, sf, "bad_bars")
    text = text.withColumns({c: F.col(c).cast("string") for c in ["trade_date", *NUMBERS]}).withColumn(
        "extra_col", F.lit("x")
    )
    return rounded(coerce_bars(text))


def _edge(pick: str) -> str:
    order = "asc" if pick == "first" else "desc"
    return f"""select {_norm(100, 1000)} from (
      select *, row_number() over (partition by ts_code, trade_date order by _ord {order}) as place
      from bad_bars where trade_date is not null) b where place = 1"""


@query("duplicates_keep_first", sql(_edge("first")))
def keep_first(spark, sf):
    return rounded(normalize_bars(derived(spark, sf, "bad_bars"), duplicate_policy="first"))


@query("duplicates_keep_last", sql(_edge("last")))
def keep_last(spark, sf):
    return rounded(normalize_bars(derived(spark, sf, "bad_bars"), duplicate_policy="last"))


@query(
    "duplicates_over_files",
    sql(
        f"""select {_norm(100, 1000)} from (
          select *, row_number() over (partition by ts_code, trade_date order by later desc) as place from (
            select *, 0 as later from price_bars
            union all select ts_code, trade_date, open, high, low, (close + low) / 2, vol, amount, 1 from price_bars
            where day(trade_date) % 3 = 0) c) b where place = 1"""
    ),
)
def duplicates_over_files(spark, sf):
    """A later folder corrects every third day; the bar of the last file counts, whatever its values."""
    path = scratch_path(spark, "corrected-bars")
    bars = materialize(derived(spark, sf, "price_bars"), "price-bars")
    bars.write.parquet(f"{path}/0")
    corrected = bars.where(F.day("trade_date") % 3 == 0).withColumn("close", (F.col("close") + F.col("low")) / 2)
    corrected.write.parquet(f"{path}/1")
    return rounded(normalize_bars(readers.read_bars(spark, f"{path}/*"), duplicate_policy="last").select("ts_code", "trade_date", *NUMBERS))


REPEATED = "select ts_code, trade_date from bad_bars where trade_date is not null group by 1, 2 having count(*) > 1"


@query(
    "duplicates_raise",
    sql(f"select {_norm(100, 1)} from dated b anti join repeated d on b.ts_code = d.ts_code", dated=DATED, repeated=REPEATED),
)
def raise_policy(spark, sf):
    return rounded(normalize_bars(derived(spark, sf, "bad_bars"), BarUnits(amount_unit="yuan")))


@query(
    "duplicate_dates",
    sql(
        """select ts_code, count(*) as n_duplicate_dates, array_to_string(list(day order by day)[1:5], ', ') as preview
        from (select ts_code, cast(trade_date as string) as day from repeated) x group by ts_code""",
        repeated=REPEATED,
    ),
)
def duplicates_listed(spark, sf):
    return duplicate_dates(coerce_bars(derived(spark, sf, "bad_bars")))


@query(
    "previous_close",
    sql(
        f"""select ts_code, trade_date, {r('close', 'close')}, {r('pc', 'pre_close')}, {r('close - pc', 'change')},
        {r('(close - pc) / pc * 100.0', 'pct_chg_calc')}
        from (select *, lag(close) over (partition by ts_code order by trade_date) as pc from price_bars) x"""
    ),
)
def previous_close(spark, sf):
    bars = normalize_bars(derived(spark, sf, "price_bars"), CONTRACT_UNITS, derive_optional_fields=True)
    return rounded(bars.select("ts_code", "trade_date", "close", "pre_close", "change", "pct_chg_calc"))


@query(
    "prepare_labels",
    sql(
        """select ts_code, asof_date, label, coalesce(sample_id, concat(ts_code, '_', cast(asof_date as string))) as sample_id,
        'labels.csv' as label_source, 1.0e0 as confidence
        from bad_labels where ts_code is not null and asof_date is not null"""
    ),
)
def labels_prepared(spark, sf):
    labels = derived(spark, sf, "bad_labels").withColumnsRenamed({"ts_code": "Ticker", "asof_date": "Date", "label": "Y"})
    return prepare_labels(labels)


@query(
    "filled_features",
    sql(
        "select sample_id, "
        + ", ".join(r(f"case when rn >= 120 then {c} else 0 end", c) for c in FEATURES)
        + """ from (select l.sample_id, f.* from bar_labels l
                 asof left join index_features f on l.ts_code = f.ts_code and l.asof_date >= f.trade_date) w"""
    ),
)
def filled(spark, sf):
    """Labels whose window is too short have no features, which then count as 0."""
    built = build_samples(derived(spark, sf, "bar_labels"), derived(spark, sf, "index_bars"), 120, 120)
    known = F.col("skip_reason").isNull()
    return rounded(
        fill_features(built.withColumns({c: F.when(known, F.col(c)) for c in FEATURES})).select("sample_id", *FEATURES)
    )


@query(
    "bars_in_range",
    sql(
        """select ts_code, count(*) as n_bars, min(trade_date) as first_day, max(trade_date) as last_day from price_bars
        where trade_date between date '1995-01-01' and date '1996-12-31' group by ts_code"""
    ),
)
def in_range(spark, sf):
    rules = ScreenRules(start_date="1995-01-01", end_date="1996-12-31")
    kept = bars_in_range(derived(spark, sf, "price_bars"), rules)
    return kept.groupBy("ts_code").agg(
        F.count("*").alias("n_bars"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")
    )


@query(
    "latest_price_in_range",
    sql(
        f"""select ts_code, trade_date, {r('close', 'close')} from (
        select *, row_number() over (partition by ts_code order by trade_date desc) as age from price_bars) x
        where age = 1 and close between 900.0 and 2000.0"""
    ),
)
def latest_price(spark, sf):
    bars = derived(spark, sf, "price_bars").select("ts_code", "trade_date", "close")
    rules = ScreenRules(min_price=900.0, max_price=2000.0)
    return rounded(latest_bars(bars).where(price_ok(rules, F.col("close"))))


@query("join_key", sql("select sample_id, concat(ts_code, '|', cast(asof_date as string)) as join_key from bar_labels"))
def keys(spark, sf):
    labels = derived(spark, sf, "bar_labels")
    return labels.select("sample_id", join_key(labels.drop("sample_id")).alias("join_key"))
