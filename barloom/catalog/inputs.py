"""Bars, labels and predictions derived from the given tables, as portable SQL.

The same text runs on Spark and, for the checks, on another SQL engine. Symbol = supplier,
day = ship date. All of each table is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.dataset import build_samples
from barloom.operators.screener import ScreenRules
from barloom.session import materialize

SYMBOL_SQL = "concat('S', lpad(cast(l_suppkey as string), 6, '0'))"
ROW_KEY = "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey"

PRICE_BARS = f"""
select {SYMBOL_SQL} as ts_code, cast(l_shipdate as date) as trade_date,
       min_by(l_extendedprice / l_quantity, {ROW_KEY}) as open,
       max(l_extendedprice / l_quantity) as high,
       min(l_extendedprice / l_quantity) as low,
       max_by(l_extendedprice / l_quantity, {ROW_KEY}) as close,
       sum(l_quantity) as vol, sum(l_extendedprice) as amount
from lineitem group by 1, 2
"""

INDEX_BARS = f"""
select ts_code, trade_date, close / (1 + r / 2) as open, close * (1 + abs(r) + t * 0.1) as high,
       close * (1 - abs(r) - t * 0.1) as low, close, vol, amount,
       100 * (close / lag(close) over (partition by ts_code order by trade_date) - 1) as pct_chg
from (
  select *, 20 * exp(sum(r) over (partition by ts_code order by trade_date
                                  rows between unbounded preceding and current row)) as close
  from (
    select {SYMBOL_SQL} as ts_code, cast(l_shipdate as date) as trade_date,
           (avg(l_discount) - 0.05) * 0.8 as r, avg(l_tax) as t, sum(l_quantity) as vol, sum(l_extendedprice) as amount
    from lineitem group by 1, 2) d) e
"""

# every bar with a known outcome is labelled, half of them a day later where no bar follows at once;
# the factor keeps a tie of two closes from depending on the last bit
BAR_LABELS = """
select concat(ts_code, '_', cast(d as string)) as sample_id, ts_code, d as asof_date,
       case when c5 > close * 1.000001 then 1 else 0 end as label, 'derived' as label_source, 1.0e0 as confidence,
       c5 / close - 1 as future_return
from (
  select *, case when rn % 2 = 0 and next_date > tomorrow then tomorrow else trade_date end as d
  from (
    select ts_code, trade_date, close, cast(trade_date + interval 1 day as date) as tomorrow,
           row_number() over (partition by ts_code order by trade_date) as rn,
           lead(trade_date) over (partition by ts_code order by trade_date) as next_date,
           lead(close, 5) over (partition by ts_code order by trade_date) as c5
    from index_bars) i) x
where c5 is not null
"""

# faults by a rule on a key that any engine computes alike, without a global row number;
# the last branch repeats some days with another close
BAD_BARS = """
select ts_code, case when k % 2003 = 1 then null else trade_date end as trade_date,
       case when k % 2011 = 2 then -open else open end as open,
       case when k % 3001 = 3 then low * 0.5 else high end as high, low,
       case when k % 4001 = 4 then null else close end as close,
       case when k % 5003 = 5 then -vol else vol end as vol,
       case when k % 6007 = 6 then -amount else amount end as amount,
       rn * 10 + case when k % 3511 = 7 then 25 else 0 end as _ord
from keyed_bars
union all
select ts_code, trade_date, open, high, low, (close + low) / 2 as close, vol, amount, rn * 10 + 1 as _ord
from keyed_bars where k % 2503 = 6
"""
KEYED_BARS = """
select *, cast(substr(ts_code, 2) as bigint) * 7919 + rn as k
from (select *, row_number() over (partition by ts_code order by trade_date) as rn from price_bars) p
"""

# labels with faults: bad values, copies, wrong ids, unknown symbols, dates out of range
BAD_LABELS = """
select case when n % 23 = 1 then 'wrong' when n % 29 = 2 then null else sample_id end as sample_id,
       case when n % 31 = 3 then concat('X', ts_code) else ts_code end as ts_code,
       case when n % 37 = 4 then null
            when n % 41 = 5 then cast(asof_date + interval 9000 day as date)
            when n % 43 = 6 then cast(asof_date - interval 9000 day as date)
            else asof_date end as asof_date,
       case when n % 47 = 7 then 2 when n % 53 = 8 then null else label end as label
from (
  select *, cast(substr(ts_code, 2) as bigint) * 13
            + row_number() over (partition by ts_code order by asof_date) as n
  from bar_labels) x
union all
select sample_id, ts_code, asof_date, label from bar_labels where sample_id like '%7'
"""

RULES = ScreenRules(
    start_date="1900-01-01",
    end_date="2999-12-31",
    base_max_range_pct=1.0,
    base_max_vol_cv=0.9,
    base_vol_shrink_ratio_max=1.2,
    min_impulse_pct=0.01,
    min_impulse_vol_ratio=1.0,
    breakout_factor=0.8,
    min_pullback_pct=0.01,
    max_pullback_pct=0.15,
    max_pullback_vol_ratio=2.0,
    max_close_below_breakout_close=0.5,
    min_above_ma10_ratio=0.9,
    min_above_platform_ratio=0.6,
    below_first_leg_factor=1.0,
    min_price=0.01,
    max_price=1e9,
    prefilter_min_pct_chg=3.0,
)


INPUTS = {
    "price_bars": PRICE_BARS,
    "index_bars": INDEX_BARS,
    "keyed_bars": KEYED_BARS,
    "bad_bars": BAD_BARS,
    "bar_labels": BAR_LABELS,
    "bad_labels": BAD_LABELS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of `INPUTS`, or a given table."""
    if name not in INPUTS:
        return table(spark, sf_dir, name)
    text, used = INPUTS[name], {}
    for source in [*INPUTS, "lineitem"]:
        if re.search(rf"\bfrom {source}\b", text):
            text = re.sub(rf"\bfrom {source}\b", "from {" + source + "}", text)
            used[source] = derived(spark, sf_dir, source)
    return spark.sql(text, **used)


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the features and split of their window, and their future return."""
    built = build_samples(
        derived(spark, sf_dir, "bar_labels"), derived(spark, sf_dir, "index_bars"), 120, 120
    )
    return built.where(F.col("skip_reason").isNull())


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deterministic scores per labelled window, `score_a` and `score_b`.

    They are written as a table, as predictions are handed over, so that a query that reads
    them several times derives them once.
    """
    return materialize(scored_windows(labelled_windows(spark, sf_dir)), "predictions")


def scored_windows(windows: DataFrame) -> DataFrame:
    return windows.select(
        "sample_id",
        "ts_code",
        "asof_date",
        F.col("label").alias("y_true"),
        "future_return",
        F.round(1 / (1 + F.exp(-20 * F.col("recent_return_10"))), 6).alias("score_a"),
        F.round(1 / (1 + F.exp(-10 * F.col("breakout_distance_20"))), 6).alias("score_b"),
    )


def of_model(scored: DataFrame, model: str) -> DataFrame:
    """One of the two scores, in validation form."""
    return scored.select("sample_id", "ts_code", "asof_date", "y_true", F.col(f"score_{model}").alias("y_score"))


def model_predictions(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """The predictions of one of the two scores, in validation form."""
    return of_model(predictions(spark, sf_dir), model)
