"""Queries over indicators, window features, as-of joins and the labelled dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived, labelled_windows
from barloom.catalog.ingest import TIME_SPLIT_SQL
from barloom.catalog.oracle import W, over, r, r_all, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import counted, rounded
from barloom.operators.asof import asof_join
from barloom.operators.dataset import (
    align_features,
    build_samples,
    dataset_rows,
    misaligned_ids,
    skip_examples,
    skip_report,
    skipped_rows,
)
from barloom.operators.features import build_features, history_gate, latest_bars, latest_features
from barloom.operators.indicators import basic_indicators, screener_indicators
from barloom.operators.normalize import CONTRACT_UNITS, normalize_bars
from barloom.operators.sequence import SEQUENCE_COLUMNS, window_sequences
from barloom.schema import FEATURES
from barloom.session import materialize


@query(
    "latest_features",
    sql(
        f"""select ts_code, trade_date as asof_date, window_start, rn::bigint as history_len, {r_all(FEATURES)} from price_features
        where rn >= 160 and trade_date = (select max(trade_date) from price_bars p where p.ts_code = price_features.ts_code)"""
    ),
)
def latest(spark, sf):
    return rounded(latest_features(derived(spark, sf, "price_bars"), 120, 160)).orderBy("ts_code")


@query(
    "window_features",
    sql(f"select ts_code, trade_date, rn::bigint as rn, window_start, {r_all(FEATURES)} from price_features where rn >= 120"),
)
def window_features(spark, sf):
    features = build_features(derived(spark, sf, "price_bars"), 120, closes_complete=True)
    return rounded(counted(history_gate(features, 120, 80), "rn"))


@query(
    "window_features_unchecked",
    sql(f"select ts_code, trade_date, rn::bigint as rn, window_start, {r_all(FEATURES)} from index_features where rn >= 160"),
)
def window_features_unchecked(spark, sf):
    """The form for bars whose closes may be missing."""
    features = build_features(derived(spark, sf, "index_bars"), 120)
    return rounded(counted(history_gate(features, 120, 160), "rn"))


SHORT = f"""
select ts_code, trade_date, rn::bigint as rn, window_start,
       max(high) {over(-29)} / min(low) {over(-29)} - 1 as base_range_pct,
       stddev_pop(vol) {over(-29)} / avg(vol) {over(-29)} as base_vol_cv,
       avg(vol) {over(-19)} / avg(vol) {over(-29, -20)} as vol_shrink_ratio,
       close / lag(close, 5) over ({W}) - 1 as recent_return_5,
       close / lag(close, 10) over ({W}) - 1 as recent_return_10,
       close / max(high) {over(-20, -1)} - 1 as breakout_distance_20,
       close / max(high) {over(-29)} - 1 as breakout_distance_60,
       vol / avg(vol) {over(-20, -1)} as volume_spike_ratio,
       avg(case when close > m10 then 1.0e0 else 0 end) {over(-20)} as above_ma10_ratio,
       avg(case when close > m20 then 1.0e0 else 0 end) {over(-10)} as above_ma20_ratio,
       stddev_pop(ret) {over(-19)} as volatility_20
from (
  select *, close / lag(close) over ({W}) - 1 as ret, row_number() over ({W}) as rn,
         lag(trade_date, 29) over ({W}) as window_start, avg(close) {over(-9)} as m10, avg(close) {over(-19)} as m20
  from index_bars) b
"""


@query(
    "window_features_short",
    sql(f"select ts_code, trade_date, rn, window_start, {r_all(FEATURES)} from short where rn >= 30", short=SHORT),
)
def window_features_short(spark, sf):
    """A window of 30 rows, which is too short for some of the usual frames."""
    features = build_features(derived(spark, sf, "index_bars"), 30, closes_complete=True)
    return rounded(counted(history_gate(features, 30, 1), "rn"))


@query(
    "basic_indicators",
    sql(
        f"""select ts_code, trade_date, {r(f'close / lag(close) over ({W}) - 1', 'ret_1d')},
        {r(f'avg(close) {over(-4)}', 'ma_5')}, {r(f'avg(close) {over(-19)}', 'ma_20')} from price_bars"""
    ),
)
def basic(spark, sf):
    bars = basic_indicators(derived(spark, sf, "price_bars"))
    return rounded(bars.select("ts_code", "trade_date", "ret_1d", "ma_5", "ma_20"))


def _full(aggregate: str, column: str, n: int, skip: int = 0) -> str:
    frame = over(1 - n - skip, -skip)
    return f"case when count({column}) {frame} = {n} then {aggregate}({column}) {frame} end"


SCREENER_COLUMNS = {
    **{f"ma{n}": _full("avg", "close", n) for n in (5, 10, 20, 30, 60, 120)},
    **{f"vma{n}": _full("avg", "vol", n) for n in (5, 10, 20, 30, 60, 120)},
    "atr14": _full("avg", "tr", 14),
    "hhv90_prev": _full("max", "high", 90, 1),
    "llv100": _full("min", "low", 100),
    "hhv100": _full("max", "high", 100),
    "vol_mean_20": _full("avg", "vol", 20),
    "vol_mean_100": _full("avg", "vol", 100),
    "vol_std_100": _full("stddev_samp", "vol", 100),
}
RATIOS = {
    "vol_cv_100": "vol_std_100 / (vol_mean_100 + 1e-9)",
    "base_range_pct_100": "(hhv100 - llv100) / (llv100 + 1e-9)",
    "vol_shrink_ratio": "vol_mean_20 / (vol_mean_100 + 1e-9)",
}
INDICATORS = f"""
select ts_code, trade_date, {', '.join(f'{e} as {n}' for n, e in SCREENER_COLUMNS.items())}
from (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr
      from (select *, lag(close) over ({W}) as pc from index_bars) a) b
"""


@query(
    "screener_indicators",
    sql(
        "select ts_code, trade_date, "
        + ", ".join(r(e, n) for n, e in ({c: c for c in SCREENER_COLUMNS} | RATIOS).items())
        + " from indicators",
        indicators=INDICATORS,
    ),
)
def indicators(spark, sf):
    bars = screener_indicators(derived(spark, sf, "index_bars"))
    return rounded(bars.select("ts_code", "trade_date", *SCREENER_COLUMNS, *RATIOS))


@query(
    "asof_join",
    sql(
        f"""select l.sample_id, l.ts_code, l.asof_date, b.trade_date, {r('b.close', 'close')}
        from bar_labels l asof left join price_bars b on l.ts_code = b.ts_code and l.asof_date >= b.trade_date"""
    ),
)
def asof(spark, sf):
    bars = derived(spark, sf, "price_bars").select("ts_code", "trade_date", "close")
    found = asof_join(derived(spark, sf, "bar_labels"), bars)
    return rounded(found.select("sample_id", "ts_code", "asof_date", "trade_date", "close"))


@query(
    "window_bounds",
    sql(
        """select sample_id, asof_date, window_start, trade_date as window_end, rn::bigint as rn from windows where rn >= 160"""
    ),
)
def window_bounds(spark, sf):
    features = build_features(derived(spark, sf, "index_bars"), 120, closes_complete=True)
    found = history_gate(asof_join(derived(spark, sf, "bar_labels"), features), 120, 160)
    return counted(found, "rn").select(
        "sample_id", "asof_date", "window_start", F.col("trade_date").alias("window_end"), "rn"
    )


@query(
    "latest_bars",
    sql(
        f"""select ts_code, trade_date, {r_all(['open', 'high', 'low', 'close', 'vol', 'amount'])} from (
        select *, row_number() over (partition by ts_code order by trade_date desc) as age from price_bars) x where age = 1"""
    ),
)
def latest_bar(spark, sf):
    return rounded(latest_bars(derived(spark, sf, "price_bars")))


@query(
    "dataset_build",
    sql(
        f"""select w.sample_id, w.ts_code, w.asof_date, w.window_start, w.trade_date as window_end, w.label, w.label_source,
        w.confidence, s.split, w.rn::bigint as rn, {r_all(FEATURES, 'w.')}
        from windows w join splits s on w.asof_date = s.asof_date where rn >= 120""",
        splits=TIME_SPLIT_SQL,
    ),
)
def dataset_build(spark, sf):
    return rounded(counted(dataset_rows(labelled_windows(spark, sf)), "rn"))


ONE_LABEL_EACH = """
select ts_code, asof_date, label from bad_labels where ts_code is not null and asof_date is not null
"""
FIRST_PER_DAY = """
select ts_code, trade_date, open, high, low, close, vol, amount from (
  select *, row_number() over (partition by ts_code, trade_date order by _ord) as place
  from bad_bars where trade_date is not null) x where place = 1
"""
FAULT = """high < low or high < open or high < close or low > open or low > close or open <= 0 or close is null
 or close <= 0 or vol < 0 or amount < 0"""
USABLE = f"""
select ts_code, trade_date, row_number() over (partition by ts_code order by trade_date) as rn
from first_per_day b anti join (select distinct ts_code from first_per_day where {FAULT}) f on b.ts_code = f.ts_code
"""
OUTCOME = """
select l.*, case when s.ts_code is null then 'no_usable_bars'
                 when coalesce(u.rn, 0) < 160 then 'insufficient_history' end as skip_reason
from (select *, row_number() over (order by ts_code, asof_date, label) as i from labels_in) l
left join (select distinct ts_code from usable) s on l.ts_code = s.ts_code
asof left join usable u on l.ts_code = u.ts_code and l.asof_date >= u.trade_date
"""
SKIPS = {"labels_in": ONE_LABEL_EACH, "first_per_day": FIRST_PER_DAY, "usable": USABLE, "outcome": OUTCOME}


def _faulty_build(spark, sf):
    bars = normalize_bars(derived(spark, sf, "bad_bars"), CONTRACT_UNITS, duplicate_policy="first")
    return build_samples(derived(spark, sf, "bad_labels").drop("sample_id"), bars, 120, 160)


@query(
    "skip_report",
    sql(
        """select count(*) as num_labels, count_if(skip_reason is null)::bigint as num_samples,
        count_if(skip_reason = 'no_usable_bars')::bigint as num_skipped,
        count_if(skip_reason = 'insufficient_history')::bigint as num_short_history,
        """
        + r("count_if(skip_reason = 'no_usable_bars')::double / count(*)", "skip_ratio")
        + " from outcome",
        **SKIPS,
    ),
)
def skips(spark, sf):
    return rounded(skip_report(_faulty_build(spark, sf)))


@query(
    "skipped_labels",
    sql(
        """select concat(ts_code, '_', cast(asof_date as string)) as sample_id, ts_code, asof_date, skip_reason
        from outcome where skip_reason is not null""",
        **SKIPS,
    ),
)
def skipped(spark, sf):
    return skipped_rows(_faulty_build(spark, sf))


@query(
    "skip_examples",
    sql(
        """select concat(ts_code, '_', cast(asof_date as string)) as sample_id, ts_code, asof_date, skip_reason
        from outcome where skip_reason = 'no_usable_bars' order by asof_date, 1 limit 10""",
        **SKIPS,
    ),
)
def skip_example_rows(spark, sf):
    return skip_examples(_faulty_build(spark, sf))


@query(
    "misaligned_ids",
    sql(
        """select sample_id, 'left' as side from windows where rn is null or rn < 120
        union all select sample_id, 'right' from windows where rn >= 120 and label = 2"""
    ),
)
def misaligned(spark, sf):
    """Labels without features: their history is too short."""
    ids = materialize(labelled_windows(spark, sf).select("sample_id"), "window-ids")  # each side is read twice
    return misaligned_ids(materialize(derived(spark, sf, "bar_labels").select("sample_id"), "label-ids"), ids)


@query("aligned_features", sql(f"select sample_id, label, {r_all(FEATURES)} from windows where rn >= 120"))
def aligned(spark, sf):
    rows = materialize(labelled_windows(spark, sf).select("sample_id", "label", *FEATURES), "windows")  # read four times
    return rounded(align_features(rows.select("sample_id", "label"), rows.select("sample_id", *FEATURES)))


NUMBERED = "select *, row_number() over (partition by ts_code order by trade_date) as rn from index_bars"


@query(
    "window_sequences",
    sql(
        "select w.sample_id, (b.rn - w.rn + 119)::bigint as step, "
        + ", ".join(r(f"cast(b.{c} as float)::double", c, 3) for c in SEQUENCE_COLUMNS)
        + """ from windows w join numbered b on w.ts_code = b.ts_code and b.rn between w.rn - 119 and w.rn where w.rn >= 120""",
        numbered=NUMBERED,
    ),
)
def sequences(spark, sf):
    """The tensor in long form: one row per sample and step."""
    samples = labelled_windows(spark, sf)
    tensor = window_sequences(samples, derived(spark, sf, "index_bars"), 120)
    steps = tensor.select("sample_id", F.posexplode("x_sequence").alias("step", "bar"))
    long = steps.select(
        "sample_id",
        F.col("step").cast("bigint").alias("step"),
        *[F.col("bar")[i].alias(c) for i, c in enumerate(SEQUENCE_COLUMNS)],
    )
    return rounded(long, 3, quick=True)
