"""The screener on staged symbols with known results, and on a random universe."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import screener as s

RULES = s.ScreenRules(
    start_date="2024-01-10",
    end_date="2024-08-30",
    base_max_range_pct=1.2,
    base_max_vol_cv=0.9,
    base_vol_shrink_ratio_max=1.3,
    min_impulse_pct=0.02,
    min_impulse_vol_ratio=1.1,
    breakout_factor=0.9,
    min_pullback_pct=0.005,
    max_pullback_pct=0.2,
    max_pullback_vol_ratio=1.5,
    max_close_below_breakout_close=0.3,
    min_above_ma10_ratio=0.9,
    min_above_platform_ratio=0.8,
    below_first_leg_factor=1.0,
    min_price=1.0,
    max_price=1000.0,
    prefilter_min_pct_chg=2.5,
    min_turnover_rate=0.6,
)


def universe(symbols=60, seed=11):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(symbols):
        n = int(rng.integers(140, 260))
        close = 20 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
        frame = pd.DataFrame(
            {
                "ts_code": f"{'300' if i % 3 == 0 else '600'}{i:03d}",
                "trade_date": pd.date_range("2024-01-01", periods=n, freq="D").date,
                "high": close * (1 + rng.random(n) * 0.02),
                "low": close * (1 - rng.random(n) * 0.02),
                "close": close,
                "vol": rng.integers(50, 200, n).astype(float),
                "turnover_rate": rng.random(n) * 4,
            }
        )
        frame["pct_chg"] = (frame.close / frame.close.shift(1) - 1) * 100
        for c in ("vol", "pct_chg", "turnover_rate", "high"):
            frame.loc[rng.random(n) < 0.01, c] = np.nan
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame):
    df = spark.createDataFrame(frame)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def staged(days, changes, code="600777"):
    """A quiet symbol: close 10, high 10.2, low 9.9, volume 80 or 120; `changes` by day from the end (0 is the last)."""
    rows = []
    for age in reversed(range(days)):
        bar = {"close": 10.0, "high": 10.2, "low": 9.9, "vol": 80.0 + 40 * (age % 2), "pct_chg": 0.0, "turnover_rate": 4.0}
        date = (pd.Timestamp("2024-08-30") - pd.Timedelta(days=age)).date()
        rows.append({"ts_code": code, "trade_date": date, **bar, **changes.get(age, {})})
    return pd.DataFrame(rows)


#: A break-out 6 days before the last bar, its high a day later, then four falling bars on low volume.
STAGE = {
    6: {"close": 11.0, "high": 11.1, "low": 10.1, "vol": 400.0, "pct_chg": 10.0},
    5: {"close": 11.4, "high": 11.5, "low": 11.0, "vol": 300.0, "pct_chg": 3.6},
    **{k: {"close": 10.9 + 0.05 * k, "high": 11.2, "low": 10.7, "vol": 60.0, "pct_chg": -0.5} for k in range(5)},
}
STAGE_RULES = s.ScreenRules(start_date="2023-01-01", end_date="2024-08-30", base_vol_shrink_ratio_max=1.01)


def test_a_staged_leg(spark):
    leg = s.pullback_legs(to_spark(spark, staged(200, STAGE)), STAGE_RULES).first()
    assert str(leg.impulse_date) == "2024-08-24" and leg.days_after_impulse == 6
    assert (leg.impulse_close, leg.impulse_vol, leg.platform_high_before) == (11.0, 400.0, 10.2)
    assert leg.base_range_pct == pytest.approx(10.2 / 9.9 - 1) and leg.impulse_vol_ratio == pytest.approx(4.0)
    assert leg.base_vol_cv == pytest.approx(0.2 * np.sqrt(100 / 99))
    assert (leg.first_leg_high, leg.pullback_days, leg.pullback_mean_vol) == (11.5, 5, 60.0)
    assert leg.ma10 == pytest.approx((3 * 10 + 11.0 + 11.4 + sum(10.9 + 0.05 * k for k in range(5))) / 10)


def test_one_more_quiet_bar_moves_every_age(spark):
    later = {age + 1: bar for age, bar in STAGE.items()} | {0: STAGE[0]}
    both = to_spark(spark, pd.concat([staged(200, STAGE, "600001"), staged(200, later, "600002")]))
    a, b = s.pullback_legs(both, STAGE_RULES).orderBy("ts_code").collect()
    assert (b.days_after_impulse, b.pullback_days) == (a.days_after_impulse + 1, a.pullback_days + 1)
    assert (b.first_leg_high, b.impulse_close, b.platform_high_before) == (a.first_leg_high, a.impulse_close, a.platform_high_before)


@pytest.mark.parametrize(
    "change",
    [{"vol": 150.0}, {"pct_chg": 6.0}, {"turnover_rate": 2.9}, {"close": 9.9}],
)
def test_one_missing_condition_is_no_impulse(spark, change):
    weak = {**STAGE, 6: {**STAGE[6], **change}, 5: {**STAGE[5], "vol": 90.0}}
    assert s.impulse_candidates(to_spark(spark, staged(200, weak)), STAGE_RULES).isEmpty()


def test_the_platform_reaches_as_far_back_as_its_rule(spark):
    """A high of 11.4 lies 250 bars back, outside the base but inside a long break-out rule."""
    bars = to_spark(spark, staged(330, {**STAGE, 256: {"high": 11.4}}))
    near = s.impulse_candidates(bars, STAGE_RULES).first()
    far = s.impulse_candidates(bars, replace(STAGE_RULES, breakout_lookback=295, breakout_factor=0.9)).collect()
    assert near.platform_high_before == 10.2
    assert [r.platform_high_before for r in far if str(r.impulse_date) == "2024-08-24"] == [11.4]


def test_a_short_base_still_has_its_averages(spark):
    rules = replace(STAGE_RULES, base_lookback=10, impulse_lookback=7)
    leg = s.pullback_legs(to_spark(spark, staged(200, STAGE)), rules).first()
    assert leg.ma20 is not None and leg.impulse_vol_ratio == pytest.approx(4.0)


def test_detection_keeps_only_unrejected_legs(spark):
    bars = to_spark(spark, universe())
    judged = s.first_rejection(bars, RULES).collect()
    hits = {r.ts_code: r.score for r in s.detect_pattern(bars, RULES).collect()}
    assert set(hits) == {r.ts_code for r in judged if r.rejected_by is None}
    for r in judged:
        if r.rejected_by is None:
            terms = [
                max(0, 20 - r.base_range_pct * 40),
                max(0, 20 - r.base_vol_cv * 20),
                min(20, r.impulse_vol_ratio * 4),
                max(0, 20 - r.pullback_pct * 100),
                max(0, 20 - r.pullback_vol_ratio * 20),
            ]
            assert hits[r.ts_code] == pytest.approx(sum(terms), abs=0.006)


def test_rules_over_missing_values_do_not_reject(spark):
    columns = {
        "close": 10.0, "days_after_impulse": 3, "pullback_days": 3, "pullback_pct": 0.05, "pullback_vol_ratio": None,
        "impulse_close": 10.0, "ma10": None, "platform_high_before": None, "first_leg_high": 11.0, "late_spike": False,
    }
    kinds = {"days_after_impulse": "bigint", "pullback_days": "bigint", "late_spike": "boolean"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds.get(c, "double")).alias(c) for c, v in columns.items()])
    for name, rule in s.rejections().items():
        assert row.where(s.holds(rule)).count() == 0, name
    assert row.withColumn("close", F.lit(None).cast("double")).where(s.holds(s.rejections()["price"])).count() == 1


def quiet(code, bars=30, close=20.0, **marks):
    """Rows of a symbol on which no signal fires; `marks` sets a column `back` bars before the last: column=(back, value)."""
    rows = [{"ts_code": code, "trade_date": d.date(), "close": close, "vol": 100.0, "pct_chg": 0.1, "turnover_rate": 1.0} for d in pd.bdate_range("2024-01-01", periods=bars)]
    for column, (back, value) in marks.items():
        rows[bars - 1 - back][column] = value
    return rows


def test_prefilter_on_staged_symbols(spark):
    rules = s.ScreenRules()
    # after four bars of 100, a volume of 225 is 1.8 times the mean of the five
    staged_rows = [
        *quiet("move", pct_chg=(3, 7.0)), *quiet("turnover", turnover_rate=(19, 5.0)), *quiet("volume", vol=(0, 226.0)),
        *quiet("none"), *quiet("weak", pct_chg=(3, 6.99), turnover_rate=(4, 4.99), vol=(0, 224.0)),
        *quiet("past", pct_chg=(20, 9.0), turnover_rate=(20, 9.0), vol=(21, 900.0)),
        *quiet("short", bars=24, pct_chg=(3, 9.0)), *quiet("just", bars=25, pct_chg=(3, 9.0)),
        *quiet("low", close=4.99, pct_chg=(3, 9.0)), *quiet("floor", close=5.0, pct_chg=(3, 9.0)),
        *quiet("high", close=120.01, pct_chg=(3, 9.0)), *quiet("ceiling", close=120.0, pct_chg=(3, 9.0)),
        *quiet("unknown", pct_chg=(3, None), vol=(2, None)),
    ]
    rows = [tuple(r.values()) for r in staged_rows]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, vol double, pct_chg double, turnover_rate double")
    found = {r.ts_code: r.n_bars for r in s.prefilter(bars, rules).collect()}
    assert found == {"move": 30, "turnover": 30, "volume": 30, "just": 25, "floor": 30, "ceiling": 30}
    assert "turnover" not in {r.ts_code for r in s.prefilter(bars.drop("turnover_rate"), rules).collect()}


def test_limit_by_code_range(spark):
    rows = [("300001", 10.0), ("300002", 19.0), ("600001", 9.5), ("600002", 9.4), ("688001", 18.9), ("600003", None)]
    bars = spark.createDataFrame(rows, "ts_code string, pct_chg double")
    assert {r.ts_code for r in bars.where(s.is_limit_up()).collect()} == {"300002", "600001"}


def test_screen_is_one_shuffle_per_pass(spark):
    bars = to_spark(spark, universe(3))
    plan = s.pullback_legs(bars, RULES)._jdf.queryExecution().executedPlan().toString()
    # the tails and the counts, both by symbol; histories are cut before the exchange
    assert plan.count("Exchange") == 2 and "WindowGroupLimit" in plan
