"""Rule-based screener for a quiet base, an impulse out of it, and a pullback."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import holds
from barloom.functions.frames import last_rows, newest_rows, whole_symbol
from barloom.functions.rolling import Rolling
from barloom.operators.indicators import GUARD
from barloom.schema import DATE, SYMBOL


@dataclass(frozen=True)
class ScreenRules:
    """Thresholds; returns are shares of 1, `pct_chg` and `turnover_rate` are percent."""

    # Default thresholds.

    start_date: str = "2025-01-01"
    end_date: str | None = None  # None: today

    base_lookback: int = 100
    base_max_range_pct: float = 0.35
    base_max_vol_cv: float = 0.80
    base_vol_shrink_ratio_max: float = 0.80

    impulse_lookback: int = 20
    breakout_lookback: int = 90
    min_impulse_pct: float = 0.07
    min_impulse_vol_ratio: float = 2.0
    min_turnover_rate: float = 3.0

    min_pullback_days: int = 2
    max_pullback_days: int = 8
    max_days_after_impulse: int = 15
    min_pullback_pct: float = 0.03
    max_pullback_pct: float = 0.15
    max_pullback_vol_ratio: float = 0.75

    max_close_below_breakout_close: float = 0.06
    min_above_ma10_ratio: float = 0.97
    min_above_platform_ratio: float = 0.98
    breakout_factor: float = 0.98
    below_first_leg_factor: float = 0.98
    late_spike_pct: float = 7.0
    late_spike_vol_ratio: float = 2.0

    prefilter_lookback: int = 25
    prefilter_recent_days: int = 20
    prefilter_min_pct_chg: float = 7.0
    prefilter_min_turnover: float = 5.0
    prefilter_vol_ratio: float = 1.8

    min_price: float = 5.0
    max_price: float = 120.0

    limit_up_pct: float = 9.5
    wide_limit_up_pct: float = 19.0
    wide_limit_prefixes: tuple[str, ...] = ("300", "688")

    @property
    def min_bars(self) -> int:
        return max(self.base_lookback + 30, 160)


def price_ok(rules: ScreenRules, close: Column) -> Column:
    return holds(close.between(rules.min_price, rules.max_price))


def bars_in_range(bars: DataFrame, rules: ScreenRules) -> DataFrame:
    end = F.lit(rules.end_date).cast("date") if rules.end_date else F.current_date()
    return bars.where(F.col(DATE).between(F.lit(rules.start_date).cast("date"), end))


def is_limit_up(rules: ScreenRules = ScreenRules()) -> Column:
    """A daily gain near the exchange limit, which is wider for some code ranges."""
    wide = reduce(or_, [F.col(SYMBOL).startswith(p) for p in rules.wide_limit_prefixes])
    bar = F.when(wide, F.lit(rules.wide_limit_up_pct)).otherwise(F.lit(rules.limit_up_pct))
    return holds(F.col("pct_chg") >= bar)


def prefilter(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Symbols with a strong move, turnover or volume among their last bars."""
    tail = newest_rows(bars, rules.prefilter_recent_days + 5)
    five = last_rows(5)
    tail = tail.withColumn("_vma5", F.when(F.count("vol").over(five) == 5, F.avg("vol").over(five)))
    signals = [
        F.col("pct_chg") >= rules.prefilter_min_pct_chg,
        F.col("vol") > F.col("_vma5") * rules.prefilter_vol_ratio,
    ]
    if "turnover_rate" in bars.columns:
        signals.append(F.col("turnover_rate") >= rules.prefilter_min_turnover)
    recent = tail.where(F.col("_age") < rules.prefilter_recent_days)
    return (
        recent.groupBy(SYMBOL)
        .agg(
            F.max("_bars").alias("n_bars"),
            F.max(F.when(F.col("_age") == 0, F.col("close"))).alias("close"),
            F.bool_or(reduce(or_, [holds(s) for s in signals])).alias("_signal"),
        )
        .where((F.col("n_bars") >= max(10, rules.prefilter_lookback)) & price_ok(rules, F.col("close")) & F.col("_signal"))
        .select(SYMBOL, "n_bars", "close")
    )


def _screen_tail(bars: DataFrame, rules: ScreenRules) -> DataFrame:
    """The last bars of each long enough symbol with all measures that the rules need."""
    look = rules.base_lookback
    # the oldest row that may be an impulse still needs its longest frame
    reach = rules.impulse_lookback + max(look, rules.breakout_lookback, 20)
    tail = newest_rows(bars_in_range(bars, rules), reach).where(F.col("_bars") >= rules.min_bars)
    roll = Rolling()
    base_mean = roll.mean("vol", look, 1)
    base_high, base_low = roll.highest("high", look, 1), roll.lowest("low", look, 1)
    recent_vol = roll.mean("vol", min(20, look), 1)
    measures = {
        "base_range_pct": base_high / (base_low + GUARD) - 1.0,
        "base_vol_cv": roll.std("vol", look, 1, sample=True) / (base_mean + GUARD),
        "base_vol_shrink": recent_vol / (base_mean + GUARD),
        "vol_ratio": F.col("vol") / (recent_vol + GUARD),
        "prev_high": roll.highest("high", rules.breakout_lookback, 1),
        "ma10": roll.full_mean("close", 10),
        "ma20": roll.full_mean("close", 20),
        "vma20": roll.full_mean("vol", 20),
    }
    return roll.attach(tail).withColumns(measures).drop(*roll.scratch_columns)


def _is_impulse(tail: DataFrame, rules: ScreenRules) -> Column:
    rn = F.col("_bars") - F.col("_age")  # 1-based row number in the date range
    tests = [
        F.col("_age") < rules.impulse_lookback,
        rn > rules.base_lookback,
        F.col("base_range_pct") <= rules.base_max_range_pct,
        F.col("base_vol_cv") <= rules.base_max_vol_cv,
        F.col("base_vol_shrink") <= rules.base_vol_shrink_ratio_max,
        holds(F.col("pct_chg") >= rules.min_impulse_pct * 100) | is_limit_up(rules),
        F.col("vol_ratio") >= rules.min_impulse_vol_ratio,
        F.col("close") > F.col("prev_high") * rules.breakout_factor,
    ]
    if "turnover_rate" in tail.columns:
        tests.append(F.coalesce(F.col("turnover_rate") >= rules.min_turnover_rate, F.lit(True)))
    return holds(reduce(and_, tests))


# Measures of the impulse and their names in the result.
IMPULSE_COLUMNS = {
    "close": "impulse_close",
    "high": "impulse_high",
    "vol": "impulse_vol",
    "pct_chg": "impulse_pct_chg",
    "vol_ratio": "impulse_vol_ratio",
    "prev_high": "platform_high_before",
    "base_range_pct": "base_range_pct",
    "base_vol_cv": "base_vol_cv",
}


def impulse_candidates(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Recent bars that break out of a quiet base."""
    tail = _screen_tail(bars, rules)
    return tail.where(_is_impulse(tail, rules)).select(
        SYMBOL, F.col(DATE).alias("impulse_date"), *[F.col(c).alias(n) for c, n in IMPULSE_COLUMNS.items()]
    )


def last_impulse(candidates: DataFrame) -> DataFrame:
    """The most recent impulse of each symbol."""
    values = [c for c in candidates.columns if c not in (SYMBOL, "impulse_date")]
    return candidates.groupBy(SYMBOL).agg(
        *[F.max_by(c, "impulse_date").alias(c) for c in values], F.max("impulse_date").alias("impulse_date")
    )


def pullback_legs(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Per symbol with an impulse: its last impulse, the first-leg high and the bars since.

    Windows and the final aggregate use the partitioning of the one shuffle by symbol.
    """
    tail = _screen_tail(bars, rules)
    age = F.col("_age")
    marked = tail.withColumn("_impulse", F.min(F.when(_is_impulse(tail, rules), age)).over(whole_symbol())).where(
        F.col("_impulse").isNotNull()
    )
    # bars from the impulse on, plus the two latest for the late-spike rule
    leg = marked.withColumn("_high", F.max(F.when(age <= F.col("_impulse"), F.col("high"))).over(whole_symbol())).withColumn(
        "_high_age", F.max(F.when((age <= F.col("_impulse")) & (F.col("high") == F.col("_high")), age)).over(whole_symbol())
    )
    at_impulse = age == F.col("_impulse")
    latest = age == 0
    late = holds(
        (F.col("pct_chg") > rules.late_spike_pct) & (F.col("vol") > F.col("vma20") * rules.late_spike_vol_ratio)
    ) & (age < 2)
    return leg.groupBy(SYMBOL).agg(
        F.max(DATE).alias(DATE),
        *[F.max(F.when(latest, F.col(c))).alias(c) for c in ("close", "ma10", "ma20")],
        F.max(F.when(at_impulse, F.col(DATE))).alias("impulse_date"),
        *[F.max(F.when(at_impulse, F.col(c))).alias(n) for c, n in IMPULSE_COLUMNS.items()],
        F.max("_impulse").alias("days_after_impulse"),
        F.max("_high").alias("first_leg_high"),
        F.max("_high_age").alias("pullback_days"),
        F.avg(F.when(age < F.col("_high_age"), F.col("vol"))).alias("pullback_mean_vol"),
        F.bool_or(late).alias("late_spike"),
    )


def rejections(rules: ScreenRules = ScreenRules()) -> dict[str, Column]:
    """Reasons to reject a leg; a rule over a missing value does not reject."""
    close = F.col("close")
    days = F.col("pullback_days")
    after = F.col("days_after_impulse")
    return {
        "price": ~price_ok(rules, close),
        "days_after_impulse": (after < rules.min_pullback_days) | (after > rules.max_days_after_impulse),
        "pullback_days": (days < max(1, rules.min_pullback_days)) | (days > rules.max_pullback_days),
        "pullback_pct": (F.col("pullback_pct") < rules.min_pullback_pct)
        | (F.col("pullback_pct") > rules.max_pullback_pct),
        "pullback_volume": F.col("pullback_vol_ratio") > rules.max_pullback_vol_ratio,
        "below_impulse_close": close < F.col("impulse_close") * (1 - rules.max_close_below_breakout_close),
        "below_ma10": close < F.col("ma10") * rules.min_above_ma10_ratio,
        "below_platform": close < F.col("platform_high_before") * rules.min_above_platform_ratio,
        "no_pullback": close >= F.col("first_leg_high") * rules.below_first_leg_factor,
        "late_spike": F.col("late_spike"),
    }


def measured_legs(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    return pullback_legs(bars, rules).withColumns(
        {
            "pullback_pct": (F.col("first_leg_high") - F.col("close")) / (F.col("first_leg_high") + GUARD),
            "pullback_vol_ratio": F.col("pullback_mean_vol") / (F.col("impulse_vol") + GUARD),
        }
    )


def first_rejection(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Every measured leg with the first rule that rejects it, NULL where none does."""
    reason = F.coalesce(*[F.when(holds(rule), name) for name, rule in rejections(rules).items()])
    return measured_legs(bars, rules).withColumn("rejected_by", reason)


def pattern_score() -> Column:
    """Five terms of 0 to 20: tight base, even volume, strong impulse, shallow and quiet pullback."""
    zero, top = F.lit(0.0), F.lit(20.0)
    return (
        F.greatest(zero, top - F.col("base_range_pct") * 40)
        + F.greatest(zero, top - F.col("base_vol_cv") * 20)
        + F.least(top, F.col("impulse_vol_ratio") * 4)
        + F.greatest(zero, top - F.col("pullback_pct") * 100)
        + F.greatest(zero, top - F.col("pullback_vol_ratio") * 20)
    )


def detect_pattern(bars: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """One row per symbol whose latest bar completes the pattern."""
    hits = first_rejection(bars, rules).where(F.col("rejected_by").isNull()).withColumn("score", pattern_score())

    def shown(column: str, factor: float = 1.0) -> Column:
        value = F.col(column) * F.lit(factor) if factor != 1.0 else F.col(column)
        return F.round(value, 2).alias(column)

    return hits.select(
        SYMBOL,
        DATE,
        shown("close"),
        "impulse_date",
        shown("impulse_pct_chg"),
        shown("impulse_vol_ratio"),
        shown("first_leg_high"),
        shown("pullback_pct", 100.0),
        "pullback_days",
        shown("pullback_vol_ratio"),
        shown("ma10"),
        shown("ma20"),
        shown("platform_high_before"),
        shown("score"),
    )


def ranked_candidates(hits: DataFrame, top_n: int | None = None) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), F.asc("pullback_pct"), F.desc("impulse_vol_ratio"), SYMBOL)
    return ordered.limit(top_n) if top_n else ordered


def screen(bars: DataFrame, rules: ScreenRules = ScreenRules(), top_n: int | None = None) -> DataFrame:
    """Coarse filter over all bars, detection inside the date range, ranking."""
    hits = detect_pattern(bars, rules).join(prefilter(bars, rules).select(SYMBOL), SYMBOL, "left_semi")
    return ranked_candidates(hits, top_n)
