"""Queries over the rule-based screener, with thresholds that fire on the derived bars."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.catalog.inputs import RULES, derived
from barloom.catalog.oracle import W, over, r, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import counted, rounded
from barloom.operators import screener as s

PREFILTER = f"""
select ts_code, max(n) as n_bars, max(case when age = 1 then close end) as close
from (select *, row_number() over (partition by ts_code order by trade_date desc) as age,
             count(*) over (partition by ts_code) as n,
             case when count(vol) {over(-4)} = 5 then avg(vol) {over(-4)} end as v5 from index_bars) b
where age <= 20 group by ts_code
having max(n) >= 25 and bool_or(coalesce(pct_chg >= {RULES.prefilter_min_pct_chg}, false) or coalesce(vol > v5 * 1.8e0, false))
"""


@query("screen_prefilter", sql(f"select ts_code, n_bars, {r('close', 'close')} from prefilter", prefilter=PREFILTER))
def prefilter(spark, sf):
    return rounded(s.prefilter(derived(spark, sf, "index_bars"), RULES))


LIMIT = "case when ts_code like 'S0000%' then 2.5 else 3.0 end"
LIMIT_RULES = s.ScreenRules(limit_up_pct=3.0, wide_limit_up_pct=2.5, wide_limit_prefixes=("S0000",))


@query(
    "limit_up_bars",
    sql(f"select ts_code, trade_date, {r('pct_chg', 'pct_chg')} from index_bars where pct_chg >= {LIMIT}"),
)
def limit_up(spark, sf):
    bars = derived(spark, sf, "index_bars").where(s.is_limit_up(LIMIT_RULES))
    return rounded(bars.select("ts_code", "trade_date", "pct_chg"))


TAIL = f"""
select *, max(high) {over(-100, -1)} / (min(low) {over(-100, -1)} + 1e-9) - 1 as base_range_pct,
       stddev_samp(vol) {over(-100, -1)} / (avg(vol) {over(-100, -1)} + 1e-9) as base_vol_cv,
       avg(vol) {over(-20, -1)} / (avg(vol) {over(-100, -1)} + 1e-9) as base_vol_shrink,
       vol / (avg(vol) {over(-20, -1)} + 1e-9) as vol_ratio,
       max(high) {over(-90, -1)} as prev_high, avg(close) {over(-9)} as ma10, avg(close) {over(-19)} as ma20,
       avg(vol) {over(-19)} as vma20, row_number() over ({W}) as rn, count(*) over (partition by ts_code) as n,
       row_number() over (partition by ts_code order by trade_date desc) - 1 as age
from index_bars
"""
IMPULSES = f"""
select * from tail where n >= 160 and age < 20 and rn > 100
  and base_range_pct <= {RULES.base_max_range_pct} and base_vol_cv <= {RULES.base_max_vol_cv}
  and base_vol_shrink <= {RULES.base_vol_shrink_ratio_max} and (pct_chg >= 1.0e0 or pct_chg >= 9.5)
  and vol_ratio >= {RULES.min_impulse_vol_ratio} and close > prev_high * {RULES.breakout_factor}e0
"""
IMPULSE_SQL = ", ".join(
    r(c, n) for c, n in s.IMPULSE_COLUMNS.items()
)


@query(
    "impulse_candidates",
    sql(f"select ts_code, trade_date as impulse_date, {IMPULSE_SQL} from impulses", tail=TAIL, impulses=IMPULSES),
)
def candidates(spark, sf):
    return rounded(s.impulse_candidates(derived(spark, sf, "index_bars"), RULES))


# the platform reaches further back than the base, and a base shorter than the averages
LONG = replace(RULES, breakout_lookback=150)
SHORT = replace(RULES, base_lookback=10)
SHORT_TAIL = TAIL.replace(over(-100, -1), over(-10, -1)).replace(over(-20, -1), over(-10, -1))


@query(
    "impulse_candidates_long_breakout",
    sql(
        f"select ts_code, trade_date as impulse_date, {IMPULSE_SQL} from impulses",
        tail=TAIL.replace(over(-90, -1), over(-150, -1)),
        impulses=IMPULSES,
    ),
)
def candidates_of_long_platform(spark, sf):
    return rounded(s.impulse_candidates(derived(spark, sf, "index_bars"), LONG))


@query(
    "impulse_candidates_short_base",
    sql(
        f"select ts_code, trade_date as impulse_date, {IMPULSE_SQL} from impulses",
        tail=SHORT_TAIL,
        impulses=IMPULSES.replace("rn > 100", "rn > 10"),
    ),
)
def candidates_of_short_base(spark, sf):
    return rounded(s.impulse_candidates(derived(spark, sf, "index_bars"), SHORT))


LAST = "select * from (select *, row_number() over (partition by ts_code order by age) as nth from impulses) i where nth = 1"


@query(
    "last_impulse",
    sql(
        f"select ts_code, trade_date as impulse_date, {IMPULSE_SQL} from last_impulses",
        tail=TAIL,
        impulses=IMPULSES,
        last_impulses=LAST,
    ),
)
def last(spark, sf):
    return rounded(s.last_impulse(s.impulse_candidates(derived(spark, sf, "index_bars"), RULES)))


LEGS = """
select t.ts_code, max(t.trade_date) as trade_date, max(case when t.age = 0 then t.close end) as close,
       max(case when t.age = 0 then t.ma10 end) as ma10, max(case when t.age = 0 then t.ma20 end) as ma20,
       max(i.trade_date) as impulse_date, max(i.close) as impulse_close, max(i.vol) as impulse_vol,
       max(i.pct_chg) as impulse_pct_chg, max(i.vol_ratio) as impulse_vol_ratio, max(i.prev_high) as platform_high_before,
       max(i.base_range_pct) as base_range_pct, max(i.base_vol_cv) as base_vol_cv,
       max(i.age)::bigint as days_after_impulse, max(h.top) as first_leg_high, max(h.top_age)::bigint as pullback_days,
       avg(case when t.age < h.top_age then t.vol end) as pullback_mean_vol,
       bool_or(t.age < 2 and t.pct_chg > 7.0 and t.vol > t.vma20 * 2) as late_spike
from tail t join last_impulses i on t.ts_code = i.ts_code
join (select x.ts_code, max(x.high) as top, arg_max(x.age, (x.high, x.age)) as top_age
      from tail x join last_impulses y on x.ts_code = y.ts_code and x.age <= y.age group by x.ts_code) h on t.ts_code = h.ts_code
group by t.ts_code
"""
STEPS = {"tail": TAIL, "impulses": IMPULSES, "last_impulses": LAST, "legs": LEGS}
LEG_DOUBLES = ["close", "ma10", "ma20", "impulse_vol_ratio", "platform_high_before", "base_range_pct", "base_vol_cv",
               "first_leg_high", "pullback_mean_vol"]


@query(
    "pullback_legs",
    sql(
        "select ts_code, trade_date, impulse_date, days_after_impulse, pullback_days, late_spike, "
        + ", ".join(r(c, c) for c in LEG_DOUBLES)
        + " from legs",
        **STEPS,
    ),
)
def legs(spark, sf):
    found = counted(s.pullback_legs(derived(spark, sf, "index_bars"), RULES), "days_after_impulse", "pullback_days")
    return rounded(
        found.select("ts_code", "trade_date", "impulse_date", "days_after_impulse", "pullback_days", "late_spike", *LEG_DOUBLES)
    )


MEASURED = """
select *, (first_leg_high - close) / (first_leg_high + 1e-9) as pullback_pct, pullback_mean_vol / (impulse_vol + 1e-9) as pullback_vol_ratio
from legs
"""
JUDGED = f"""
select *, case when days_after_impulse < 2 or days_after_impulse > 15 then 'days_after_impulse'
     when pullback_days < 2 or pullback_days > 8 then 'pullback_days'
     when pullback_pct < {RULES.min_pullback_pct} or pullback_pct > {RULES.max_pullback_pct} then 'pullback_pct'
     when pullback_vol_ratio > {RULES.max_pullback_vol_ratio} then 'pullback_volume'
     when close < impulse_close * {1 - RULES.max_close_below_breakout_close} then 'below_impulse_close'
     when close < ma10 * {RULES.min_above_ma10_ratio}e0 then 'below_ma10'
     when close < platform_high_before * {RULES.min_above_platform_ratio}e0 then 'below_platform'
     when close >= first_leg_high * {RULES.below_first_leg_factor} then 'no_pullback'
     when late_spike then 'late_spike' end as rejected_by
from measured
"""
STEPS |= {"measured": MEASURED, "judged": JUDGED}


@query("first_rejection", sql(f"select ts_code, {r('pullback_pct', 'pullback_pct')}, rejected_by from judged", **STEPS))
def rejected(spark, sf):
    found = s.first_rejection(derived(spark, sf, "index_bars"), RULES)
    return rounded(found.select("ts_code", "pullback_pct", "rejected_by"))


SHOWN = [("close", 1), ("impulse_pct_chg", 1), ("impulse_vol_ratio", 1), ("first_leg_high", 1), ("pullback_pct", 100),
         ("pullback_vol_ratio", 1), ("ma10", 1), ("ma20", 1), ("platform_high_before", 1)]
SCORE = """greatest(0, 20 - base_range_pct * 40) + greatest(0, 20 - base_vol_cv * 20) + least(20, impulse_vol_ratio * 4)
 + greatest(0, 20 - pullback_pct * 100) + greatest(0, 20 - pullback_vol_ratio * 20)"""
HITS = (
    "select ts_code, trade_date, impulse_date, pullback_days, "
    + ", ".join(f"round({c} * {k}, 2) as {c}" for c, k in SHOWN)
    + f", round({SCORE}, 2) as score from judged where rejected_by is null"
)


@query("detect_pattern", sql(HITS, **STEPS))
def detected(spark, sf):
    return counted(s.detect_pattern(derived(spark, sf, "index_bars"), RULES), "pullback_days")


@query(
    "screen",
    sql(
        """select h.* from hits h join prefilter p on h.ts_code = p.ts_code
        order by score desc, pullback_pct, impulse_vol_ratio desc, h.ts_code limit 200""",
        **STEPS,
        hits=HITS,
        prefilter=PREFILTER,
    ),
)
def screened(spark, sf):
    return counted(s.screen(derived(spark, sf, "index_bars"), RULES, top_n=200), "pullback_days")


@query(
    "screen_rejections",
    sql("select coalesce(rejected_by, 'kept') as outcome, count(*) as n from judged group by 1", **STEPS),
)
def rejection_counts(spark, sf):
    found = s.first_rejection(derived(spark, sf, "index_bars"), RULES)
    return found.groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
