"""Helpers that put together the check queries for a plain SQL engine."""

from __future__ import annotations

import re

from barloom.catalog.inputs import INPUTS
from barloom.catalog.shape import NUDGE

W = "partition by ts_code order by trade_date"


def over(frame_start: int, frame_end: int = 0) -> str:
    """A ROWS frame between offsets, negative is preceding."""
    end = "current row" if frame_end == 0 else f"{-frame_end} preceding"
    return f"over ({W} rows between {-frame_start} preceding and {end})"


def features_sql(source: str) -> str:
    """All features of 120-row windows over bars without missing values, as plain frames."""
    return f"""
select ts_code, trade_date, rn, window_start,
       max(high) {over(-119)} / min(low) {over(-119)} - 1 as base_range_pct,
       stddev_pop(vol) {over(-119)} / avg(vol) {over(-119)} as base_vol_cv,
       avg(vol) {over(-19)} / avg(vol) {over(-79, -20)} as vol_shrink_ratio,
       close / lag(close, 5) over ({W}) - 1 as recent_return_5,
       close / lag(close, 10) over ({W}) - 1 as recent_return_10,
       close / max(high) {over(-20, -1)} - 1 as breakout_distance_20,
       close / max(high) {over(-60, -1)} - 1 as breakout_distance_60,
       vol / avg(vol) {over(-20, -1)} as volume_spike_ratio,
       avg(case when close > m10 then 1.0e0 else 0 end) {over(-110)} as above_ma10_ratio,
       avg(case when close > m20 then 1.0e0 else 0 end) {over(-100)} as above_ma20_ratio,
       stddev_pop(ret) {over(-19)} as volatility_20
from (
  select *, close / lag(close) over ({W}) - 1 as ret, row_number() over ({W}) as rn,
         lag(trade_date, 119) over ({W}) as window_start,
         avg(close) {over(-9)} as m10, avg(close) {over(-19)} as m20
  from {source}) b
"""


DERIVED = {
    **INPUTS,
    "price_features": features_sql("price_bars"),
    "index_features": features_sql("index_bars"),
    "windows": """
select l.*, f.* exclude (ts_code) from bar_labels l
asof join index_features f on l.ts_code = f.ts_code and l.asof_date >= f.trade_date
""",
    "preds": """
select sample_id, ts_code, asof_date, label as y_true, future_return,
       round(1 / (1 + exp(-20 * recent_return_10)), 6) as score_a,
       round(1 / (1 + exp(-10 * breakout_distance_20)), 6) as score_b
from windows where rn >= 120
""",
    "top_flags": """
select *, row_number() over (order by score_a desc, sample_id) <= 50 as in_a,
       row_number() over (order by score_b desc, sample_id) <= 50 as in_b
from preds
""",
    "long_preds": """
select sample_id, 'a' as model, y_true, score_a as y_score from preds
union all select sample_id, 'b', y_true, score_b from preds
""",
}


def sql(body: str, **extra: str) -> str:
    """Prefix the common tables that `body` needs, in order of their dependencies."""
    known = {**DERIVED, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b(?:from|join) {name}\b", text) and name not in needed:
                visit(known[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({known[n]})" for n in needed) + "\n" + body


def r(expression: str, name: str, digits: int = 6) -> str:
    """A rounded column as in `rounded`; what rounds to zero is a plain zero, not a negative one."""
    moved = f"({expression}) + {NUDGE}e-{digits}"
    return f"case when abs({moved}) < 5e-{digits + 1} then 0.0e0 else round({moved}, {digits}) end as {name}"


def r_all(columns: list[str], prefix: str = "", digits: int = 6) -> str:
    return ", ".join(r(f"{prefix}{c}", c, digits) for c in columns)
