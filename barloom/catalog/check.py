"""Queries over quality rules and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived
from barloom.catalog.oracle import sql
from barloom.catalog.registry import query
from barloom.catalog.shape import counted
from barloom.operators import quality as q
from barloom.operators.normalize import CONTRACT_UNITS, normalize_bars
from barloom.plans.jobs import scan_skips

BAD_VALUE = "label is not null and label not in (0, 1)"


@query(
    "validate_labels",
    sql(
        f"""select count(*) as num_labels, count_if(asof_date is null)::bigint as invalid_asof_date,
        (select sum(n - 1) from (select count(*) as n from bad_labels group by sample_id) g)::bigint as duplicate_sample_id,
        count_if(label is null)::bigint as null_label, count_if({BAD_VALUE})::bigint as invalid_label,
        false as ok from bad_labels"""
    ),
)
def validate_labels(spark, sf):
    return q.validate_labels(derived(spark, sf, "bad_labels"))


@query(
    "invalid_label_values",
    sql(f"select cast(label as string) as value, count(*) as n from bad_labels where {BAD_VALUE} group by label"),
)
def invalid_label_values(spark, sf):
    return q.invalid_label_values(derived(spark, sf, "bad_labels"))


@query(
    "bar_schema",
    sql("select count(*) as n_bars, count_if(trade_date is null)::bigint as invalid_trade_date from bad_bars"),
)
def bar_schema(spark, sf):
    return q.validate_bar_schema(derived(spark, sf, "bad_bars"))


def _bad(column: str, sign: str) -> str:
    return f"count_if({column} is null or {column} {sign} 0)::bigint"


QUALITY = f"""
select ts_code, count(*) as n_bars, count_if(trade_date is null)::bigint as invalid_trade_date,
       count(trade_date) - count(distinct trade_date) as duplicate_dates,
       {', '.join(f"{_bad(c, '<=')} as invalid_{c}" for c in ('open', 'high', 'low', 'close'))},
       count_if(high < low or high < open or high < close)::bigint as high_inconsistent,
       count_if(low > open or low > close)::bigint as low_inconsistent,
       {_bad('vol', '<')} as invalid_vol, {_bad('amount', '<')} as invalid_amount
from bad_bars group by ts_code
"""
DESCENTS = """
select ts_code, count_if(trade_date < before)::bigint as descents from (
  select *, lag(trade_date) over (partition by ts_code order by _ord) as before from bad_bars where trade_date is not null) x
group by ts_code
"""


@query(
    "bar_quality",
    sql(
        """select *, case when invalid_trade_date > 0 then concat('daily has invalid trade_date rows: ', invalid_trade_date)
          else concat_ws('; ', case when descents > 0 then 'daily trade_date is not ascending' end,
            case when duplicate_dates > 0 then concat('daily has duplicate trade_date rows: ', duplicate_dates) end,
            case when invalid_open > 0 then concat('daily has invalid open rows: ', invalid_open) end,
            case when invalid_high > 0 then concat('daily has invalid high rows: ', invalid_high) end,
            case when invalid_low > 0 then concat('daily has invalid low rows: ', invalid_low) end,
            case when invalid_close > 0 then concat('daily has invalid close rows: ', invalid_close) end,
            case when high_inconsistent > 0 then 'daily has OHLC inconsistency: high below low/open/close' end,
            case when low_inconsistent > 0 then 'daily has OHLC inconsistency: low above open/close' end,
            case when invalid_vol > 0 then concat('daily has invalid vol rows: ', invalid_vol) end,
            case when invalid_amount > 0 then concat('daily has invalid amount rows: ', invalid_amount) end) end as messages,
          (invalid_trade_date + descents + duplicate_dates + invalid_open + invalid_high + invalid_low + invalid_close
           + high_inconsistent + low_inconsistent + invalid_vol + invalid_amount) = 0 as ok
        from quality join descents using (ts_code)""",
        quality=QUALITY,
        descents=DESCENTS,
    ),
)
def bar_quality(spark, sf):
    report = q.bar_quality(derived(spark, sf, "bad_bars"))
    return report.withColumn("messages", F.concat_ws("; ", "messages"))


ONE_PER_DAY = """
select ts_code, trade_date, open, high, low, close, vol, amount from (
  select *, row_number() over (partition by ts_code, trade_date order by _ord) as place
  from bad_bars where trade_date is not null) x where place = 1
"""
ROW_FAULT = """open is null or open <= 0 or high is null or high <= 0 or low is null or low <= 0 or close is null or close <= 0
 or high < low or high < open or high < close or low > open or low > close or vol is null or vol < 0 or amount is null or amount < 0"""
SOUND = f"select * from one_per_day b anti join (select distinct ts_code from one_per_day where {ROW_FAULT}) f on b.ts_code = f.ts_code"


def _sound(spark, sf):
    bars = normalize_bars(derived(spark, sf, "bad_bars"), CONTRACT_UNITS, duplicate_policy="first")
    return q.keep_sound_symbols(bars)


@query(
    "sound_symbols",
    sql(
        "select ts_code, count(*) as n_bars, round(sum(close), 4) as total_close from sound group by ts_code",
        one_per_day=ONE_PER_DAY,
        sound=SOUND,
    ),
)
def sound_symbols(spark, sf):
    return _sound(spark, sf).groupBy("ts_code").agg(
        F.count("*").alias("n_bars"), F.round(F.sum("close"), 4).alias("total_close")
    )


ALIGNED = """
select l.sample_id, l.ts_code, l.asof_date, l.label,
       case when first_trade is null then 'missing_daily_file'
            when l.asof_date < first_trade or l.asof_date > last_trade then 'asof_not_covered'
            when h.history_len < 300 then 'insufficient_history' end as issue,
       coalesce(h.history_len, 0) as history_len
from (select * from bad_labels where asof_date is not null) l
left join (select ts_code, min(trade_date) as first_trade, max(trade_date) as last_trade from price_bars group by ts_code) s
  on l.ts_code = s.ts_code
asof left join (select ts_code, trade_date, row_number() over (partition by ts_code order by trade_date) as history_len
                from price_bars) h on l.ts_code = h.ts_code and l.asof_date >= h.trade_date
"""


@query("label_alignment", sql("select * from aligned", aligned=ALIGNED))
def label_alignment(spark, sf):
    found = q.label_alignment(derived(spark, sf, "bad_labels"), derived(spark, sf, "price_bars"), 300)
    return counted(found, "history_len").select("sample_id", "ts_code", "asof_date", "label", "issue", "history_len")


# labels of every 17th symbol have lost it
UNNAMED = "select sample_id, case when cast(substr(ts_code, 2) as bigint) % 17 = 3 then null else ts_code end as ts_code, asof_date, label from bar_labels"


@query(
    "label_alignment_unnamed",
    sql("select * from aligned", unnamed=UNNAMED, aligned=ALIGNED.replace("bad_labels", "unnamed")),
)
def label_alignment_unnamed(spark, sf):
    labels = derived(spark, sf, "bar_labels").withColumn(
        "ts_code", F.when(F.substring("ts_code", 2, 99).cast("bigint") % 17 != 3, F.col("ts_code"))
    )
    found = q.label_alignment(labels, derived(spark, sf, "price_bars"), 300)
    return counted(found, "history_len").select("sample_id", "ts_code", "asof_date", "label", "issue", "history_len")


# every third symbol comes from a file without the optional amount
HALF_BARE = """select * exclude (amount), case when cast(substr(ts_code, 2) as bigint) % 3 <> 1 then amount end as amount from bad_bars"""


@query(
    "bar_quality_without_amount",
    sql(
        """select ts_code, n_bars, case when cast(substr(ts_code, 2) as bigint) % 3 = 1 then 0 else invalid_amount end as invalid_amount,
        duplicate_dates, invalid_vol from quality""",
        half_bare=HALF_BARE,
        quality=QUALITY.replace("from bad_bars", "from half_bare"),
    ),
)
def bar_quality_without_amount(spark, sf):
    bars = derived(spark, sf, "bad_bars").withColumn(
        "amount", F.when(F.substring("ts_code", 2, 99).cast("bigint") % 3 != 1, F.col("amount"))
    )
    return q.bar_quality(bars).select("ts_code", "n_bars", "invalid_amount", "duplicate_dates", "invalid_vol")


@query(
    "scan_skips",
    sql(
        """select ts_code, num_dates, reason from (
          select ts_code, count(trade_date) as num_dates,
                 case when count(trade_date) = 0 then 'no_valid_date' when max(case when trade_date is not null then n end) > 1 then 'duplicate_dates'
                      when count(trade_date) < 500 then 'insufficient_history' end as reason
          from (select ts_code, trade_date, count(*) as n from bad_bars group by ts_code, trade_date) d group by ts_code) s
        where reason is not null"""
    ),
)
def skipped_by_a_scan(spark, sf):
    return scan_skips(derived(spark, sf, "bad_bars"), 120, 500)


@query(
    "alignment_counts",
    sql(
        """select count(*) as num_labels, count_if(issue = 'missing_daily_file')::bigint as missing_daily_file,
        count_if(issue = 'asof_not_covered')::bigint as asof_not_covered,
        count_if(issue = 'insufficient_history')::bigint as insufficient_history, count(issue) = 0 as ok from aligned""",
        aligned=ALIGNED,
    ),
)
def alignment_counts(spark, sf):
    return q.alignment_counts(
        q.label_alignment(derived(spark, sf, "bad_labels"), derived(spark, sf, "price_bars"), 300)
    )


WRONG_ID = "sample_id != ts_code || '_' || cast(asof_date as string)"
CONTRACT = f"""
select count(*) as num_rows, count_if(ts_code is null)::bigint as num_null_ts_code,
       count_if(asof_date is null)::bigint as num_null_asof_date, count_if(label is null)::bigint as num_null_label,
       count_if({BAD_VALUE})::bigint as num_invalid_label, count_if({WRONG_ID})::bigint as num_inconsistent_sample_id,
       (select sum(n - 1) from (select count(*) as n from bad_labels group by sample_id) g)::bigint as duplicate_sample_id_count,
       (select sum(n - 1) from (select count(*) as n from bad_labels group by ts_code, asof_date) g)::bigint
         as duplicate_ts_code_asof_date_count
from bad_labels
"""


@query("label_contract", sql("select * from contract", contract=CONTRACT))
def label_contract(spark, sf):
    return q.label_contract(derived(spark, sf, "bad_labels"))


@query(
    "inconsistent_sample_ids",
    sql(
        f"""select sample_id, concat(ts_code, '_', cast(asof_date as string)) as expected_sample_id
        from bad_labels where {WRONG_ID} order by 1, 2 limit 10"""
    ),
)
def inconsistent_sample_ids(spark, sf):
    return q.inconsistent_sample_ids(derived(spark, sf, "bad_labels"))


@query("label_distribution", sql("select label, count(*) as n from bad_labels group by label"))
def label_distribution(spark, sf):
    return q.label_distribution(derived(spark, sf, "bad_labels"))


@query(
    "bar_contract",
    sql(
        f"""select ts_code, count(*) as num_rows, count_if(trade_date is null)::bigint as num_invalid_trade_date,
        count(trade_date) - count(distinct trade_date) as duplicate_trade_date_count,
        {', '.join(f"count_if({c} <= 0)::bigint as num_nonpositive_{c}" for c in ('open', 'high', 'low', 'close'))},
        count_if(vol < 0)::bigint as num_negative_vol from bad_bars group by ts_code"""
    ),
)
def bar_contract(spark, sf):
    return q.bar_contract(derived(spark, sf, "bad_bars"))


LENIENT = """
select count(*) as num_label_rows, count_if(issue = 'missing_daily_file')::bigint as num_missing_daily_files,
       count_if(issue = 'asof_not_covered' and history_len = 0)::bigint as num_asof_before_first_trade,
       count_if(issue is distinct from 'missing_daily_file' and history_len > 0 and history_len < 300)::bigint as num_history_too_short
from aligned
"""


@query("contract_alignment", sql("select * from lenient", aligned=ALIGNED, lenient=LENIENT))
def contract_alignment(spark, sf):
    return q.contract_alignment(derived(spark, sf, "bad_labels"), derived(spark, sf, "price_bars"), 300)


@query(
    "universe_summary",
    sql(
        """select count(*) as num_symbols, (select string_agg(ts_code, ',' order by ts_code) from
        (select distinct ts_code from price_bars order by 1 limit 10) f) as first_symbols
        from (select distinct ts_code from price_bars) s"""
    ),
)
def universe_summary(spark, sf):
    return q.universe_summary(derived(spark, sf, "price_bars"))


FINDINGS = " union all ".join(
    f"select '{scope}' as scope, '{severity}' as severity, '{rule}' as rule, '{text}' as message, {rule} as n from {source}"
    for scope, source, rules in (("labels", "contract", q.LABEL_FINDINGS), ("alignment", "lenient", q.ALIGNMENT_FINDINGS))
    for rule, (severity, text) in rules.items()
)


@query(
    "contract_findings",
    sql("select * from findings where n > 0", aligned=ALIGNED, lenient=LENIENT, contract=CONTRACT, findings=FINDINGS),
)
def contract_findings(spark, sf):
    return q.contract_findings(derived(spark, sf, "bad_labels"), derived(spark, sf, "price_bars"), 300)


@query(
    "contract_verdict",
    sql(
        """select count_if(severity = 'error')::bigint as num_errors, count_if(severity = 'warning')::bigint as num_warnings,
        count_if(severity = 'error') = 0 as ok from findings where n > 0""",
        aligned=ALIGNED,
        lenient=LENIENT,
        contract=CONTRACT,
        findings=FINDINGS,
    ),
)
def contract_verdict(spark, sf):
    return q.contract_verdict(
        q.contract_findings(derived(spark, sf, "bad_labels"), derived(spark, sf, "price_bars"), 300)
    )
