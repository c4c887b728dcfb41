"""Data-quality rules for bars and labels, and their alignment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (
    count_if,
    holds,
    merge_rows,
    sample_id,
    sample_id_or_flag,
    to_date,
    to_number,
)
from barloom.functions.frames import whole_symbol
from barloom.schema import ASOF, DATE, FILE, ORDER, PRICES, REQUIRED_BAR_COLUMNS, REQUIRED_LABEL_COLUMNS, SAMPLE, SYMBOL
from barloom.session import materialize

ORDER_CHUNK = 65_536  # rows of one file whose order is checked in one task
KEYED_ROWS = 500_000  # rows whose keys are put together in one task before they are exchanged


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], what: str) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")


def _bar_rules(columns: list[str]) -> dict[str, Column]:
    """Row-level faults, in the order in which they are reported."""
    rules = {f"invalid_{c}": F.col(c).isNull() | (F.col(c) <= 0) for c in PRICES}
    rules["high_inconsistent"] = reduce(or_, [holds(F.col("high") < F.col(c)) for c in ("low", "open", "close")])
    rules["low_inconsistent"] = reduce(or_, [holds(F.col("low") > F.col(c)) for c in ("open", "close")])
    rules["invalid_vol"] = F.col("vol").isNull() | (F.col("vol") < 0)
    if "amount" in columns:
        rules["invalid_amount"] = F.col("amount").isNull() | (F.col("amount") < 0)
    return rules


def _descents(bars: DataFrame) -> DataFrame:
    """How often a date goes back in the order of a file, per symbol; files follow in no order of time.

    The order is checked inside chunks of a file, and then between the ends of the chunks.
    """
    whole = [SYMBOL, *[c for c in [FILE] if c in bars.columns]]
    dated = bars.where(F.col(DATE).isNotNull()).select(
        *whole, DATE, ORDER, F.floor(F.col(ORDER) / ORDER_CHUNK).alias("_chunk")
    )
    inside = Window.partitionBy(*whole, "_chunk").orderBy(ORDER)
    back = F.col(DATE) < F.lag(DATE).over(inside)
    chunks = (
        dated.withColumn("_back", holds(back).cast("int"))
        .groupBy(*whole, "_chunk")
        .agg(
            F.sum("_back").alias("_back"),
            F.min_by(DATE, ORDER).alias("_start"),
            F.max_by(DATE, ORDER).alias("_end"),
        )
    )
    between = Window.partitionBy(*whole).orderBy("_chunk")
    return (
        chunks.withColumn("_step", holds(F.col("_start") < F.lag("_end").over(between)).cast("int"))
        .groupBy(SYMBOL)
        .agg((F.sum("_back") + F.sum("_step")).alias("descents"))
    )


def bar_quality(bars: DataFrame) -> DataFrame:
    """One row per symbol: fault counts, messages and `ok`.

    File order is checked where the bars carry it; normalised bars have no order to break.
    """
    require_columns(bars, REQUIRED_BAR_COLUMNS, "bars")
    numbers = [c for c in [*PRICES, "vol", "amount"] if c in bars.columns]
    dtype = bars.schema[DATE].dataType
    clean = bars.withColumns({DATE: to_date(DATE, dtype), **{c: to_number(c) for c in numbers}})
    rules = _bar_rules(bars.columns)
    report = clean.groupBy(SYMBOL).agg(
        F.count("*").alias("n_bars"),
        count_if(F.col(DATE).isNull()).alias("invalid_trade_date"),
        (F.count(DATE) - F.countDistinct(DATE)).alias("duplicate_dates"),
        *[count_if(rule).alias(name) for name, rule in rules.items()],
        *([F.count("amount").alias("_amounts")] if "amount" in bars.columns else []),
    )
    if "amount" in bars.columns:
        # a symbol without any amount comes from a file that lacks the optional column
        given = F.col("_amounts") > 0
        report = report.withColumn("invalid_amount", F.when(given, F.col("invalid_amount")).otherwise(0)).drop("_amounts")
    if ORDER in bars.columns:
        report = report.join(_descents(clean), SYMBOL, "left").fillna(0, ["descents"])
    else:
        report = report.withColumn("descents", F.lit(0).cast("bigint"))

    def message(column: str, text: str, counted: bool = True) -> Column:
        shown = F.concat(F.lit(f"{text}: "), F.col(column).cast("string")) if counted else F.lit(text)
        return F.when(F.col(column) > 0, shown)

    # The messages, in the order in which they are given.
    texts = [
        message("descents", "daily trade_date is not ascending", False),
        message("duplicate_dates", "daily has duplicate trade_date rows"),
        *[message(f"invalid_{c}", f"daily has invalid {c} rows") for c in PRICES],
        message("high_inconsistent", "daily has OHLC inconsistency: high below low/open/close", False),
        message("low_inconsistent", "daily has OHLC inconsistency: low above open/close", False),
        message("invalid_vol", "daily has invalid vol rows"),
    ]
    if "invalid_amount" in rules:
        texts.append(message("invalid_amount", "daily has invalid amount rows"))
    # a bad date ends the check, so it is the only message then
    undated = F.array(message("invalid_trade_date", "daily has invalid trade_date rows"))
    messages = F.when(F.col("invalid_trade_date") > 0, undated).otherwise(F.array_compact(F.array(*texts)))
    return report.withColumn("messages", messages).withColumn("ok", F.size("messages") == 0)


def keep_sound_symbols(bars: DataFrame) -> DataFrame:
    """Drop every bar of a symbol with a faulty bar, in the shuffle the features use anyway.

    For normalised bars, whose dates are valid, unique and unordered.
    """
    rules = {name: holds(rule) for name, rule in _bar_rules(bars.columns).items()}
    on_amount = rules.pop("invalid_amount", F.lit(False))
    marked = bars.withColumn("_faults", F.sum(reduce(or_, rules.values()).cast("int")).over(whole_symbol()))
    if "amount" in bars.columns:
        # as in `bar_quality`, a symbol without any amount lacks the optional column
        given = F.count("amount").over(whole_symbol()) > 0
        marked = marked.withColumn(
            "_faults", F.col("_faults") + F.when(given, F.sum(on_amount.cast("int")).over(whole_symbol())).otherwise(0)
        )
    return marked.where("_faults = 0").drop("_faults")


def _label_number(labels: DataFrame) -> Column:
    """The label as a number where its column is numeric; text never equals 0 or 1."""
    if dict(labels.dtypes)["label"] in ("string", "boolean"):
        return F.lit(None).cast("double")
    return to_number("label")


def _given_label(labels: DataFrame) -> Column:
    """The label as it was given: a reader keeps the text beside the number."""
    return F.col("label_text") if "label_text" in labels.columns else F.col("label")


def _is_allowed(labels: DataFrame, allowed: tuple[int, ...]) -> Column:
    return holds(_label_number(labels).isin(*[float(a) for a in allowed]))


def _is_bad_value(labels: DataFrame, allowed: tuple[int, ...]) -> Column:
    return ~_is_allowed(labels, allowed) & _given_label(labels).isNotNull()


def _counts_and_copies(rows: DataFrame, counts: dict[str, Column], copies: dict[str, list[str]]) -> DataFrame:
    """One row: how many rows there are (`rows`), how often each of `counts` holds, and for each of `copies`
    the rows beyond the first of its key, where NULL is a key too.

    What is counted is written first, so that the step that makes the rows holds no keys, and then dealt in even
    parts of `KEYED_ROWS`, so that the keys of a task, and not those of its share of the input, are in memory.
    """
    names = sorted({c for key in copies.values() for c in key})
    stored = materialize(
        rows.select(*names, *[holds(c).cast("bigint").alias(f"_is_{name}") for name, c in counts.items()]), "keyed-rows"
    )

    def keyed(place: int, key: list[str]) -> Column:
        part = [F.col(c) if c in key else F.lit(None).cast(stored.schema[c].dataType) for c in names]
        # a row is counted with its first key only
        held = [F.col(f"_is_{name}") if place == 0 else F.lit(0).cast("bigint") for name in counts]
        named = [c.alias(n) for c, n in zip([*part, *held], stored.columns)]
        return F.struct(F.lit(place).alias("_key"), *named)

    entries = F.inline(F.array(*[keyed(k, key) for k, key in enumerate(copies.values())]))
    parts = -(-stored.count() // KEYED_ROWS) or 1
    groups = stored.repartition(parts).select(entries).groupBy("_key", *names).agg(
        F.count("*").alias("_n"), *[F.sum(f"_is_{name}").alias(f"_is_{name}") for name in counts]
    )

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias(name)

    return groups.agg(
        total(F.when(F.col("_key") == 0, F.col("_n")), "rows"),
        *[total(F.col(f"_is_{name}"), name) for name in counts],
        *[total(F.when(F.col("_key") == k, F.col("_n") - 1), name) for k, name in enumerate(copies)],
    )


def validate_labels(
    labels: DataFrame, require_sample_id: bool = True, allowed: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """One row: counts of each label fault, and `ok`. See `invalid_label_values` for the values.

    With `require_sample_id` it writes an intermediate table.
    """
    required = [SAMPLE, *REQUIRED_LABEL_COLUMNS] if require_sample_id else REQUIRED_LABEL_COLUMNS
    require_columns(labels, required, "labels")
    dated = labels.withColumn(ASOF, to_date(ASOF, labels.schema[ASOF].dataType))
    counts = {
        "invalid_asof_date": F.col(ASOF).isNull(),
        "null_label": _given_label(labels).isNull(),
        "invalid_label": _is_bad_value(labels, allowed),
    }
    if require_sample_id:
        out = _counts_and_copies(dated, counts, {"duplicate_sample_id": [SAMPLE]}).withColumnRenamed("rows", "num_labels")
    else:
        out = dated.agg(
            F.count("*").alias("num_labels"),
            *[count_if(rule).alias(name) for name, rule in counts.items()],
            F.lit(0).cast("bigint").alias("duplicate_sample_id"),
        )
    faults = ["invalid_asof_date", "duplicate_sample_id", "null_label", "invalid_label"]
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.col(c) == 0 for c in faults]))


def invalid_label_values(labels: DataFrame, allowed: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The distinct label values that are not allowed, with their number of rows, in order."""
    bad = labels.where(_is_bad_value(labels, allowed))
    return bad.groupBy(_given_label(labels).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def validate_bar_schema(bars: DataFrame) -> DataFrame:
    """One row: rows without a valid date, after the required columns are known to exist."""
    require_columns(bars, REQUIRED_BAR_COLUMNS, "bars")
    dated = to_date(DATE, bars.schema[DATE].dataType)
    return bars.agg(F.count("*").alias("n_bars"), count_if(dated.isNull()).alias("invalid_trade_date"))


def label_coverage(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Per distinct (symbol, as-of date): first and last bar date and bars up to the date.

    Bars before the date are counted along one timeline of bar dates and label dates, which
    is linear in both; each has at most one row per symbol and day.
    """
    keys = labels.select(SYMBOL, ASOF).where(F.col(ASOF).isNotNull()).distinct()
    known = bars.select(SYMBOL, F.col(DATE).alias("_at"), F.lit(0).alias("_is_label"))
    asked = keys.select(SYMBOL, F.col(ASOF).alias("_at"), F.lit(1).alias("_is_label"))
    timeline = known.repartition(SYMBOL).unionByName(asked.repartition(SYMBOL))
    line = Window.partitionBy(SYMBOL).orderBy("_at", "_is_label")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bar_date = F.when(F.col("_is_label") == 0, F.col("_at"))
    return (
        timeline.withColumns(
            {
                "history_len": F.sum(1 - F.col("_is_label")).over(upto),
                "first_trade": F.min(bar_date).over(whole),
                "last_trade": F.max(bar_date).over(whole),
            }
        )
        .where("_is_label = 1")
        .select(SYMBOL, F.col("_at").alias(ASOF), "history_len", "first_trade", "last_trade")
    )


def label_alignment(labels: DataFrame, bars: DataFrame, min_history: int) -> DataFrame:
    """Each dated label with the first issue that applies, NULL where there is none.

    A label without a symbol has no bars, which is its issue.
    """
    found = labels.where(F.col(ASOF).isNotNull()).join(label_coverage(labels, bars), [SYMBOL, ASOF], "left")
    issue = (
        F.when(F.col("first_trade").isNull(), "missing_daily_file")
        .when((F.col(ASOF) < F.col("first_trade")) | (F.col(ASOF) > F.col("last_trade")), "asof_not_covered")
        .when(F.col("history_len") < min_history, "insufficient_history")
    )
    return found.withColumns({"issue": issue, "history_len": F.coalesce("history_len", F.lit(0).cast("bigint"))})


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """One row: labels, count per issue, and `ok`."""
    names = ["missing_daily_file", "asof_not_covered", "insufficient_history"]
    out = aligned.agg(
        F.count("*").alias("num_labels"), *[count_if(F.col("issue") == n).alias(n) for n in names]
    )
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.col(n) == 0 for n in names]))


def label_contract(labels: DataFrame) -> DataFrame:
    """One row of label statistics: NULLs, bad values, copies and ids that do not fit. Writes an intermediate table."""
    counts = {
        "num_null_ts_code": F.col(SYMBOL).isNull(),
        "num_null_asof_date": F.col(ASOF).isNull(),
        "num_null_label": _given_label(labels).isNull(),
        "num_invalid_label": _is_bad_value(labels, (0, 1)),
        "num_inconsistent_sample_id": _misnamed(),
    }
    copies = {"duplicate_sample_id_count": [SAMPLE], "duplicate_ts_code_asof_date_count": [SYMBOL, ASOF]}
    return _counts_and_copies(fill_contract_id(labels), counts, copies).withColumnRenamed("rows", "num_rows")


def fill_contract_id(labels: DataFrame) -> DataFrame:
    dated = labels.withColumn(ASOF, to_date(ASOF, labels.schema[ASOF].dataType))
    return dated if SAMPLE in dated.columns else dated.withColumn(SAMPLE, sample_id_or_flag())


def _misnamed() -> Column:
    return holds(F.col(SAMPLE).cast("string") != sample_id())


def inconsistent_sample_ids(labels: DataFrame, n: int = 10) -> DataFrame:
    return (
        fill_contract_id(labels)
        .where(_misnamed())
        .select(SAMPLE, sample_id().alias("expected_sample_id"))
        .orderBy(SAMPLE, "expected_sample_id")
        .limit(n)
    )


def label_distribution(labels: DataFrame, column: str = "label") -> DataFrame:
    return labels.groupBy(column).agg(F.count("*").alias("n"))


# What each label statistic means for the verdict.
LABEL_FINDINGS = {
    "num_null_ts_code": ("error", "labels contain null ts_code"),
    "num_null_asof_date": ("error", "labels contain invalid or null asof_date"),
    "num_null_label": ("error", "labels contain null label"),
    "num_invalid_label": ("error", "labels contain invalid label values (must be 0/1)"),
    "duplicate_sample_id_count": ("warning", "labels contain duplicate sample_id"),
    "duplicate_ts_code_asof_date_count": ("warning", "labels contain duplicate (ts_code, asof_date)"),
    "num_inconsistent_sample_id": (
        "error",
        "labels contain inconsistent sample_id (must equal {ts_code}_{asof_date})",
    ),
}
ALIGNMENT_FINDINGS = {
    "num_missing_daily_files": ("error", "some label samples do not have corresponding daily parquet files"),
    "num_asof_before_first_trade": ("warning", "some asof_date are earlier than first available trade_date"),
    "num_history_too_short": ("warning", "some samples do not meet min_history requirement"),
}


def bar_contract(bars: DataFrame) -> DataFrame:
    """Per symbol: bad dates, copies of a date, non-positive prices, negative volumes."""
    dated = bars.withColumn(DATE, to_date(DATE, bars.schema[DATE].dataType))
    return dated.groupBy(SYMBOL).agg(
        F.count("*").alias("num_rows"),
        count_if(F.col(DATE).isNull()).alias("num_invalid_trade_date"),
        (F.count(DATE) - F.countDistinct(DATE)).alias("duplicate_trade_date_count"),
        *[count_if(to_number(c) <= 0).alias(f"num_nonpositive_{c}") for c in PRICES if c in bars.columns],
        *[count_if(to_number("vol") < 0).alias("num_negative_vol") for c in ["vol"] if c in bars.columns],
    )


def contract_alignment(labels: DataFrame, bars: DataFrame, min_history: int) -> DataFrame:
    """One row of the lenient alignment: a date after the last bar is accepted here."""
    dated = fill_contract_id(labels)
    usable = dated.where(F.col(SYMBOL).isNotNull() & F.col(ASOF).isNotNull())
    found = usable.join(label_coverage(usable, bars), [SYMBOL, ASOF])
    missing = F.col("first_trade").isNull()
    early = holds(F.col(ASOF) < F.col("first_trade"))
    return found.agg(
        F.count("*").alias("num_label_rows"),
        count_if(missing).alias("num_missing_daily_files"),
        count_if(early).alias("num_asof_before_first_trade"),
        count_if(~missing & ~early & (F.col("history_len") < min_history)).alias("num_history_too_short"),
    )


def universe_summary(bars: DataFrame, n: int = 10) -> DataFrame:
    """The number of symbols and the first names."""
    symbols = bars.select(SYMBOL).distinct()
    first = (
        symbols.orderBy(SYMBOL)
        .limit(n)
        .agg(F.concat_ws(",", F.array_sort(F.collect_list(SYMBOL))).alias("first_symbols"))
    )
    return merge_rows(symbols.agg(F.count("*").alias("num_symbols")), first)


def _findings(row: DataFrame, scope: str, meaning: dict[str, tuple[str, str]]) -> DataFrame:
    issues = F.array(
        *[
            F.struct(
                F.lit(scope).alias("scope"),
                F.lit(severity).alias("severity"),
                F.lit(rule).alias("rule"),
                F.lit(text).alias("message"),
                F.col(rule).cast("bigint").alias("n"),
            )
            for rule, (severity, text) in meaning.items()
        ]
    )
    return row.select(F.inline(issues)).where("n > 0")


def contract_findings(labels: DataFrame, bars: DataFrame, min_history: int) -> DataFrame:
    """All contract issues as rows of (scope, severity, rule, message, n)."""
    return _findings(label_contract(labels), "labels", LABEL_FINDINGS).unionByName(
        _findings(contract_alignment(labels, bars, min_history), "alignment", ALIGNMENT_FINDINGS)
    )


def contract_verdict(findings: DataFrame) -> DataFrame:
    """`ok` is the absence of errors; warnings do not count."""
    return findings.agg(
        count_if(F.col("severity") == "error").alias("num_errors"),
        count_if(F.col("severity") == "warning").alias("num_warnings"),
    ).withColumn("ok", F.col("num_errors") == 0)


def raise_unless_ok(report: DataFrame, what: str) -> None:
    """The acting end of a check: reads the one report row and stops the job if it fails."""
    row = report.first()
    if not row["ok"]:
        shown = ", ".join(f"{k}={v}" for k, v in row.asDict().items() if k != "ok")
        raise ValueError(f"{what} failed: {shown}")
