"""The eleven features of a fixed-length window, for every bar or for the latest bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import pick_column, safe_div
from barloom.functions.frames import by_date, last_rows, newest_rows, up_to_now
from barloom.functions.rolling import Rolling
from barloom.schema import DATE, FEATURES, SYMBOL


def _none() -> Column:
    return F.lit(None).cast("double")


def _window_input(bars: DataFrame, keep: list[str]) -> DataFrame:
    vol = pick_column(bars, ["vol", "volume"])
    prices = {c: pick_column(bars, [c]) for c in ("high", "low", "close")}
    kept = [c for c in keep if c not in (SYMBOL, DATE, "vol", *prices)]
    return bars.select(
        SYMBOL, DATE, *kept, *[F.col(s).alias(c) for c, s in prices.items()], F.col(vol).alias("vol")
    )


def _minus_one(ratio: Column) -> Column:
    return ratio - 1.0


def build_features(
    bars: DataFrame, window_size: int = 120, closes_complete: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Features of the window that ends at each bar, with its row number `rn` and first date.

    The values are those of a window of exactly `window_size` rows: use rows with
    `rn >= window_size`, or the `history_gate`. With `closes_complete` no close may be NULL
    (bars that passed the quality rules), which makes the volatility cheaper.
    """
    size = window_size
    if size <= 0:
        raise ValueError("window_size must be positive")
    keep = keep or []
    roll = Rolling()

    features: dict[str, Column] = {}
    low, high = roll.lowest("low", size), roll.highest("high", size)
    features["base_range_pct"] = F.when(low > 1e-12, _minus_one(safe_div(high, low)))
    features["base_vol_cv"] = safe_div(roll.std("vol", size), roll.mean("vol", size))
    older = min(60, size - 20)
    features["vol_shrink_ratio"] = (
        safe_div(roll.mean("vol", min(20, size)), roll.mean("vol", older, 20)) if older > 0 else _none()
    )
    for n in (5, 10):
        features[f"recent_return_{n}"] = (
            _minus_one(safe_div(F.col("close"), roll.back("close", n))) if size > n else _none()
        )
    for n in (20, 60):
        top = roll.highest("high", n, 1) if size > n else roll.highest("high", size)
        features[f"breakout_distance_{n}"] = _minus_one(safe_div(F.col("close"), top))
    past = min(20, size - 1)
    features["volume_spike_ratio"] = (
        safe_div(F.col("vol"), roll.mean("vol", past, 1)) if past > 0 else _none()
    )
    shares = Rolling()
    for n in (10, 20):
        above = f"_above{n}"
        defined = shares.count(above, size - n + 1) if size >= n else None
        features[f"above_ma{n}_ratio"] = (
            F.when(defined > 0, shares.hits(above, size - n + 1) / defined) if size >= n else _none()
        )
    recent = min(20, size - 1)
    if recent < 1:
        features["volatility_20"] = _none()
    elif closes_complete:
        features["volatility_20"] = roll.std("_ret", recent)
    else:
        features["volatility_20"] = _std_of_array(F.col("_recent_ret"))

    base = _window_input(bars, keep).withColumns(
        {
            "_padded": F.last("close", ignorenulls=True).over(up_to_now()),
            "rn": F.row_number().over(by_date()),
            "window_start": F.lag(DATE, size - 1).over(by_date()),
        }
    )
    base = base.withColumn("_ret", F.try_divide(F.col("_padded"), F.lag("_padded").over(by_date())) - 1.0)
    if not closes_complete and recent >= 1:
        base = _with_recent_returns(base, size, recent)
    averages = {
        f"_above{n}": F.when(roll.full_mean("close", n).isNotNull(), (F.col("close") > roll.full_mean("close", n)).cast("int"))
        for n in (10, 20)
    }
    flagged = roll.attach(base).withColumns(averages)
    return (
        shares.attach(flagged)
        .withColumns(features)
        .select(SYMBOL, DATE, *keep, "rn", "window_start", *FEATURES)
    )


def _with_recent_returns(base: DataFrame, size: int, recent: int) -> DataFrame:
    """Collect the last returns that lie wholly inside the window.

    Where the window starts with missing closes, a padded return would look at a close
    before the window; it is recognised by the row number of the close it starts from.
    """
    seen = F.last(F.when(F.col("close").isNotNull(), F.col("rn")), ignorenulls=True).over(up_to_now())
    frame = last_rows(recent)
    pairs = F.collect_list(F.struct(F.col("_ret").alias("r"), F.col("_from").alias("at"))).over(frame)
    return (
        base.withColumn("_seen", seen)
        .withColumn("_from", F.lag("_seen").over(by_date()))
        .withColumn("_pairs", pairs)
        .withColumn(
            "_recent_ret",
            F.transform(
                F.filter("_pairs", lambda p: p["r"].isNotNull() & (p["at"] > F.col("rn") - size)),
                lambda p: p["r"],
            ),
        )
    )


def _std_of_array(values: Column) -> Column:
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n.cast("double"))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 0, F.sqrt(squares / n))


def history_gate(features: DataFrame, window_size: int, min_history: int) -> DataFrame:
    """Keep bars with enough bars up to and including them."""
    if window_size <= 0 or min_history <= 0:
        raise ValueError("window_size and min_history must be positive")
    return features.where(F.col("rn") >= max(window_size, min_history))


def latest_bars(bars: DataFrame) -> DataFrame:
    """The last available bar of each symbol, which need not be a common date."""
    values = [c for c in bars.columns if c != SYMBOL]
    return bars.groupBy(SYMBOL).agg(*[F.max_by(c, DATE).alias(c) for c in values])


def latest_features(bars: DataFrame, window_size: int = 120, min_history: int = 160) -> DataFrame:
    """Features of each symbol's last window.

    Only the last window of rows is kept before anything is computed, so the work per
    symbol does not grow with its history; the rest is one aggregate in the same shuffle.
    """
    size = window_size
    if size <= 0 or min_history <= 0:
        raise ValueError("window_size and min_history must be positive")
    window = newest_rows(_window_input(bars, []), size).where(F.col("_bars") >= max(size, min_history))
    moving = {}
    for n in (10, 20):
        frame = last_rows(n)
        moving[f"_ma{n}"] = F.when(F.count("close").over(frame) == n, F.avg("close").over(frame))
    window = window.withColumn("_padded", F.last("close", ignorenulls=True).over(up_to_now())).withColumns(
        {"_ret": F.try_divide(F.col("_padded"), F.lag("_padded").over(by_date())) - 1.0, **moving}
    )

    age = F.col("_age")

    def part(column: str, first: int, last: int) -> Column:
        return F.when(age.between(first, last), F.col(column))

    def at(column: str, back: int) -> Column:
        return F.max(F.when(age == back, F.col(column)))

    close, low = at("close", 0), F.min("low")
    values = {
        "base_range_pct": F.when(low > 1e-12, _minus_one(safe_div(F.max("high"), low))),
        "base_vol_cv": safe_div(F.stddev_pop("vol"), F.avg("vol")),
        "vol_shrink_ratio": safe_div(F.avg(part("vol", 0, 19)), F.avg(part("vol", 20, 79))),
        "volatility_20": F.stddev_pop(part("_ret", 0, 19)),
        "volume_spike_ratio": safe_div(at("vol", 0), F.avg(part("vol", 1, 20))),
    }
    for n in (5, 10):
        values[f"recent_return_{n}"] = _minus_one(safe_div(close, at("close", n)))
    for n in (20, 60):
        first, last = (1, n) if size > n else (0, size - 1)
        values[f"breakout_distance_{n}"] = _minus_one(safe_div(close, F.max(part("high", first, last))))
    for n in (10, 20):
        above = F.when(F.col(f"_ma{n}").isNotNull(), F.coalesce(F.col("close") > F.col(f"_ma{n}"), F.lit(False)).cast("int"))
        values[f"above_ma{n}_ratio"] = F.avg(above)
    return window.groupBy(SYMBOL).agg(
        F.max(DATE).alias("asof_date"),
        F.min(DATE).alias("window_start"),
        F.max("_bars").alias("history_len"),
        *[values[f].alias(f) for f in FEATURES],
    )
