"""Window features, as-of joins and sequences against plain per-window computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.catalog.inputs import labelled_windows
from barloom.catalog.shape import quick_round
from barloom.functions.rolling import Rolling
from barloom.operators import sequence
from barloom.operators.asof import asof_join
from barloom.operators.features import build_features, history_gate, latest_features
from barloom.operators.indicators import basic_indicators
from barloom.operators.sequence import window_sequences
from barloom.schema import FEATURES


def random_bars(symbols=3, days=150, gaps=0.0, seed=7, run_of_gaps=0):
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(symbols):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        frame = pd.DataFrame(
            {
                "ts_code": f"S{s}",
                "trade_date": pd.date_range("2024-01-01", periods=days, freq="D").date,
                "open": close * 0.99,
                "high": close * (1 + rng.random(days) * 0.03),
                "low": close * (1 - rng.random(days) * 0.03),
                "close": close,
                "vol": rng.integers(1, 1000, days).astype(float),
            }
        )
        if gaps:
            for c in ("high", "low", "close", "vol"):
                frame.loc[rng.random(days) < gaps, c] = np.nan
        if run_of_gaps:
            start = 20 + 11 * s
            frame.loc[start : start + run_of_gaps, "close"] = np.nan
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame):
    df = spark.createDataFrame(frame)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def div(a, b):
    return np.nan if b is None or np.isnan(b) or abs(b) <= 1e-12 else a / b


def window_reference(w):
    """The features of one window, computed on that window alone."""
    n, h, lo, c, v = len(w), w.high.reset_index(drop=True), w.low, w.close.reset_index(drop=True), w.vol.reset_index(drop=True)
    out = {}
    out["base_range_pct"] = np.nan if np.isnan(lo.min()) else div(h.max(), lo.min()) - 1
    out["base_vol_cv"] = div(v.std(ddof=0), v.mean())
    older = v.iloc[max(0, n - 80) : n - 20] if n > 20 else v.iloc[:0]
    out["vol_shrink_ratio"] = div(v.iloc[-20:].mean(), older.mean())
    for k in (5, 10):
        out[f"recent_return_{k}"] = div(c.iloc[-1], c.iloc[-1 - k]) - 1 if n > k else np.nan
    for k in (20, 60):
        top = h.iloc[-1 - k : -1].max() if n > k else h.max()
        out[f"breakout_distance_{k}"] = div(c.iloc[-1], top) - 1
    past = v.iloc[-21:-1]
    out["volume_spike_ratio"] = div(v.iloc[-1], past.mean())
    for k in (10, 20):
        means = [c.iloc[i - k + 1 : i + 1].mean() if c.iloc[i - k + 1 : i + 1].notna().all() else np.nan for i in range(k - 1, n)]
        pairs = [(c.iloc[i + k - 1], m) for i, m in enumerate(means) if not np.isnan(m)]
        out[f"above_ma{k}_ratio"] = np.mean([a > m for a, m in pairs]) if pairs else np.nan
    filled = c.ffill()
    out["volatility_20"] = (filled / filled.shift(1) - 1).iloc[-20:].std(ddof=0)
    return out


def check(spark, frame, size, complete):
    got = history_gate(build_features(to_spark(spark, frame), size, complete), size, 1).toPandas()
    got = got.set_index(["ts_code", "trade_date"]).sort_index()
    expected = {}
    for symbol, bars in frame.groupby("ts_code"):
        bars = bars.reset_index(drop=True)
        for end in range(size - 1, len(bars)):
            w = bars.iloc[end - size + 1 : end + 1]
            expected[(symbol, w.trade_date.iloc[-1])] = window_reference(w)
    assert len(got) == len(expected)
    table = pd.DataFrame(expected).T.sort_index()[FEATURES].astype(float)
    np.testing.assert_allclose(got[FEATURES].astype(float).to_numpy(), table.to_numpy(), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [1, 5, 11, 20, 45, 61, 80, 120])
def test_features_with_gaps(spark, size):
    check(spark, random_bars(gaps=0.03), size, complete=False)


@pytest.mark.parametrize("size", [6, 21, 60, 79])
def test_features_without_gaps(spark, size):
    check(spark, random_bars(days=130), size, complete=True)


@pytest.mark.parametrize("size", [15, 30, 120])
def test_features_after_long_runs_of_missing_closes(spark, size):
    check(spark, random_bars(days=160, run_of_gaps=max(12, size)), size, complete=False)


def test_latest_features_equal_the_window_features(spark):
    bars = to_spark(spark, random_bars(days=170, gaps=0.02))
    latest = latest_features(bars, 120, 160).orderBy("ts_code").toPandas()
    every = build_features(bars, 120).where("rn = 170").orderBy("ts_code").toPandas()
    assert len(latest) == 3 and list(latest.history_len) == [170] * 3
    np.testing.assert_allclose(
        latest[FEATURES].astype(float).to_numpy(), every[FEATURES].astype(float).to_numpy(), rtol=1e-9
    )
    assert latest_features(bars, 120, 171).count() == 0


def test_clean_window_has_every_feature(spark):
    row = latest_features(to_spark(spark, random_bars(1, 120)), 120, 1).first()
    assert all(row[f] is not None and np.isfinite(row[f]) for f in FEATURES)


def test_volume_alias_and_missing_columns(spark):
    bars = to_spark(spark, random_bars(1, 30)).withColumnRenamed("vol", "Volume")
    assert build_features(bars, 10).where("rn >= 10").count() == 21
    with pytest.raises(KeyError):
        build_features(bars.drop("Volume"), 10)


def test_gate_parameters(spark):
    bars = to_spark(spark, random_bars(1, 40))
    features = build_features(bars, 20)
    assert history_gate(features, 20, 35).count() == 6
    assert history_gate(features, 60, 1).count() == 0
    with pytest.raises(ValueError):
        history_gate(features, 0, 1)


def test_padded_return(spark):
    frame = pd.DataFrame({"ts_code": "A", "trade_date": pd.date_range("2024-01-01", periods=3).date, "close": [1.0, np.nan, 3.0]})
    got = basic_indicators(to_spark(spark, frame)).orderBy("trade_date").collect()
    assert [r.ret_1d for r in got] == [None, 0.0, 2.0]
    assert [r.ma_5 for r in got] == [1.0, 1.0, 2.0]


@pytest.mark.parametrize("rows,skip", [(7, 0), (20, 1), (47, 0), (60, 20), (100, 1), (120, 0)])
def test_tiles_equal_plain_frames(spark, rows, skip):
    from pyspark.sql import Window

    bars = to_spark(spark, random_bars(2, 160, gaps=0.1))
    roll = Rolling()
    columns = {
        "hi": roll.highest("high", rows, skip),
        "lo": roll.lowest("low", rows, skip),
        "mean": roll.mean("vol", rows, skip),
        "n": roll.count("vol", rows, skip),
        "sd": roll.std("vol", rows, skip),
        "sds": roll.std("vol", rows, skip, sample=True),
    }
    frame = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(1 - rows - skip, -skip)
    plain = {
        "hi": F.max("high"), "lo": F.min("low"), "mean": F.avg("vol"), "n": F.count("vol"),
        "sd": F.stddev_pop("vol"), "sds": F.stddev_samp("vol"),
    }
    keys = ["ts_code", "trade_date"]
    got = roll.attach(bars).withColumns(columns).select(*keys, *columns).orderBy(*keys).toPandas()
    want = bars.select(*keys, *[a.over(frame).alias(c) for c, a in plain.items()]).orderBy(*keys).toPandas()
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-10, err_msg=c)


def test_features_use_one_exchange_and_one_sort(spark):
    bars = to_spark(spark, random_bars(2, 30))
    plan = build_features(bars, 120)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_asof_join_never_looks_ahead(spark):
    rng = np.random.default_rng(3)
    frame = random_bars(4, 60).sample(frac=0.5, random_state=1)
    labels = pd.DataFrame(
        {
            "sample_id": [f"L{i}" for i in range(200)],
            "ts_code": [f"S{i}" for i in rng.integers(0, 5, 200)],  # S4 has no bars
            "asof_date": [pd.Timestamp("2023-12-25") + pd.Timedelta(days=int(d)) for d in rng.integers(0, 80, 200)],
        }
    )
    labels["asof_date"] = labels.asof_date.dt.date
    # a third of the labels are copies of one (symbol, date)
    labels.loc[:70, ["ts_code", "asof_date"]] = ["S1", pd.Timestamp("2024-02-10").date()]
    got = asof_join(spark.createDataFrame(labels), to_spark(spark, frame).select("ts_code", "trade_date", "close"))
    got = {r.sample_id: r.trade_date for r in got.collect()}
    assert len(got) == 200
    for row in labels.itertuples():
        seen = frame[(frame.ts_code == row.ts_code) & (frame.trade_date <= row.asof_date)].trade_date
        assert got[row.sample_id] == (seen.max() if len(seen) else None)


def test_sequences_fill_inside_the_window_only(spark):
    frame = random_bars(2, 75, gaps=0.3)
    frame.loc[:19, "close"] = np.nan
    samples = spark.createDataFrame(
        [(f"{s}_{rn}", s, rn) for s in ("S0", "S1") for rn in (10, 17, 20, 31, 75)] + [("S0_31", "S0", 31)],
        "sample_id string, ts_code string, rn int",
    )
    columns = ["close", "vol", "absent"]
    got = {r.sample_id: np.array(r.x_sequence) for r in window_sequences(samples, to_spark(spark, frame), 10, columns).collect()}
    assert len(got) == 10
    for key, matrix in got.items():
        symbol, rn = key.split("_")
        w = frame[frame.ts_code == symbol].iloc[int(rn) - 10 : int(rn)][["close", "vol"]]
        want = w.ffill().bfill().fillna(0.0).to_numpy(dtype=np.float32)
        np.testing.assert_array_equal(matrix.astype(np.float32), want)
    with pytest.raises(ValueError):
        window_sequences(samples, to_spark(spark, frame), 10, ["absent"])


def test_labelled_windows_of_sql_text_are_not_exchanged_for_the_timeline(spark, tmp_path):
    rows = [(k, 1, k % 2, 0.01 * (k % 9), 0.02, 3.0, 50.0 + k, str(pd.Timestamp("2024-01-01") + pd.Timedelta(days=k // 2))) for k in range(300)]
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_discount double, l_tax double, l_quantity double, l_extendedprice double, l_shipdate string"
    spark.createDataFrame(rows, names).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = labelled_windows(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 1 and "Exchange" not in plan.split("Union")[0].rsplit("Window [", 1)[1]
    assert {(r["ts_code"], r["rn"]) for r in found.collect()} == {(f"S00000{s}", n) for s in range(2) for n in range(120, 146)}


def test_sequences_without_gaps_are_cut_and_not_filled(spark, monkeypatch):
    monkeypatch.setattr(sequence, "_filled", lambda values: F.transform(values, lambda v: F.raise_error(F.lit("filled")).cast("float")))
    frame = random_bars(2, 45)
    samples = spark.createDataFrame([(f"{s}_{rn}", s, rn) for s in ("S0", "S1") for rn in (9, 10, 11, 20, 37, 45, 46)], "sample_id string, ts_code string, rn int")
    got = {r.sample_id: np.array(r.x_sequence) for r in window_sequences(samples, to_spark(spark, frame), 10, ["close", "vol"]).collect()}
    assert set(got) == {f"{s}_{rn}" for s in ("S0", "S1") for rn in (10, 11, 20, 37, 45)}
    for key, matrix in got.items():
        symbol, rn = key.split("_")
        want = frame[frame.ts_code == symbol].iloc[int(rn) - 10 : int(rn)][["close", "vol"]].to_numpy(dtype=np.float32)
        np.testing.assert_array_equal(matrix.astype(np.float32), want)


def test_quick_rounding_equals_rounding(spark):
    values = [k / 2000 for k in range(-3001, 3001)] + [0.0, -0.0, -0.0002, 1e300, 999999.9995, 123456.4565, float("inf"), float("-inf"), float("nan"), None]
    frame = spark.createDataFrame([(v,) for v in values], "x double").unionByName(spark.range(20000).select(((F.rand(5) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 12)).alias("x")))
    for digits in (3, 6):
        unlike = F.round("x", digits).cast("string") != quick_round(F.col("x"), digits).cast("string")
        assert frame.where(unlike | (F.col("x").isNull() != quick_round(F.col("x"), digits).isNull())).count() == 0
