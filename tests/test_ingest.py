"""Bars and labels from files, normalisation, units, duplicates."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.dataset import prepare_labels
from barloom.operators.normalize import BarUnits, CONTRACT_UNITS, duplicate_dates, normalize_bars
from barloom.operators.quality import bar_quality, invalid_label_values, validate_labels
from barloom.sources import readers, writers

DAY = datetime.date


def bars_of(spark, rows, columns):
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns))


def mixed_quotes(spark):
    """Two symbols whose days come in no order, with a column that is not of the contract."""
    rows = [
        ("WOL", "2023-11-08", 31.0, 33.5, 30.5, 32.25, 40, 12.5, -0.5, "x"),
        ("KED", "2023-11-06", 7.0, 7.5, 6.25, 6.5, 15, 0.75, 0.25, "y"),
        ("WOL", "2023-11-06", 30.0, 31.0, 29.0, 30.75, 25, 7.5, 1.5, "z"),
        ("WOL", "2023-11-07", 30.5, 30.75, 28.5, 29.0, 10, 3.0, 0.0, "x"),
    ]
    return spark.createDataFrame(rows, "ts_code string, trade_date string, open double, high double, low double, close double, vol long, amount double, pct_chg double, remark string")


def test_units_and_columns(spark):
    out = normalize_bars(mixed_quotes(spark))
    assert "remark" not in out.columns
    got = {(r.ts_code, r.trade_date): (r.vol, r.amount, r.close) for r in out.collect()}
    assert got == {
        ("KED", DAY(2023, 11, 6)): (1500.0, 750.0, 6.5),
        ("WOL", DAY(2023, 11, 6)): (2500.0, 7500.0, 30.75),
        ("WOL", DAY(2023, 11, 7)): (1000.0, 3000.0, 29.0),
        ("WOL", DAY(2023, 11, 8)): (4000.0, 12500.0, 32.25),
    }


@pytest.mark.parametrize(
    ("units", "vol", "amount"),
    [(BarUnits("shares", "yuan"), 15.0, 0.75), (BarUnits("lots", "yuan", 200.0), 3000.0, 0.75), (BarUnits("shares"), 15.0, 750.0)],
)
def test_each_unit_on_its_own(spark, units, vol, amount):
    row = normalize_bars(mixed_quotes(spark).where("ts_code = 'KED'"), units).first()
    assert (row.vol, row.amount) == (vol, amount)


def repeated_days(spark):
    """`PAN` has one day three times and another twice, `ROT` none; `_ord` is the order of the file."""
    days = [("PAN", 14, 3), ("PAN", 15, 1), ("PAN", 14, 0), ("ROT", 14, 5), ("PAN", 16, 4), ("PAN", 14, 2), ("PAN", 16, 6)]
    rows = [(code, f"202405{d}", 50.0 + o, 60.0 + o, 40.0, 55.0, 10, o) for code, d, o in days]
    return spark.createDataFrame(rows, "ts_code string, trade_date string, open double, high double, low double, close double, vol int, _ord long")


def test_duplicate_policies(spark):
    bars = repeated_days(spark)

    def opens(policy):
        return sorted((r.ts_code, r.trade_date.day, r.open) for r in normalize_bars(bars, duplicate_policy=policy).collect())

    assert opens("raise") == [("ROT", 14, 55.0)]
    assert opens("first") == [("PAN", 14, 50.0), ("PAN", 15, 51.0), ("PAN", 16, 54.0), ("ROT", 14, 55.0)]
    assert opens("last") == [("PAN", 14, 53.0), ("PAN", 15, 51.0), ("PAN", 16, 56.0), ("ROT", 14, 55.0)]
    listed = duplicate_dates(normalize_input(bars)).collect()
    assert [(r.ts_code, r.n_duplicate_dates, r.preview) for r in listed] == [("PAN", 2, "2024-05-14, 2024-05-16")]
    with pytest.raises(ValueError):
        normalize_bars(bars, duplicate_policy="other")


def test_a_picked_bar_is_one_row(spark):
    """With equal file order the values of a bar still come from one row."""
    rows = [("TIE", "20240514", float(v), v + 1.0, v - 1.0, v + 0.5, v, 0) for v in (20, 30, 40)]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date string, open double, high double, low double, close double, vol int, _ord long")
    for policy in ("first", "last"):
        row = normalize_bars(bars, BarUnits("shares", "yuan"), policy).first()
        assert (row.high, row.low, row.close, row.vol) == (row.open + 1, row.open - 1, row.open + 0.5, row.open)


def normalize_input(bars):
    return bars.withColumn("trade_date", F.to_date("trade_date", "yyyyMMdd"))


def test_bad_values_become_null_and_bad_dates_go(spark):
    frame = pd.DataFrame(
        {
            "ts_code": ["A"] * 4,
            "trade_date": ["2025-01-01", "20250102", "soon", None],
            "open": ["1.5", "x", "1", "1"],
            "close": [1.0, float("nan"), 1.0, 1.0],
        }
    )
    out = normalize_bars(spark.createDataFrame(frame), CONTRACT_UNITS).orderBy("trade_date").collect()
    assert [r.trade_date for r in out] == [DAY(2025, 1, 1), DAY(2025, 1, 2)]
    assert [r.open for r in out] == [1.5, None]
    assert [r.close for r in out] == [1.0, None]


def test_missing_date_column(spark):
    with pytest.raises(KeyError):
        normalize_bars(spark.createDataFrame([("A", 1.0)], "ts_code string, close double"))


def symbol_file(n=3, **more):
    base = pd.DataFrame(
        {
            "trade_date": pd.date_range("2025-01-01", periods=n, freq="D"),
            "open": 1.0,
            "high": 2.0,
            "low": 0.5,
            "close": 1.5,
            "vol": np.arange(1.0, n + 1),
        }
    )
    return base.assign(**more)


def test_read_one_file_per_symbol(spark, tmp_path):
    symbol_file().to_parquet(tmp_path / "000001.SZ.parquet", index=False)  # nanosecond timestamps
    symbol_file(2, turnover_rate=4.0).to_parquet(tmp_path / "000002.SZ.parquet", index=False)
    bars = readers.read_bars(spark, str(tmp_path))
    found = normalize_bars(bars).orderBy("ts_code", "trade_date").collect()
    assert [(r.ts_code, str(r.trade_date), r.vol) for r in found] == [
        ("000001.SZ", "2025-01-01", 100.0),
        ("000001.SZ", "2025-01-02", 200.0),
        ("000001.SZ", "2025-01-03", 300.0),
        ("000002.SZ", "2025-01-01", 100.0),
        ("000002.SZ", "2025-01-02", 200.0),
    ]
    rates = {r.ts_code: r.rate for r in bars.groupBy("ts_code").agg(F.max("turnover_rate").alias("rate")).collect()}
    assert rates == {"000001.SZ": None, "000002.SZ": 4.0}


def test_read_groups_of_unlike_types(spark, tmp_path):
    for folder, dates in {"text": ["20250103", "20250104"], "number": [20250105, 20250106]}.items():
        (tmp_path / folder).mkdir()
        symbol_file(2).assign(trade_date=dates).to_parquet(tmp_path / folder / f"{folder}.parquet", index=False)
    bars = readers.read_bars(spark, str(tmp_path / "text"), str(tmp_path / "number"))
    assert sorted(str(r.trade_date) for r in bars.collect()) == [f"2025-01-0{d}" for d in (3, 4, 5, 6)]


def test_read_a_folder_of_unlike_types(spark, tmp_path):
    """Text, eight-digit, date and nanosecond dates beside one another; columns that some files lack."""
    days = pd.date_range("2025-01-01", periods=3, freq="D")
    symbol_file().assign(trade_date=days.strftime("%Y%m%d")).to_parquet(tmp_path / "A.parquet", index=False)
    symbol_file().assign(trade_date=days.strftime("%Y%m%d").astype(int)).to_parquet(tmp_path / "B.parquet", index=False)
    symbol_file(amount=7).assign(trade_date=days.date, vol=["1", "2", "x"]).to_parquet(tmp_path / "C.parquet", index=False)
    symbol_file(turnover_rate=4.0).to_parquet(tmp_path / "D.parquet", index=False)
    symbol_file(ts_code="E").to_parquet(tmp_path / "other name.parquet", index=False)
    bars = readers.read_bars(spark, str(tmp_path))
    rows = {(r.ts_code, str(r.trade_date)): (r.vol, r.amount, r.turnover_rate, r._ord) for r in bars.collect()}
    for name, vols, amount, rate in (("A", (1, 2, 3), None, None), ("C", (1, 2, None), 7, None), ("D", (1, 2, 3), None, 4), ("E", (1, 2, 3), None, None)):
        for k, vol in enumerate(vols):
            assert rows[name, f"2025-01-0{k + 1}"] == (vol, amount, rate, k)
    assert len(rows) == 15 and {s for s, _ in rows} == set("ABCDE")
    assert len(readers._layouts(spark, [str(tmp_path)])) == 5


def test_files_of_one_layout_are_one_scan(spark, tmp_path):
    for k in range(4):
        symbol_file().to_parquet(tmp_path / f"S{k}.parquet", index=False)
    assert len(readers._layouts(spark, [str(tmp_path)])) == 1


@pytest.mark.parametrize(("policy", "closes"), [("first", [10.0, 11.0, 21.0]), ("last", [10.0, 20.0, 21.0])])
def test_duplicates_over_files_go_by_file_and_row(spark, tmp_path, policy, closes):
    """The row of a shared day lies deeper in the first file than in the second, and its other values are larger."""
    first = symbol_file(2, ts_code="A").assign(close=[10.0, 11.0], open=[9.0, 9.0])
    second = symbol_file(3, ts_code="A").iloc[1:].assign(close=[20.0, 21.0], open=[1.0, 1.0])
    first.to_parquet(tmp_path / "1.parquet", index=False)
    second.to_parquet(tmp_path / "2.parquet", index=False)
    bars = normalize_bars(readers.read_bars(spark, str(tmp_path)), duplicate_policy=policy)
    assert [r.close for r in bars.orderBy("trade_date").collect()] == closes


def test_order_is_that_of_each_file(spark, tmp_path):
    """The later file holds the earlier days, which is no descent; one inside a file is."""
    late = symbol_file(6, ts_code="A", amount=1.0)
    late.iloc[3:].to_parquet(tmp_path / "1.parquet", index=False)
    late.iloc[:3].to_parquet(tmp_path / "2.parquet", index=False)
    late.assign(ts_code="B").iloc[[0, 2, 1]].to_parquet(tmp_path / "3.parquet", index=False)
    found = {r.ts_code: (r.descents, r.ok) for r in bar_quality(readers.read_bars(spark, str(tmp_path))).collect()}
    assert found == {"A": (0, True), "B": (1, False)}


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_bars(spark, str(tmp_path / "none"))


def test_written_bars_are_the_same(spark, tmp_path):
    symbol_file().to_parquet(tmp_path / "A.parquet", index=False)
    bars = readers.read_bars(spark, str(tmp_path / "A.parquet"))
    writers.write_bars(bars, str(tmp_path / "compact"), 2)
    again = readers.read_bars(spark, str(tmp_path / "compact"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, bars.collect()), key=str)


def test_labels_from_csv(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("Ticker,asof_date,y\nA,2025-03-21,1\nA,20250322,0\nB,never,2\n")
    named = prepare_labels(readers.read_labels(spark, str(path)))
    rows = {r.sample_id: (r.label, r.label_source, r.confidence) for r in named.collect()}
    assert rows == {"A_2025-03-21": (1, "labels.csv", 1.0), "A_2025-03-22": (0, "labels.csv", 1.0)}


def test_label_text_is_told_from_a_missing_label(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("ts_code,asof_date,label\nA,2025-03-21,1\nA,2025-03-22,yes\nB,2025-03-23,\nB,2025-03-24,3\n")
    labels = readers.read_labels(spark, str(path))
    row = validate_labels(labels, require_sample_id=False).first()
    assert (row.num_labels, row.null_label, row.invalid_label, row.ok) == (4, 1, 2, False)
    assert [(r.value, r.n) for r in invalid_label_values(labels).collect()] == [("3", 1), ("yes", 1)]


def test_alias_columns_are_required(spark):
    with pytest.raises(KeyError):
        prepare_labels(spark.createDataFrame([("A", 1)], "ts_code string, label int"))


def test_dated_path():
    assert writers.dated_path("out/scan.csv", "2025-03-21") == "out/scan_2025-03-21.csv"
    assert writers.dated_path("out/scan", "2025-03-21") == "out/scan_2025-03-21"
    assert writers.dated_path("scan.csv", None) == "scan.csv"


def test_reports_are_strict_json(spark, tmp_path):
    frame = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.5)], "name string, value double")
    writers.write_report(frame, str(tmp_path / "report"))
    found = {r.name: r.value for r in readers.read_report(spark, str(tmp_path / "report")).collect()}
    assert found == {"a": None, "b": None, "c": 1.5}


def test_experiment_rows_append(spark, tmp_path):
    path = str(tmp_path / "log")
    for name in ("one", "two"):
        writers.append_experiment(spark.createDataFrame([(name, 0.5)], "exp_id string, f1 double"), path)
    rows = spark.read.parquet(path)
    assert len(rows.columns) == 22 and sorted(r.exp_id for r in rows.collect()) == ["one", "two"]


def test_future_returns_from_a_file(spark, tmp_path):
    file = tmp_path / "returns.csv"
    file.write_text("sample_id,asof_date,future_return\nA_1,20210104,0.25\nA_2,2021-01-05,\nA_3,never,inf?\n")
    found = {r.sample_id: (str(r.asof_date), r.future_return) for r in readers.read_future_returns(spark, str(file)).collect()}
    assert found == {"A_1": ("2021-01-04", 0.25), "A_2": ("2021-01-05", None), "A_3": ("None", None)}
    file.write_text("sample_id,return\nA_1,0.5\n")
    with pytest.raises(KeyError, match="future_return"):
        readers.read_future_returns(spark, str(file))


def test_dataset_rows_are_stored_before_the_exchange_by_split(spark, tmp_path, monkeypatch):
    from barloom.catalog import ingest
    from barloom.schema import FEATURES

    windows = spark.createDataFrame(
        [(f"K_{k}", "K", DAY(2024, 1, 1 + k), DAY(2023, 1, 1), DAY(2024, 1, 1 + k), k % 2, "hand", 1.0, "train" if k < 6 else "test", 120 + k) for k in range(9)],
        "sample_id string, ts_code string, asof_date date, window_start date, window_end date, label int, label_source string, confidence double, split string, rn int",
    ).withColumns({c: F.col("rn") / 7 for c in FEATURES} | {"skip_reason": F.lit(None).cast("string")})
    plans, write = [], writers.write_dataset

    def written(samples, path):
        plans.append(samples._jdf.queryExecution().executedPlan().toString())
        write(samples, path)

    monkeypatch.setattr(ingest, "labelled_windows", lambda spark, sf: windows.repartition(3, "ts_code"))
    monkeypatch.setattr(ingest.writers, "write_dataset", written)
    found = ingest.dataset_write_and_read(spark, str(tmp_path))
    assert "Exchange" not in plans[0]
    assert {(r["sample_id"], r["split"], r["label"]) for r in found.collect()} == {(f"K_{k}", "train" if k < 6 else "test", k % 2) for k in range(9)}
