"""Dataset build, training, scoring and scanning end to end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as m
from barloom.operators.dataset import align_features, build_dataset, build_samples, check_skip_limit, skip_report
from barloom.operators.metrics import roc_auc
from barloom.operators.normalize import CONTRACT_UNITS
from barloom.plans import jobs
from barloom.schema import FEATURES
from barloom.sources import readers
from test_windows import random_bars


def cycle_bars(days=260, step=0.0):
    """Prices that swing around 40 with a period of 13 days, volumes around 5,000 with one of 7."""
    t = np.arange(days)
    close = 40 + 3 * np.sin(2 * np.pi * t / 13) + step * t
    return pd.DataFrame(
        {
            "trade_date": pd.date_range("2021-05-03", periods=days, freq="D"),
            "open": close - 0.25,
            "high": close + 0.75,
            "low": close - 1.0,
            "close": close,
            "vol": 5000 + 900 * np.cos(2 * np.pi * t / 7),
            "amount": 200.0 + t,
        }
    )


def label_file(rows):
    return "ts_code,asof_date,label,label_source\n" + "".join(f"{c},{d},{y},hand\n" for c, d, y in rows)


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "bars").mkdir()
    cycle_bars().to_parquet(tmp_path / "bars" / "UPW.parquet", index=False)
    cycle_bars(step=0.02).drop(columns="amount").to_parquet(tmp_path / "bars" / "NOA.parquet", index=False)
    cycle_bars(days=100).to_parquet(tmp_path / "bars" / "NEW.parquet", index=False)
    (tmp_path / "labels.csv").write_text(
        label_file([("UPW", "2021-10-04", 0), ("NOA", "2021-11-15", 1), ("UPW", "2021-12-24", 1)])
    )
    return tmp_path


def build(spark, inputs, **options):
    return jobs.run_build(spark, str(inputs / "labels.csv"), str(inputs / "bars"), str(inputs / "out"), 90, 60, **options)


def test_build_from_files(spark, inputs):
    """One of the files lacks the optional amount, and its symbol is kept."""
    result = build(spark, inputs)
    assert (result["num_samples"], result["num_skipped"]) == (3, 0)
    rows = readers.read_dataset(spark, result["samples"]).orderBy("ts_code", "window_end").collect()
    assert [(r.ts_code, r.label, str(r.window_start), str(r.window_end)) for r in rows] == [
        ("NOA", 1, "2021-08-18", "2021-11-15"),
        ("UPW", 0, "2021-07-07", "2021-10-04"),
        ("UPW", 1, "2021-09-26", "2021-12-24"),
    ]
    assert all(np.isfinite(r[f]) for r in rows for f in FEATURES)
    # highest and lowest price of a swing, both inside any window of 90 days
    for r in rows[1:]:
        t = np.arange(13)
        swing = 40 + 3 * np.sin(2 * np.pi * t / 13)
        assert r.base_range_pct == pytest.approx((swing.max() + 0.75) / (swing.min() - 1.0) - 1)
    tensors = {r.sample_id: np.array(r.x_sequence) for r in spark.read.parquet(result["sequences"]).collect()}
    assert len(tensors) == 3 and {x.shape for x in tensors.values()} == {(90, 5)}


def test_build_runs_its_windows_once(spark, inputs, monkeypatch):
    """Report, samples and sequences read the stored rows: no plan but that of the stored table has the feature windows."""
    stored, read = [], []
    materialize, parts = jobs.materialize, jobs.dataset_parts
    monkeypatch.setattr(jobs, "materialize", lambda df, name: stored.append((name, plan_of(df))) or materialize(df, name))
    monkeypatch.setattr(jobs, "dataset_parts", lambda *args: read.append(parts(*args)) or read[0])
    build(spark, inputs)
    assert [name for name, plan in stored if "volatility_20" in plan] == ["built"]
    assert all("Window" not in plan_of(df) for df in (read[0].report, read[0].samples, read[0].skipped))
    assert "volatility_20" not in plan_of(read[0].sequences)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_precheck_stops_the_build(spark, inputs):
    with (inputs / "labels.csv").open("a") as f:
        f.write("GONE,2021-10-04,0,hand\n,2021-10-04,1,hand\n")
    with pytest.raises(ValueError, match="missing_daily_file=2"):
        build(spark, inputs)
    with pytest.raises(RuntimeError, match="skip ratio"):
        build(spark, inputs, precheck=False, max_skip_ratio=0.2)
    assert not (inputs / "out").exists()  # the limit is checked before anything is written
    assert build(spark, inputs, precheck=False, max_skip_ratio=0.5, save_sequence=False)["num_skipped"] == 1


def test_build_with_other_label_names(spark, inputs):
    text = (inputs / "labels.csv").read_text().replace("ts_code,asof_date", "ts_code,trade_date")
    (inputs / "labels.csv").write_text(text)
    assert build(spark, inputs, save_sequence=False)["num_samples"] == 3


def test_scan_skips_have_a_reason(spark):
    frames = [cycle_bars().assign(ts_code="GOOD"), cycle_bars(days=30).assign(ts_code="YOUNG")]
    twice = cycle_bars().assign(ts_code="TWICE")
    frames.append(pd.concat([twice, twice.iloc[[5]]]))
    bars = spark.createDataFrame(pd.concat(frames))
    undated = bars.where("ts_code = 'YOUNG'").limit(2).withColumns({"ts_code": F.lit("UNDATED"), "trade_date": F.lit(None).cast("timestamp")})
    skips = lambda policy: {r.ts_code: r.reason for r in jobs.scan_skips(bars.unionByName(undated), 120, 160, policy).collect()}
    rest = {"YOUNG": "insufficient_history", "UNDATED": "no_valid_date"}
    assert skips("raise") == {**rest, "TWICE": "duplicate_dates"} and skips("last") == rest


def universe(spark, symbols=12, days=240):
    frame = random_bars(symbols, days, seed=5)
    frame["open"] = frame[["high", "low"]].mean(axis=1)
    frame["high"] = frame[["open", "high", "close"]].max(axis=1)
    frame["low"] = frame[["open", "low", "close"]].min(axis=1)
    labels = []
    for code, d in frame.groupby("ts_code"):
        d = d.reset_index(drop=True)
        for i in range(100, days - 5, 5):
            labels.append((code, d.trade_date[i], int(d.close[i] > d.close[i - 10])))
    return spark.createDataFrame(frame), spark.createDataFrame(labels, "ts_code string, asof_date date, label int")


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    bars, labels = universe(spark)
    built = build_dataset(labels, bars, 120, 120, "stratified", save_sequence=False)
    path = str(tmp_path_factory.mktemp("set") / "samples")
    built.samples.write.parquet(path)
    return bars, labels, spark.read.parquet(path)


def test_skips_are_explained(spark, dataset):
    bars, labels, samples = dataset
    more = labels.unionByName(spark.createDataFrame([("ZZ", pd.Timestamp("2024-05-01").date(), 1)], labels.schema))
    faulty = bars.withColumn("vol", F.when((F.col("ts_code") == "S1") & (F.col("trade_date") == "2024-02-01"), -1.0).otherwise(F.col("vol")))
    built = build_samples(more, faulty, 120, 120)
    row = skip_report(built).first()
    per_symbol = labels.count() // 12
    short = 11 * sum(1 for i in range(100, 235, 5) if i + 1 < 120)
    assert (row.num_labels, row.num_skipped, row.num_short_history) == (12 * per_symbol + 1, per_symbol + 1, short)
    assert row.num_samples == row.num_labels - row.num_skipped - row.num_short_history
    with pytest.raises(RuntimeError):
        check_skip_limit(skip_report(built.where("skip_reason is not null")), None)


def test_features_of_missing_ids(spark, dataset):
    meta = dataset[2].select("sample_id", "label")
    assert align_features(meta, dataset[2].select("sample_id", *FEATURES)).count() == meta.count()
    with pytest.raises(KeyError, match="count="):
        align_features(meta, dataset[2].where("label = 1").select("sample_id", *FEATURES))


def test_logistic_regression_is_at_the_optimum(spark, dataset):
    train = dataset[2].where("split = 'train'")
    terms = m.logistic_terms(train)
    raw = train.select("label", *FEATURES).toPandas().fillna(0.0)
    x = raw[FEATURES].to_numpy()
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    w = np.array([terms[c] for c in FEATURES])
    p = 1 / (1 + np.exp(-(x @ w + terms["intercept"])))
    gradient = w + x.T @ (p - raw.label.to_numpy())
    assert np.abs(gradient).max() < 1e-7 and abs((p - raw.label.to_numpy()).sum()) < 1e-7


def test_logistic_regression_repeats(spark, dataset):
    first, again = (jobs.train_and_validate(dataset[2], "logistic_regression") for _ in range(2))
    order = lambda t: [tuple(r) for r in t.predictions.orderBy("sample_id").collect()]
    assert order(first) == order(again) and first.metrics.first().auc > 0.7


@pytest.fixture(scope="module")
def trees(spark, dataset):
    """Both boosted configurations as they are, each fitted once."""
    return {name: jobs.train_and_validate(dataset[2], name) for name in ("lightgbm", "xgboost")}


@pytest.mark.parametrize("name", ["lightgbm", "xgboost"])
def test_configured_trees_learn(spark, trees, name):
    found = trees[name]
    assert len(found.model.stages[-1].trees) == 200
    assert found.metrics.first().auc > 0.7
    assert roc_auc(found.predictions).first().auc == pytest.approx(found.metrics.first().auc)
    assert set(found.predictions.columns) == {"sample_id", "y_true", "y_score", "y_pred"}


def test_unknown_model(spark, dataset):
    with pytest.raises(ValueError, match="unknown model"):
        m.make_estimator("forest")


def test_predictor_guards(spark, dataset):
    train = dataset[2].where("split = 'train'")
    model = m.train_model(train)
    with pytest.raises(ValueError, match="non-feature"):
        m.predict_proba(model, train)
    with pytest.raises(ValueError, match="no rows"):
        m.predict_proba(model, train.select(*FEATURES).limit(0))
    with pytest.raises(ValueError, match="missing feature"):
        m.score(model, train.drop("volatility_20"))
    turned = train.select(*reversed(FEATURES))
    scored = m.predict_proba(model, turned)
    assert scored.count() == train.count() and scored.columns == [*FEATURES, "score"]


def test_constant_feature_scales_to_zero(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    stats = m.scaler_statistics(rows, ["a", "b"])
    out = m.apply_scaler(rows, stats, ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_train_scan_and_log(spark, dataset, tmp_path):
    bars, _, samples = dataset
    samples.write.parquet(str(tmp_path / "set"))
    trained = jobs.run_training(spark, str(tmp_path / "set"), str(tmp_path / "lr"), experiments=str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert (row.model_name, row.n_features, row.label_source) == ("logistic_regression", 11, "labels.csv")
    assert row.auc == pytest.approx(trained.metrics.first().auc)
    bars.write.parquet(str(tmp_path / "bars"))
    found = jobs.run_scan(spark, str(tmp_path / "bars"), str(tmp_path / "lr/model"), str(tmp_path / "scan.csv"), 120, 160, CONTRACT_UNITS)
    scores = [r.score for r in found.collect()]
    assert len(scores) == 12 and scores == sorted(scores, reverse=True)
    lines = [x for p in sorted(tmp_path.glob("scan_*/asof_date=*/*.csv")) for x in p.read_text().splitlines()[1:]]
    written = [float(x.rpartition(",")[2]) for x in lines]
    assert written == sorted(written, reverse=True)
    dated = [p.name for p in tmp_path.iterdir() if p.name.startswith("scan_")]
    assert dated == ["scan_2024-08-27.csv"]
    assert readers.read_report(spark, str(tmp_path / "skips_scan.json")).isEmpty()  # written although none is left out
    with pytest.raises(ValueError, match="no symbol"):
        jobs.run_scan(spark, str(tmp_path / "bars"), str(tmp_path / "lr/model"), str(tmp_path / "none"), 120, 1000, CONTRACT_UNITS)
    left_out = readers.read_report(spark, str(tmp_path / "skips_none.json")).collect()
    assert len(left_out) == 12 and {r.reason for r in left_out} == {"insufficient_history"}
    again = readers.read_predictions(spark, str(tmp_path / dated[0]))
    assert again.count() == 12 and "asof_date" in again.columns


def test_two_model_scan(spark, dataset, trees):
    models = {"lgbm": trees["lightgbm"].model, "xgb": trees["xgboost"].model}
    rows = jobs.scan_intersection(models, dataset[0], 5, window_size=120, min_history=160).collect()
    assert len(rows) == 5
    assert all(r.score_min <= r.score_mean and r.rank_sum == r.rank_lgbm + r.rank_xgb for r in rows)
    assert [r.score_mean for r in rows] == sorted((r.score_mean for r in rows), reverse=True)


def test_intersection_job_writes_or_complains(spark, dataset, tmp_path):
    train = dataset[2].where("split = 'train'")
    m.save_model(m.train_model(train), str(tmp_path / "lr"))
    paths = {"a": str(tmp_path / "lr"), "b": str(tmp_path / "lr")}
    dataset[0].write.parquet(str(tmp_path / "bars"))
    args = (spark, str(tmp_path / "bars"), paths, str(tmp_path / "both.csv"), 7, CONTRACT_UNITS)
    assert jobs.run_scan_intersection(*args).count() == 7
    assert [p.name for p in tmp_path.glob("both_*")] == ["both_2024-08-27.csv"]
    with pytest.raises(ValueError, match="share no candidate"):
        jobs.run_scan_intersection(*args, min_history=1000)


def test_reports(spark, dataset, tmp_path):
    from barloom.plans import reports

    bars, labels, samples = dataset
    meta, features = samples.select("sample_id", "label", "split"), samples.select("sample_id", *FEATURES)
    sections = reports.inspect_dataset(meta, features, 3)
    assert sections["shape_check"].first().ids_aligned and sections["top_missing"].count() == 3
    summary = {r.feature: r.asDict() for r in sections["numeric_summary"].collect()}
    want = features.toPandas()[FEATURES].describe().T
    for f in FEATURES:
        for ours, theirs in {"mean": "mean", "std": "std", "q25": "25%", "q50": "50%", "max": "max"}.items():
            assert summary[f][ours] == pytest.approx(want.loc[f, theirs])
    with pytest.raises(ValueError):
        reports.inspect_dataset(meta.limit(3), features)

    predictions = jobs.train_and_validate(samples).predictions
    found = reports.inspect_predictions(predictions, 5)
    assert found["basic_info"].first().mode == "validation" and found["top_high_score"].count() == 5
    scan_only = reports.inspect_predictions(predictions.drop("y_true", "y_pred"), 5)
    assert "validation_metrics" not in scan_only

    contract = reports.check_contract(labels, bars, 80)
    assert contract["verdict"].first().ok
    reports.save_report({"verdict": contract["verdict"]}, str(tmp_path / "report"))
    assert readers.read_report(spark, str(tmp_path / "report/verdict")).first().ok
