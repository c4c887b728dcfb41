"""Queries that read their windows several times make them once; an as-of join makes only what is read."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.catalog import ingest, windows
from barloom.operators.asof import asof_join
from barloom.operators.sequence import window_sequences


def _lines(spark, path, days=140):
    rows = [(o, 1, s, 1, 10.0, 1000.0 + o % 7, 0.01 * (o % 9), 0.02, dt.datetime(2020, 1, 1) + dt.timedelta(days=d)) for s in (1, 2) for d in range(days) for o in [s * 1000 + d]]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_windows_are_made_once(spark, tmp_path, monkeypatch):
    sf, made = _lines(spark, tmp_path), []
    for module in (ingest, windows):
        whole = module.labelled_windows
        monkeypatch.setattr(module, "labelled_windows", lambda *a, whole=whole: made.append(1) or whole(*a))
    ingest.experiment_append(spark, sf).collect()
    assert len(made) == 1
    for query in (windows.misaligned, windows.aligned):
        assert "lineitem" not in str(query(spark, sf).inputFiles())


def test_report_of_two_models_makes_predictions_once(spark, tmp_path, monkeypatch):
    sf, made, whole = _lines(spark, tmp_path), [], ingest.predictions
    monkeypatch.setattr(ingest, "predictions", lambda *a: made.append(1) or whole(*a))
    monkeypatch.setattr(ingest, "model_predictions", None)
    assert {r["model"] for r in ingest.report_json(spark, sf).collect()} == {"a", "b"} and len(made) == 1


def test_asof_join_makes_no_column_that_nobody_reads(spark):
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(4)]
    rows = spark.createDataFrame([("A", day[0], 1.0, None), ("A", day[2], None, 2.0)], "ts_code string, trade_date date, x double, y double")
    rows = rows.withColumn("z", F.upper(F.concat_ws("#", F.col("x").cast("string"), F.lit("costly"))))
    asked = spark.createDataFrame([("A", d) for d in [day[0] - dt.timedelta(days=1), *day]] + [("B", day[0])], "ts_code string, asof_date date")
    found = asof_join(asked, rows)
    assert "costly" not in found.select("asof_date", "x")._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["ts_code"], r["asof_date"]): (r["trade_date"], r["x"], r["y"]) for r in found.collect()}
    assert got == {
        ("A", day[0] - dt.timedelta(days=1)): (None, None, None), ("A", day[0]): (day[0], 1.0, None), ("A", day[1]): (day[0], 1.0, None),
        ("A", day[2]): (day[2], None, 2.0), ("A", day[3]): (day[2], None, 2.0), ("B", day[0]): (None, None, None),
    }


def test_windows_are_not_grouped_after_they_are_cut(spark):
    bars = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(11)], "ts_code string, trade_date date, close double")
    samples = spark.createDataFrame([(f"s{k}", "A", k) for k in (2, 4, 5, 8, 11, 12)], "sample_id string, ts_code string, rn int")
    found = window_sequences(samples, bars, 4, ["close"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join", 1)[0]
    got = {r["sample_id"]: [v[0] for v in r["x_sequence"]] for r in found.collect()}
    assert got == {f"s{k}": [float(k - 4 + i) for i in range(4)] for k in (4, 5, 8, 11)}
