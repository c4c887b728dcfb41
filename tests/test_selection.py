"""Order statistics by histogram passes against sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import barloom.functions.selection as selection
from barloom.functions.selection import quantiles, select_places

INF = float("inf")
DRAWS = {
    "uniform": lambda d: d.random(),
    "ties": lambda d: float(d.randrange(4)),
    "sizes": lambda d: d.choice([-1, 1]) * 10.0 ** d.uniform(-300, 300),
    "one sign": lambda d: 10.0 ** d.uniform(-300, 300),
    "hot": lambda d: 7.0 if d.random() < 0.7 else d.gauss(0, 1e-9),
    "ends": lambda d: d.choice([-INF, INF, 0.0, -0.0, 1.0, -1.7e308, 1.7e308, 5e-324]),
    "constant": lambda d: 3.5,
}


@pytest.fixture(params=[20_000, 5], ids=["fetched", "passes"])
def fetched(request, monkeypatch):
    monkeypatch.setattr(selection, "FETCHED", request.param)


def test_places_equal_sorted_values(spark, fetched):
    draw = random.Random(3)
    values = {name: [make(draw) for _ in range(400)] for name, make in DRAWS.items()}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(3)
    places = {(g,): [0, 1, 57, 199, 200, 398, 399] for g in values}
    found = select_places(rows, "v", ["g"], {(g,): (400, min(vs), max(vs)) for g, vs in values.items()}, places)
    for g, vs in values.items():
        assert found[(g,)] == {p: sorted(vs)[p] for p in places[(g,)]}, g


def test_quantiles_of_groups(spark):
    draw = random.Random(5)
    values = {"a": [draw.gauss(0, 1) for _ in range(301)], None: [draw.gauss(5, 2) for _ in range(40)], "one": [2.5], "none": [None]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in quantiles(rows, "v", {"q10": 0.1, "q50": 0.5, "q100": 1.0}, ["g"], {"mean": F.avg("v"), "n": F.count("v")}).collect()}
    assert got.keys() == {"a", None, "one"}
    for g, r in got.items():
        assert [r["q10"], r["q50"], r["q100"]] == pytest.approx(np.quantile(values[g], [0.1, 0.5, 1.0]), rel=1e-12)
        assert r["mean"] == pytest.approx(np.mean(values[g])) and r["n"] == len(values[g])


def test_input_is_evaluated_once_and_not_sorted(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1000).select(F.rand(1).alias("v")).mapInPandas(count, "v double")
    quantiles(rows, "v", {"q": 0.25}).collect()
    assert seen.value == 1000


def test_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "v double"), "v", {"q": 0.5}).isEmpty()
