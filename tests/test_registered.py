"""Registered queries against their check queries on the smallest given tables.

BARLOOM_ALL=1 runs every query; otherwise those that are quick, plus some of each kind.
"""

import os

import pytest

import __spark_entry__ as contract
from oracle_tool import connect, difference, duck_table, spark_table

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
QUICK = [
    "coerce_bars", "duplicates_keep_first", "duplicates_raise", "duplicate_dates", "prepare_labels", "latest_features",
    "window_features_short", "screener_indicators", "asof_join", "dataset_build", "skip_report", "window_sequences",
    "validate_labels", "bar_quality", "sound_symbols", "label_alignment", "contract_findings", "screen",
    "first_rejection", "stratified_split", "train_tail_roles", "roc_auc_with_ties", "score_summary", "numeric_summary",
    "spearman_with_ties", "model_intersection", "future_return_buckets",
]
CHOSEN = sorted(ORACLES) if os.environ.get("BARLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_check(spark, tables, name):
    assert difference(spark_table(QUERIES[name](spark, SF)), duck_table(tables, ORACLES[name])) is None


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, tables):
    assert contract.entry(spark).count() > 0
