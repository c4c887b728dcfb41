"""Every operator over nulls, empty and very long texts, repeated rows, clashing columns, and no rows."""

import pytest
from corpus import EDGES, edge_table, no_rows, stored

from barloom.llm import fingerprints as fp
from barloom.llm.common import fold
from barloom.llm.decontamination import Index, contamination
from barloom.llm.language_model import lm_scores
from barloom.llm.near_dup import near_duplicates, one_of_each
from barloom.llm.neighbours import edited
from barloom.llm.packing import pack
from barloom.llm.quality import accepted_rows, quality_scores
from barloom.llm.sharding import shard
from barloom.llm.token_output import read_token_shards, write_token_shards
from barloom.llm.toxicity import toxicity_scores, without_toxic
from barloom.llm.url_filter import judge_urls

N = len(EDGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    return edge_table(spark, folder), no_rows(spark, folder)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (99, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def test_quality(tables, labels):
    scores = quality_scores(tables[0], labels)
    assert scores.count() == N and scores.where("score is null or accepted is null").isEmpty()
    assert scores.where("doc_id = 1").select("score").distinct().count() == 1
    kept = accepted_rows(tables[0], labels)
    assert kept.columns == tables[0].columns and kept.count() == scores.where("accepted").count()
    assert quality_scores(tables[1], labels).isEmpty()


def test_toxicity(tables, labels):
    scores = toxicity_scores(tables[0], labels, fold("doc_id", 4) != 2)
    assert scores.count() == N and scores.where("score is null or score < 0 or score > 1").isEmpty()
    kept = without_toxic(tables[0], labels, fold("doc_id", 4) != 2)
    assert kept.columns == tables[0].columns and kept.count() == scores.where("predicted = 0").count()
    assert toxicity_scores(tables[1], labels).isEmpty()
    assert toxicity_scores(tables[0], labels.limit(0)).count() == N


def test_language_model(tables):
    rows = lm_scores(tables[0], fold("doc_id", 10) == 0).collect()
    assert len(rows) == N and all(r["score"] <= 0 and r["base_score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert lm_scores(tables[1], fold("doc_id", 10) == 0).isEmpty()


def test_near_duplicates(tables):
    classes = near_duplicates(tables[0])
    found = {r["row"]: r for r in classes.collect()}
    assert len(found) == N
    by_id = {}
    for r in found.values():
        by_id.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by_id[1] == {1} and by_id[2] == {1} and by_id[3] == by_id[4] == by_id[5] == {3}
    kept = one_of_each(tables[0])
    assert kept.columns == tables[0].columns
    assert kept.count() == len({r["class_row"] for r in found.values()})
    assert near_duplicates(tables[1]).isEmpty()


def test_decontamination(spark, tables, tmp_path):
    items = [(1, EDGES[0][1][:120]), (2, None), (3, ""), (4, "one"), (None, "one"), (5, "one")]
    benchmark = stored(spark, tmp_path, items, "item_id long, text string", "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in contamination(tables[0], benchmark).collect()}
    assert found >= {(1, 1), (2, 1), (6, 4), (6, 5)} and not any(i in (2, 3) for _, i in found)
    assert contamination(tables[1], benchmark).isEmpty()
    assert contamination(tables[0], benchmark.limit(0)).isEmpty()


def test_packing(tables):
    rows = pack(tables[0]).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == 4
    assert pack(tables[1]).isEmpty()


def test_token_shards(spark, tables):
    shards = write_token_shards(tables[0], ids_per_record=64, records_per_shard=8)
    assert shards.index.count() == shards.sequences == read_token_shards(spark, shards).count()
    assert write_token_shards(tables[1]).sequences == 0


def test_fingerprints(tables):
    rows = edited(tables[0])
    assert rows.count() == N
    assert fp.fingerprint_rows(rows, ["row"], "text").count() == N
    assert edited(tables[1]).isEmpty()


def test_sharding(tables):
    rows = shard(tables[0], 5)
    assert set(rows.columns) == set(tables[0].columns) | {"slot"}
    sizes = sorted(r["count"] for r in rows.groupBy("shard").count().collect())
    assert sum(sizes) == N and sizes[-1] - sizes[0] <= 1
    assert shard(tables[1], 3).isEmpty()


def test_urls(spark):
    pages = [(1, None, None), (1, "no scheme", ""), (2, "http://A.b.com/X?y", None), (2, "http://A.b.com/X?y", None), (None, "://", "<a href=//q.org/>")]
    rows = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), [("allow", "com/")]).collect()
    assert len(rows) == 5 and {(r["host"], r["path"], r["rule"]) for r in rows if r["page_id"] == 2} == {("a.b.com", "/X", "com/")}
    assert all(r["rule"] is None and r["verdict"] == "allow" for r in rows if r["page_id"] != 2)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(none, [("allow", "com/")]).isEmpty()


def test_coins_of_the_walk_take_a_byte_each():
    index = Index([(1, EDGES[0][1][:120]), (2, "one two three four five six seven")], 0.8, 0.95)
    words = len(index.vocabulary) + 1
    assert index._bits_of(3, 5).nbytes == words and set(index._bits_of(3, 5).tolist()) <= {0, 1}
