"""Trust and distrust over the link graph of hosts, against plain PageRank."""

import numpy as np
from pyspark.sql import functions as F

from barloom.llm.url_filter import judge_urls, propagate

RULES = [("allow", "good.org/"), ("block", "net/es/")]
PAGE = "page_id long, url string, html string"


def verdicts(spark, pages):
    return {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(pages, PAGE), RULES).collect()}


def test_ranks_are_those_of_plain_pagerank(spark):
    rng = np.random.default_rng(3)
    n = 25
    weights = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.15)
    np.fill_diagonal(weights, 0)
    seeds = np.zeros((2, n))
    seeds[0, :2], seeds[1, 5] = 0.5, 1.0
    edges = [(f"h{i}", f"h{j}", float(weights[i, j])) for i, j in zip(*np.nonzero(weights))]
    rows = [(f"h{i}", float(seeds[0, i]), float(seeds[1, i])) for i in range(n)]
    found = propagate(
        spark.createDataFrame(rows, "host string, trusted double, blocked double"),
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        tolerance=1e-6,
    )
    got = {r["host"]: (r["trust_rank"], r["block_rank"]) for r in found.collect()}
    for side, flow in ((0, weights.astype(float)), (1, weights.T.astype(float))):
        sums = flow.sum(axis=1, keepdims=True)
        share = np.divide(flow, sums, out=np.zeros_like(flow), where=sums > 0)
        want = np.linalg.solve(np.eye(n) - 0.85 * share.T, 0.15 * seeds[side])
        assert np.allclose([got[f"h{i}"][side] for i in range(n)], want, atol=1e-5)


def test_a_blocked_host_without_pages_is_a_seed(spark):
    pages = [
        (1, "http://linker.com/a", '<a href="http://gone.net/es/1">x</a>'),
        (2, "http://other.com/a", '<a href="http://gone.net/fr/1">x</a>'),
        (3, "http://plain.com/a", "no link"),
        (4, "http://friend.com/a", '<a href="//gone2.net/fr/1">x</a>'),
    ]
    assert verdicts(spark, pages) == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_distrust_goes_as_far_as_links_do(spark):
    pages = [(k, f"http://h{k}.com/", f'<a href="http://h{k + 1}.com/">x</a>') for k in range(20)]
    pages += [(20, "http://h20.com/", '<a href="http://bad.net/es/">x</a>'), (21, "http://bad.net/es/", ""), (22, "http://good.org/", None)]
    found = verdicts(spark, pages)
    assert {k for k, v in found.items() if v == "block"} == set(range(22)) and found[22] == "allow"


def test_long_pages_ties_and_clashing_columns(spark):
    long = '<a href="http://bad.net/es/">x</a> ' * 20_000
    frame = spark.createDataFrame([(1, "http://a.com/" + "p" * 100_000, long), (1, "http://a.com/", None)], PAGE)
    frame = frame.withColumns({"host": F.lit("z"), "rule": F.lit("z"), "verdict": F.lit("z"), "_rule": F.lit("z")})
    rows = judge_urls(frame, [("block", "bad.net/"), ("allow", "bad.net/")]).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in rows] == [("a.com", None, "block")] * 2
