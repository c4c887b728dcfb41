"""License notices against every block of every text."""

import math
import random

import pytest
from corpus import EDGES, edge_table, no_rows, stored
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import license_scan as scan_module
from barloom.llm.license_scan import build_scan, find_blocks, license_scan, scan_texts

T = [("x", "a b c d e"), ("y", "a a b f"), ("z", "c")]


def blocks_of(words, template, threshold):
    t = template.split()
    needed = max(1, math.ceil(threshold * len(set(t)) - 1e-9))
    held = {s: len(set(words[s : s + len(t)]) & set(t)) for s in range(len(words))}
    return {s: h for s, h in held.items() if h >= needed}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=25), min_size=1, max_size=4), st.sampled_from([0.3, 0.6, 0.8, 1.0]), st.integers(0, 5))
def test_blocks_equal_every_block(texts, threshold, seed):
    draw = random.Random(seed)
    scan = build_scan([("p", "a b")], T, threshold, {k: draw.randrange(5) for k in range(7)})
    hashes, starts = scan_module.hash_words([" ".join(t) for t in texts], classes=scan_module.CLASSES)
    ids = scan_module._known(scan, hashes)
    for k, (_, words) in enumerate(T):
        first, held = find_blocks(scan, k, ids, starts)
        found = dict(zip(first.tolist(), held.tolist()))
        expected = {}
        for at, t in zip(starts.tolist(), texts):
            every = blocks_of(t, words, threshold)
            expected |= {at + s: h for s, h in every.items() if t[s] in words.split()}
            here = [h for s, h in found.items() if at <= s < at + len(t)]
            assert max(here, default=0) == max(every.values(), default=0)
        assert found == expected
    for row, t in zip(scan_texts(scan, [" ".join(t) for t in texts]), texts):
        at = [i for i in range(len(t) - 1) if t[i : i + 2] == ["a", "b"]]
        assert (row["n_base"], row["first_word"], row["last_word"]) == (len(at), min(at, default=None), max(at, default=None))


def test_notices(spark, tmp_path):
    mit = scan_module.TEMPLATES[0][1]
    texts = {
        1: "Released UNDER the\nMIT-License; under (the) mit... license.",
        2: "prose " * 30 + mit.replace("free of charge", "at no cost").title() + " prose" * 30,
        3: "under the mit",
        4: "license under the mit",
        5: "Apache\tLicense, Version 2.0 and cc BY-nc é",
        6: "This work is licensed under the GNU General Public\n * License, version 2.",
        7: "a work of the public under the general license",
        8: "under the mit licenseé",
    }
    rows = {r["doc_id"]: r for r in license_scan(stored(spark, tmp_path, list(texts.items()), "doc_id long, text string")).collect()}
    assert [rows[1][c] for c in ("n_words", "n_base", "first_word", "last_word", "labels", "score")] == [9, 2, 1, 5, "mit", 1.0]
    assert rows[2]["base_labels"] == "" and rows[2]["labels"] == "mit" and 0.8 <= rows[2]["score"] < 1
    (block,) = rows[2]["blocks"]
    assert block["first"] <= 31 and block["last"] >= 48
    assert [rows[5][c] for c in ("base_labels", "first_word", "last_word", "n_words")] == ["apache-2,cc-by-nc", 0, 6, 10]
    assert rows[6]["labels"] == "gpl" and rows[6]["base_labels"] == ""
    assert all(rows[k]["labels"] == "" and rows[k]["score"] == 0 and rows[k]["first_word"] is None for k in (3, 4, 7, 8))


def test_edges(spark, tmp_path):
    rows = license_scan(edge_table(spark, str(tmp_path))).collect()
    assert len(rows) == len(EDGES) and all(r["labels"] == "" and r["score"] == 0 and r["blocks"] == [] for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert [r["n_words"] for r in rows if r["doc_id"] in (7, 8)] in ([30_000, 1], [1, 30_000])
    assert license_scan(no_rows(spark, str(tmp_path))).isEmpty()
    assert license_scan(edge_table(spark, str(tmp_path)), [], []).count() == len(EDGES)
    with pytest.raises(ValueError):
        license_scan(edge_table(spark, str(tmp_path)), threshold=0.0)
