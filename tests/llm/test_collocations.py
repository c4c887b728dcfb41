"""Collocations against plain counting of every run of words."""

import collections
import re

import numpy as np
from corpus import EDGES, edge_table, no_rows, prose, stored
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import collocations as module
from barloom.llm.collocations import build_index, collocations, numbered, phrase_counts, phrases_of


def plain_counts(texts, longest):
    counts = collections.Counter()
    for text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts


def plain_collocations(rows, most, longest, least, inside):
    found = []
    for lang in sorted({lang or "und" for lang, _ in rows}):
        f = plain_counts([t for x, t in rows if (x or "und") == lang], longest)
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            holders = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * often[q] >= inside * a for q in holders):
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        found += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAB ,\t\n\x1cé", max_size=30), max_size=4), st.integers(1, 5))
def test_index_counts_every_phrase(texts, longest):
    ids, words = numbered(texts)
    words = [w.decode() for w in words.to_pylist()]
    assert words == sorted(words, key=str.encode)
    found = {}
    for phrases in phrases_of(ids, longest):
        for places, n in zip((phrases.words - 1).tolist(), phrases.count.tolist()):
            found[tuple(words[i] for i in places)] = n
    assert found == plain_counts(texts, longest)


def test_intervals_hold_the_suffixes():
    ids = np.array([0, 1, 2, 1, 2, 3, 0, 2, 1, 0])
    index = build_index(ids, 2)
    assert index.last.tolist() == [ids[i - 1] for i in sorted(range(len(ids)), key=lambda i: (ids[i], ids[(i + 1) % len(ids)], i))]
    assert np.diff(index.first).tolist() == [3, 3, 3, 1]


def test_collocations_equal_plain_counting(spark, tmp_path):
    texts = [prose(k % 7, 150) + " New York City. of the new, york" for k in range(40)] + ["a a a a a a a a a a a a! A\ta\x0ba", "", None]
    rows = [(["en", "fr", None][k % 3], t) for k, t in enumerate(texts)]
    docs = stored(spark, tmp_path, rows, "lang string, text string").repartition(5)
    for most, longest, least, inside in ((2000, 3, 10, 50), (7, 3, 2, 90), (50, 5, 3, 50)):
        expected = plain_collocations(rows, most, longest, least, inside)
        assert [tuple(r) for r in collocations(docs, most, longest, least, inside).orderBy("lang", "rank").collect()] == expected
    assert phrase_counts(docs, 1, 10**9).where("phrase <> ''").isEmpty()


def test_one_shard_or_many(monkeypatch):
    texts = [prose(k, 60) for k in range(30)]
    monkeypatch.setattr(module, "SHARD", 500)
    batch = module.pa.RecordBatch.from_pydict({"lang": ["en"] * 30, "text": texts})
    total = collections.Counter()
    parts = list(module._sharded(3, 4)(iter([batch])))
    assert len(parts) > 10
    for bucket in range(4):
        own = module.pa.Table.from_batches(parts).filter(module.pc.equal(module.pc.field("bucket"), bucket))
        merged = module._merged(1)(own).to_pydict()
        total.update({tuple(p.split()): n for p, n in zip(merged["phrase"], merged["f"]) if p})
    assert total == plain_counts(texts, 3)


def test_exact_scores_beyond_64_bits(spark):
    score = "cast(1000000 * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    a, l, r = 10**13 + 7, 10**14 + 9, 3 * 10**13 + 1
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(score).first()[0] == 1000000 * a * a // (l * r)
    assert score in open(module.__file__).read()


def test_edges(spark, tmp_path):
    rows = collocations(edge_table(spark, str(tmp_path)), least=4).collect()
    assert rows and {r["lang"] for r in rows} == {"en"}
    expected = plain_collocations([(r[2], r[1]) for r in EDGES], 2000, 3, 4, 50)
    assert collocations(edge_table(spark, str(tmp_path))).isEmpty()
    assert sorted(map(tuple, rows)) == sorted(expected)
    assert collocations(no_rows(spark, str(tmp_path))).isEmpty()
