"""Token alignment against sets of byte ends of each text, with the tokenizers' own libraries."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from corpus import EDGES, edge_table, no_rows, prose, stored
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.token_alignment import aligned_spans, alignment_digests, coalesced, linkable

TEXTS = [
    prose(1, 80), prose(1, 80), prose(2, 200), " lead and  two  spaces\t\ttabs\r\n", "a<|endoftext|>b </s><s> <unk> <0x41>", "Größe, déjà vu — 你好 \U0001f600\U0001f468‍\U0001f469",
    "▁ not a space", "\x00 \x1b nul", "é" * 40, "x" * 3000, "", None, "fi ﬁ Ⅳ ½", "é combining", "￿ ﷺ", "　 wide",
]


@pytest.fixture(scope="module")
def coders():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(text, coders):
    """(id, bytes) of either side, or none where the bytes are not those of the text."""
    a_coder, b_coder = coders
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    whole = b" " + (text or "").encode()
    a = [(i, bytes(byte[c] for c in a_coder.id_to_token(i))) for i in a_coder.encode(" " + (text or ""), add_special_tokens=False).ids]
    b = []
    for i in b_coder.encode(text or ""):
        piece = b_coder.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode()))
    same = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
    return (a, b) if same else ([], [])


def plain_groups(a, b):
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    groups, done = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [side.index(end) + 1 for side in ends]
        groups.append(([i for i, _ in a[done[0] : to[0]]], [i for i, _ in b[done[1] : to[1]]]))
        done = to
    return groups


def test_digests_equal_plain_alignment(spark, tmp_path, coders):
    docs = stored(spark, tmp_path, list(enumerate(TEXTS)), "doc_id long, text string")
    tokens = {d: plain_tokens(t, coders) for d, t in enumerate(TEXTS)}
    groups = {d: plain_groups(*t) for d, t in tokens.items()}
    counts = collections.Counter((g[0][-1], g[1][-1]) for gs in groups.values() for g in gs)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = {r["doc_id"]: r for r in alignment_digests(docs).collect()}
    assert len(rows) == len(TEXTS) and rows[0]["n_groups"] == rows[1]["n_groups"] > 50
    for d, gs in groups.items():
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        linked = [(a[-1], b[-1]) for a, b in gs]
        expected = {
            "doc_id": d, "n_a": len(tokens[d][0]), "n_b": len(tokens[d][1]), "n_groups": len(gs), "n_links": len(gs),
            "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if gs else "",
            "n_best": sum(counts[x] == best[x[1]] for x in linked), "count_sum": sum(counts[x] for x in linked),
        }
        assert rows[d].asDict() == expected, TEXTS[d]
    assert all(rows[d]["n_a"] == 0 for d, t in enumerate(TEXTS) if not t or t[0] == "▁")

    spans = {r["doc_id"]: r["groups"] for r in aligned_spans(docs).collect()}
    for d, gs in groups.items():
        assert [(g["a"], g["b"]) for g in spans[d]] == gs
        whole, (a, b) = b" " + (TEXTS[d] or "").encode(), tokens[d]
        edge = [np.cumsum([0] + [len(x) for _, x in side]).tolist() for side in (a, b)]
        shared = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(edge[0][i], edge[1][j]) < min(edge[0][i + 1], edge[1][j + 1])] if len(a) < 400 else None
        if shared is not None:
            first, got = [0, 0], []
            for g in spans[d]:
                got += [(o["a"] + first[0], o["b"] + first[1]) for o in g["overlaps"]]
                first = [first[0] + len(g["a"]), first[1] + len(g["b"])]
            assert got == shared
        assert b"".join(whole[g["start"] : g["end"]] for g in spans[d]) == (whole if gs else b"")


def test_linkable_pairs_hold_every_link(coders):
    pairs = set(linkable().tolist())
    for text in filter(None, TEXTS):
        for a, b in plain_groups(*plain_tokens(text, coders)):
            assert a[-1] * 32000 + b[-1] in pairs


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 40).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, max(n - 1, 1))), st.sets(st.integers(1, max(n - 1, 1))))))
def test_groups_end_where_both_end(case):
    n, a, b = case
    a_ends, b_ends = (np.array(sorted({x for x in side if x < n} | ({n} if n else set())), np.int64) for side in (a, b))
    a_groups, b_groups = coalesced(a_ends, b_ends)
    both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
    assert a_ends[a_groups[1:] - 1].tolist() == both == b_ends[b_groups[1:] - 1].tolist()


def test_edges(spark, tmp_path):
    rows = alignment_digests(edge_table(spark, str(tmp_path))).collect()
    assert len(rows) == len(EDGES)
    assert all(r["n_a"] == r["count_sum"] == 0 and r["groups_sha256"] == "" for r in rows if r["doc_id"] in (3, 4, 5))
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert alignment_digests(no_rows(spark, str(tmp_path))).isEmpty() and aligned_spans(no_rows(spark, str(tmp_path))).isEmpty()
