"""Alignment of two tokenizers over the same bytes, by coalescing intervals."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.token_ids import VOCABULARY, _bytes_of_symbols, encoder, vocabulary_path
from barloom.session import materialize

PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at a time, but for a longer single text.
CHUNK = 1 << 20


@lru_cache(maxsize=4)
def _pieces(name_or_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name_or_path))


@lru_cache(maxsize=4)
def bytes_of_a(name_or_path: str = VOCABULARY) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level vocabulary; none for special ids, which are never made."""
    with open(vocabulary_path(name_or_path), encoding="utf-8") as file:
        model = json.load(file)
    symbol, vocabulary = _bytes_of_symbols(), model["model"]["vocab"]
    found = [b""] * (max(vocabulary.values(), default=-1) + 1)
    special = {t["content"] for t in model.get("added_tokens", [])}
    for token, i in vocabulary.items():
        if token not in special:
            found[i] = bytes(symbol[c] for c in token)
    return tuple(found)


@lru_cache(maxsize=4)
def bytes_of_b(name_or_path: str = PIECES) -> tuple[bytes, ...]:
    """The bytes of every id of a piece model: U+2581 is a space, a byte piece is its byte."""
    model = _pieces(name_or_path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            found.append(b"")
        else:
            found.append(piece.replace("▁", " ").encode("utf-8"))
    return tuple(found)


@lru_cache(maxsize=2)
def linkable(a_name: str = VOCABULARY, b_name: str = PIECES) -> np.ndarray:
    """All id pairs, as a * number of B ids + b, that can end together: one's bytes end with the other's.

    So there are no more of them than the bytes of both vocabularies, whatever the corpus.
    """
    a, b = bytes_of_a(a_name), bytes_of_b(b_name)
    ids_of: tuple[dict, dict] = ({}, {})
    for side, tokens in zip(ids_of, (a, b)):
        for i, token in enumerate(tokens):
            if token:
                side.setdefault(token, []).append(i)
    pairs = {i * len(b) + j for i, token in enumerate(a) for k in range(len(token)) for j in ids_of[1].get(token[k:], ())}
    pairs |= {i * len(b) + j for j, token in enumerate(b) for k in range(1, len(token)) for i in ids_of[0].get(token[k:], ())}
    return np.array(sorted(pairs), np.int64)


@dataclass(frozen=True)
class Alignment:
    """Tokens of a run of texts laid end to end, their byte ends, and groups.

    `a_texts` and `b_texts` are where each text begins among the tokens, and the total; `a_groups` and
    `b_groups` are where each group begins, and the total.
    """

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_texts: np.ndarray
    b_texts: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray


def _encoded(texts: list[str], a_name: str, b_name: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A ids and B ids of each text; none of either where their bytes are not a space and the text."""
    none = np.zeros(0, np.int64)
    a_coder, b_coder, b_bytes = encoder(a_name), _pieces(b_name), bytes_of_b(b_name)
    found: tuple[list, list] = ([], [])
    for text, b in zip(texts, b_coder.encode(texts, num_threads=1)):
        whole = b" " + text.encode("utf-8", "surrogatepass")
        a = none
        if text and b"".join(map(b_bytes.__getitem__, b)) == whole:
            a = np.asarray(a_coder.encode_to_numpy(" " + text, disallowed_special=()), np.int64)
            if a_coder.decode_bytes(a.tolist()) != whole:
                a = none
        found[0].append(a)
        found[1].append(np.array(b if len(a) else (), np.int64))
    return found


@lru_cache(maxsize=8)
def _sizes(tokens: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins among A tokens and among B tokens, and the totals.

    Both sides tile the same bytes. All tokens are sorted by their start; a group ends where a start reaches
    the largest end before it.
    """
    starts = np.concatenate([np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]]) if len(a_ends) else np.zeros(0, np.int64)
    ends, of_a = np.concatenate([a_ends, b_ends]), np.arange(len(starts)) < len(a_ends)
    order = np.lexsort((~of_a, starts))
    reached = np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[order][1:] >= reached[:-1]]) if len(order) else np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(of_a[order])]
    a_groups = np.r_[before[first], len(a_ends)]
    return a_groups, np.r_[first - before[first], len(b_ends)]


def align_texts(texts: list[str], a_name: str = VOCABULARY, b_name: str = PIECES) -> Alignment:
    a_ids, b_ids = _encoded(texts, a_name, b_name)
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(a_ids + none), np.concatenate(b_ids + none)
    a_ends, b_ends = np.cumsum(_sizes(bytes_of_a(a_name))[a]), np.cumsum(_sizes(bytes_of_b(b_name))[b])
    a_texts, b_texts = (np.cumsum([0] + [len(x) for x in side]) for side in (a_ids, b_ids))
    return Alignment(a, b, a_ends, b_ends, a_texts, b_texts, *coalesced(a_ends, b_ends))


def overlaps(found: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A token and a B token that share a byte, by their places; they lie within groups."""
    a_starts, b_starts = np.r_[0, found.a_ends][:-1], np.r_[0, found.b_ends][:-1]
    low = np.searchsorted(found.b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, found.a_ends) - low
    first = np.cumsum(n) - n
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(first - low, n)


def links(found: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that end together, by their places: of a group's tokens, the last of either side."""
    return found.a_groups[1:] - 1, found.b_groups[1:] - 1


@lru_cache(maxsize=2)
def _written(n_a: int, n_b: int) -> list[str]:
    """Every id as text with what follows it: A in a group, last A, B in a group, last B."""
    return [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]


def group_texts(found: Alignment, n_a: int, n_b: int) -> list[str]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
    last_a, last_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
    at_a, at_b = links(found)
    last_a[at_a], last_b[at_b] = True, True
    # a group's A tokens stand before its B tokens
    a_place = np.arange(len(found.a)) + np.repeat(found.b_groups[:-1], np.diff(found.a_groups))
    b_place = np.arange(len(found.b)) + np.repeat(found.a_groups[1:], np.diff(found.b_groups))
    codes = np.empty(len(found.a) + len(found.b), np.int64)
    codes[a_place] = found.a + n_a * last_a
    codes[b_place] = found.b + 2 * n_a + n_b * last_b
    written, codes = _written(n_a, n_b).__getitem__, codes.tolist()
    ends = (found.a_texts + found.b_texts).tolist()
    return ["".join(map(written, codes[s:e]))[:-1] for s, e in zip(ends, ends[1:])]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def aligned_spans(docs: DataFrame, a_name: str = VOCABULARY, b_name: str = PIECES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id and its groups, each with its bytes (`start`, `end`) of a
    space and the text, its ids `a` and `b`, and `overlaps`, the pairs of places in them that share a byte.

    Cases are those of `alignment_digests`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            at = 0
            for texts in _chunks(batch["text"].tolist()):
                found = align_texts(texts, a_name, b_name)
                over_a, over_b = overlaps(found)
                group_of = np.searchsorted(found.a_groups, over_a, side="right") - 1
                edges = np.searchsorted(group_of, np.arange(len(found.a_groups)))
                first = np.searchsorted(found.a_groups, found.a_texts)
                rows = []
                for s, e in zip(first.tolist(), first[1:].tolist()):
                    base = int(found.a_ends[found.a_groups[s] - 1]) if s else 0
                    groups = []
                    for g in range(s, e):
                        a0, a1, b0, b1 = found.a_groups[g], found.a_groups[g + 1], found.b_groups[g], found.b_groups[g + 1]
                        pairs = slice(edges[g], edges[g + 1])
                        groups.append(
                            {
                                "start": (int(found.a_ends[a0 - 1]) if a0 else 0) - base,
                                "end": int(found.a_ends[a1 - 1]) - base,
                                "a": found.a[a0:a1].tolist(),
                                "b": found.b[b0:b1].tolist(),
                                "overlaps": [{"a": i, "b": j} for i, j in zip((over_a[pairs] - a0).tolist(), (over_b[pairs] - b0).tolist())],
                            }
                        )
                    rows.append(groups)
                yield pd.DataFrame({"doc_id": ids[at : at + len(texts)], "groups": rows})
                at += len(texts)

    kind = "array<struct<start long, end long, a array<int>, b array<int>, overlaps array<struct<a int, b int>>>>"
    return _rows(docs).mapInPandas(run, f"doc_id long, groups {kind}")


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"


def _digested(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_a, n_b, known = len(bytes_of_a(a_name)), len(bytes_of_b(b_name)), linkable(a_name, b_name)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for texts in _chunks(batch.column("text").to_pylist()):
                found = align_texts(texts, a_name, b_name)
                at_a, at_b = links(found)
                pairs = np.searchsorted(known, found.a[at_a] * n_b + found.b[at_b])
                edges = np.searchsorted(found.a_groups, found.a_texts)
                groups = np.diff(edges)
                hashed = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(found, n_a, n_b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)),
                        pa.array(np.diff(found.a_texts)),
                        pa.array(np.diff(found.b_texts)),
                        pa.array(groups),
                        pa.array(groups),
                        pa.array(hashed, pa.string()),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(pairs.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )
                at += len(texts)

    return run


def _summed(counts: np.ndarray, best: np.ndarray):
    """Adds up the counts of each row's links, and which of them are their B id's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("links")
            edges, pairs = column.offsets.to_numpy(), column.values.to_numpy()
            sums = [np.r_[0, np.cumsum(x[pairs])][edges] for x in (best.astype(np.int64), counts)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(np.diff(s)) for s in sums)], names=[*batch.schema.names[:-1], "n_best", "count_sum"]
            )

    return run


def alignment_digests(docs: DataFrame, a_name: str = VOCABULARY, b_name: str = PIECES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): how the tokens of both vocabularies align, and how often so.

    A encodes a space and the text, B the text, which it sets a space before; strings of special tokens are
    plain text. Byte places where a token of either side ends cut both into groups, `groups_sha256` of them.
    A link is a pair of tokens that end together; `count_sum` adds up how many links of the corpus hold
    each link's id pair, `n_best` counts links whose pair is the most frequent of its B id, ties included.

    The tokens are made once and links written as numbers of `linkable` pairs, so counts are one aggregate and as
    many numbers as there are such pairs, which the vocabularies alone bound, go to the driver and to tasks.

    Texts that are null, empty, or whose tokens do not give back their bytes have no tokens: zeros and an empty
    digest. Null ids and repeated rows are rows of their own, and repeated texts count each time. Very long
    texts are aligned whole. Other columns are ignored; no rows give no rows.
    """
    written = materialize(_rows(docs).mapInArrow(_digested(a_name, b_name), DIGEST), "alignment")
    counted = written.select(F.explode("links").alias("pair")).groupBy("pair").count().collect()
    known, n_b = linkable(a_name, b_name), len(bytes_of_b(b_name))
    counts = np.zeros(len(known), np.int64)
    counts[[r["pair"] for r in counted]] = [r["count"] for r in counted]
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, known % n_b, counts)
    best = (counts > 0) & (counts == most[known % n_b])
    names = DIGEST.removesuffix(", links array<int>")
    return written.mapInArrow(_summed(counts, best), f"{names}, n_best long, count_sum long")
