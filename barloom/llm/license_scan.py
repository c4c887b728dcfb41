"""License notices by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import byte_classes, hash_words

#: Words are runs of digits, letters (A-Z lower-cased) and all that is not ASCII.
CLASSES = byte_classes(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)

#: Phrases whose words must stand consecutively, with their labels (fixed values).
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of which a block must hold a share of the words (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8

ROW = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<label string, template int, first long, last long, containment double>>"
)

FOUND = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]


@dataclass(frozen=True)
class Scan:
    """Sorted hashes of all words of phrases and templates, and each phrase and template as places among them.

    A template's distinct words are in global order, the rarest of the corpus first.
    """

    words: np.ndarray
    phrases: tuple[tuple[str, tuple[int, ...]], ...]
    templates: tuple[tuple[str, int, tuple[int, ...]], ...]
    threshold: float

    def needed(self, template: int) -> int:
        return max(1, math.ceil(self.threshold * len(self.templates[template][2]) - 1e-9))


def _tokens(text: str) -> np.ndarray:
    return hash_words([text], classes=CLASSES)[0]


def build_scan(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float, counts: dict[int, int] | None = None) -> Scan:
    """`counts` has the corpus count of each word, by its place in `words`; ties and no counts go by place."""
    tokens = [_tokens(t) for _, t in (*phrases, *templates)]
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]))
    places = [np.searchsorted(words, t).tolist() for t in tokens]
    counts = counts or {}
    return Scan(
        words,
        tuple((label, tuple(p)) for (label, _), p in zip(phrases, places) if p),
        tuple(
            (label, len(p), tuple(sorted(set(p), key=lambda w: (counts.get(w, 0), w))))
            for (label, _), p in zip(templates, places[len(phrases) :])
            if p
        ),
        threshold,
    )


def _known(scan: Scan, hashes: np.ndarray) -> np.ndarray:
    """Place of each word among those of the scan, or their number."""
    if not len(scan.words):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(scan.words, hashes), len(scan.words) - 1)
    return np.where(scan.words[at] == hashes, at, len(scan.words))


def find_phrases(scan: Scan, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The places of each phrase, all of whose words lie in one text."""
    found = []
    for _, words in scan.phrases:
        at = np.flatnonzero(ids[: max(0, len(ids) - len(words) + 1)] == words[0])
        for k, w in enumerate(words[1:], 1):
            at = at[ids[at + k] == w]
        text = np.searchsorted(starts, at, side="right")
        found.append(at[at + len(words) <= starts[np.minimum(text, len(starts) - 1)]])
    return found


def find_blocks(scan: Scan, template: int, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks that hold enough of a template, and how many of its distinct words each holds.

    A block is as many consecutive words as the template has, fewer at the end of a text; of all blocks those
    that begin with a word of the template are returned, as any other holds no more than the next of them.
    """
    _, n, order = scan.templates[template]
    needed = scan.needed(template)
    rank = np.full(len(scan.words) + 1, len(order))
    rank[list(order)] = np.arange(len(order))
    place = rank[ids]
    at = np.flatnonzero(place < len(order))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # length: a text with fewer words holds no block of enough of them
    text = np.searchsorted(starts, at, side="right") - 1
    at = at[(starts[text + 1] - starts[text]) >= needed]
    # prefix: a block without any of the rarest words misses more than it may
    hits = at[place[at] < len(order) - needed + 1]
    # position: so many words of the template must lie within reach of a hit, and of those no rarer than it
    reach = np.searchsorted(at, hits + n) - np.searchsorted(at, hits - n, side="right")
    hits = hits[reach >= needed]
    if not len(hits):
        return none
    after = np.searchsorted(hits, at)
    near = (hits[np.minimum(after, len(hits) - 1)] - at < n) & (after < len(hits))
    near |= (at - hits[np.maximum(after - 1, 0)] < n) & (after > 0)
    at = at[near]
    text = np.searchsorted(starts, at, side="right") - 1
    # each word counts for the blocks that begin after its last place before, and not after itself
    by = np.lexsort((at, place[at], text))
    same = (place[at[by]][1:] == place[at[by]][:-1]) & (text[by][1:] == text[by][:-1])
    before = np.full(len(at), -1)
    before[by[1:][same]] = at[by[:-1][same]]
    low = np.maximum(np.maximum(before + 1, at - n + 1), starts[text])
    held = np.searchsorted(np.sort(low), at, side="right") - np.searchsorted(at, at)
    enough = held >= needed
    return at[enough], held[enough]


def _merged(first: np.ndarray, held: np.ndarray, n: int, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Overlapping blocks of one template as one: its first word, its last, and the most words held."""
    open_first = open_last = most = None
    for a, h, end in zip(first.tolist(), held.tolist(), ends.tolist()):
        last = min(a + n, end) - 1
        if open_first is not None and a <= open_last:
            open_last, most = last, max(most, h)
            continue
        if open_first is not None:
            yield open_first, open_last, most
        open_first, open_last, most = a, last, h
    if open_first is not None:
        yield open_first, open_last, most


def scan_texts(scan: Scan, texts: list[str]) -> list[dict]:
    """What `license_scan` returns of each text, but its id."""
    hashes, starts = hash_words(texts, classes=CLASSES)
    ids = _known(scan, hashes)
    rows = [
        {"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base": set(), "blocks": []}
        for n in np.diff(starts).tolist()
    ]
    for (label, _), at in zip(scan.phrases, find_phrases(scan, ids, starts)):
        text = np.searchsorted(starts, at, side="right") - 1
        for t, w in zip(text.tolist(), (at - starts[text]).tolist()):
            row = rows[t]
            row["n_base"] += 1
            row["first_word"] = w if row["first_word"] is None else min(w, row["first_word"])
            row["last_word"] = w if row["last_word"] is None else max(w, row["last_word"])
            row["base"].add(label)
    for k, (label, n, order) in enumerate(scan.templates):
        first, held = find_blocks(scan, k, ids, starts)
        text = np.searchsorted(starts, first, side="right") - 1
        for a, b, most in _merged(first, held, n, starts[text + 1]):
            t = int(np.searchsorted(starts, a, side="right")) - 1
            at = int(starts[t])
            rows[t]["blocks"].append(
                {"label": label, "template": k, "first": a - at, "last": b - at, "containment": most / len(order)}
            )
    for row in rows:
        base = row.pop("base")
        row["base_labels"] = ",".join(sorted(base))
        row["labels"] = ",".join(sorted(base | {b["label"] for b in row["blocks"]}))
        row["score"] = 1.0 if base else max((b["containment"] for b in row["blocks"]), default=0.0)
    return rows


def word_counts(docs: DataFrame, scan: Scan) -> dict[int, int]:
    """How often each word of the scan stands in all texts; as many numbers as it has words reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(scan.words) + 1, np.int64)
        for batch in batches:
            total += np.bincount(_known(scan, hash_words(batch["text"].tolist(), classes=CLASSES)[0]), minlength=len(total))
        yield pd.DataFrame({"word": np.arange(len(scan.words)), "n": total[:-1]})

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "word long, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): places of the phrases, and every block that holds enough of a template.

    Phrases and templates are (label, words). A block is as many consecutive words as a template has; it is
    found when it holds at least `threshold` of the template's distinct words, whatever their order. Words
    are ordered by their count in the whole corpus, and only blocks around one of a template's rarest words
    are looked at, which loses none. `blocks` has each run of overlapping found blocks (words from `first`
    to `last`) with the best containment; `labels` those of places and blocks, sorted and joined by commas.
    `score` is 1 where a phrase stands, else the best containment, else 0.

    The corpus is read twice, without an exchange of texts. Null texts count as empty: no words, empty labels,
    score 0. Null ids and repeated rows are rows of their own. Very long texts are scanned whole. Other
    columns are ignored; no rows give no rows. `first_word` and `last_word` are null where there is no place.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and at most at 1")
    plain = build_scan(phrases, templates, threshold)
    scan = build_scan(phrases, templates, threshold, word_counts(docs, plain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame(scan_texts(scan, batch["text"].tolist()), index=batch.index, columns=FOUND)
            found["doc_id"] = batch["doc_id"].astype("Int64")
            for name in ("first_word", "last_word"):
                found[name] = found[name].astype("Int64")
            yield found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, ROW)
