"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix64
from barloom.session import materialize

#: Coordinates per key; ratio of the item sizes of a class; most repetitions before a class takes fewer coordinates.
COORDINATES, CLASS_RATIO, MOST_REPETITIONS = 4, 1.25, 96
FAR = 1 << 29
#: Flags for pairs of neighbouring words, by hash; two pairs on one flag only let more windows through.
PAIR_SLOTS = 1 << 24


def plain(word: str) -> str:
    """Lower-cased letters and digits of a word."""
    word = word.lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def item_words(text: str | None) -> list[str]:
    return [w for w in map(plain, (text or "").split()) if w]


class WordIds(dict):
    """Raw word -> number of its plain form in the benchmark, 0 for others, -1 for none; bounded."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 400_000) -> None:
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = plain(raw)
        found = self[raw] = self.vocabulary.get(word, 0) if word else -1
        return found


@dataclass
class SizeClass:
    """Items of similar size: what a window must hold, which coordinates are read, and the keys."""

    span: int  # words of the longest window
    known: int  # least benchmark words in a window
    paired: int  # least pairs of neighbours that an item has too
    coordinates: np.ndarray  # repetitions x up to COORDINATES steps of the walk
    keys: list[tuple[np.ndarray, np.ndarray]]  # per repetition, sorted keys and the items beside them
    repetitions: int  # 0: no keys, every window within the bounds is compared with each item
    own: list[int]  # the items


class Index:
    """The index of a block of items; `allowed` edits are floor((1 - similarity) * words)."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, target: float, seed: int = 7) -> None:
        self.seed, self.similarity = seed, similarity
        words = [item_words(text) for _, text in items]
        held = [k for k, w in enumerate(words) if w]
        self.ids = [items[k][0] for k in held]
        words = [words[k] for k in held]
        spread = Counter(w for ws in words for w in set(ws))
        self.vocabulary = {w: k for k, w in enumerate(sorted(spread), start=1)}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in words]
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        for x in self.items:
            self.pairs[self._pair_slots(x)] = True
        self.allowed = [int((1 - similarity) * len(x) + 1e-9) for x in self.items]
        self.classes: list[SizeClass] = []
        rng = np.random.default_rng(seed)
        low = 1
        while any(len(x) >= low for x in self.items):
            high = max(low + 1, int(low * CLASS_RATIO))
            own = [k for k, x in enumerate(self.items) if low <= len(x) < high]
            if own:
                self.classes.append(self._build(own, low, rng, target))
            low = high

    @staticmethod
    def _pair_slots(words: np.ndarray) -> np.ndarray:
        left, right = words[:-1].astype(np.uint64), words[1:].astype(np.uint64)
        return ((left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 24)).astype(np.int64)

    def _bits(self, step: int, repetition: int) -> np.ndarray:
        """The walk's coin for every word at a step: advance in the window or stay. A byte each: every task keeps all of them."""
        start = (self.seed << 40) + (repetition << 20) + step
        words = np.arange(len(self.vocabulary) + 1, dtype=np.uint64)
        return (mix64(words * np.uint64(0x9E3779B97F4A7C15) ^ mix64(np.array([start], np.uint64))[0]) >> np.uint64(63)).astype(np.int8)

    def _walk(self, stream: np.ndarray, starts: np.ndarray, coordinates: np.ndarray, repetition: int) -> np.ndarray:
        """Keys of the windows at `starts`: the embedding's values at the sampled coordinates.

        CGK: at every step the walk writes the word it stands on and moves on or stays by the word's coin, so
        two windows that differ by an edit fall into step again. Only up to the last coordinate is walked.
        """
        key = np.full(len(starts), repetition + 1, np.uint64)
        at = starts.astype(np.int64)
        wanted = set(coordinates.tolist())
        for step in range(int(coordinates.max()) + 1):
            word = stream[at]
            if step in wanted:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
            at = at + self._bits_of(step, repetition)[word]
        return key

    def _bits_of(self, step: int, repetition: int) -> np.ndarray:
        table = self.__dict__.setdefault("_coins", {})
        if (step, repetition) not in table:
            table[step, repetition] = self._bits(step, repetition)
        return table[step, repetition]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_coins"}

    def _build(self, own: list[int], low: int, rng: np.random.Generator, target: float) -> SizeClass:
        allowed = [self.allowed[k] for k in own]
        steps = max(1, 2 * low - 2)
        pad = 2 * max(len(self.items[k]) for k in own) + 4
        # planted windows at the limit of allowed edits tell how many repetitions reach the target recall
        planted = [self._edited(self.items[k], self.allowed[k], rng) for k in own for _ in range(-(-200 // len(own)))]
        truth = np.repeat(np.arange(len(own)), -(-200 // len(own)))
        stream, starts = _lay([self.items[k] for k in own], pad)
        windows, at = _lay(planted, pad)
        # a window is followed by more text, not by what follows an item
        after = rng.integers(1, len(self.vocabulary) + 1, len(windows), dtype=np.int32)
        inside = np.concatenate([np.arange(s, s + len(x)) for s, x in zip(at, planted)])
        after[inside] = windows[inside]
        for taken in range(COORDINATES, -1, -1):
            coordinates = np.sort(rng.integers(0, steps, (MOST_REPETITIONS, taken)), axis=1)
            keys, found = [], np.zeros(len(planted), bool)
            for r, c in enumerate(coordinates if taken else []):
                keys.append(self._walk(stream, starts, c, r))
                found |= self._walk(after, at, c, r) == keys[r][truth]
                if found.mean() >= target:
                    break
            if found.mean() >= target or not taken:
                break
        repetitions = len(keys)
        tables = []
        for r in range(repetitions):
            order = np.argsort(keys[r], kind="stable")
            tables.append((keys[r][order], np.array(own)[order]))
        return SizeClass(
            span=max(len(self.items[k]) + e for k, e in zip(own, allowed)),
            known=min(len(self.items[k]) - e for k, e in zip(own, allowed)),
            # an edit breaks two pairs of neighbours at most
            paired=min(len(self.items[k]) - 1 - 2 * e for k, e in zip(own, allowed)),
            coordinates=coordinates[:repetitions],
            keys=tables,
            repetitions=repetitions,
            own=own,
        )

    def _edited(self, item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
        out = item.tolist()
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(out)))
            if kind == 0:
                out[at] = 0
            elif kind == 1:
                out.insert(at, 0)
            elif len(out) > 1:
                del out[at]
        return np.array(out, np.int32)

    def candidates(self, stream: np.ndarray) -> set[tuple[int, int]]:
        """(start, item) of windows of `stream` (padded word numbers) that share a key with an item."""
        found: set[tuple[int, int]] = set()
        known = np.cumsum(np.r_[0, stream > 0])
        paired = np.r_[(stream[:-1] > 0) & (stream[1:] > 0), False] if len(stream) > 1 else np.zeros(len(stream), bool)
        paired[:-1] &= self.pairs[self._pair_slots(stream)]
        paired = np.cumsum(np.r_[0, paired])
        length = len(stream)
        for size in self.classes:
            starts = np.arange(length)
            ends = np.minimum(starts + size.span, length)
            # a window within the allowed edits holds at least so many words of its item
            starts = starts[(known[ends] - known[:-1] >= size.known) & (paired[ends] - paired[:-1] >= size.paired)]
            if not len(starts):
                continue
            if not size.repetitions:
                found.update((int(s), i) for s in starts for i in size.own)
                continue
            reach = np.r_[stream, np.zeros(int(size.coordinates.max()) + 2, stream.dtype)]
            for r, coordinates in enumerate(size.coordinates):
                keys, items = size.keys[r]
                got = self._walk(reach, starts, coordinates, r)
                low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                for k in np.flatnonzero(high > low):
                    found.update((int(starts[k]), int(i)) for i in items[low[k] : high[k]])
        return found

    def distances(self, stream: np.ndarray, pairs: list[tuple[int, int]], ends: list[int]) -> np.ndarray:
        """Edits from each item to the best window that begins at its start and ends before `ends`."""
        out = np.full(len(pairs), FAR, np.int64)
        by_width: dict[tuple[int, int], list[int]] = {}
        for k, (_, i) in enumerate(pairs):
            by_width.setdefault((self.allowed[i], len(self.items[i])), []).append(k)
        for (width, n), group in by_width.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                a = np.stack([self.items[pairs[k][1]] for k in part])
                b = np.full((len(part), n + 2 * width), -1, np.int64)
                for row, k in enumerate(part):
                    s = stream[pairs[k][0] : min(ends[k], pairs[k][0] + n + width)]
                    b[row, width : width + len(s)] = s
                out[part] = _free_end(a, b, width)
        return out


def _lay(items: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All items in one array with room after each, and where each starts."""
    longest = max(len(x) for x in items) + pad
    stream = np.zeros((len(items), longest), np.int32)
    for k, x in enumerate(items):
        stream[k, : len(x)] = x
    return stream.reshape(-1), np.arange(len(items)) * longest


def _free_end(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Edit distance of each row of `a` to the best prefix of the row of `b` (shifted by `width`), in a band."""
    cells = 2 * width + 1
    step = np.arange(cells)
    row = np.repeat(np.where(step >= width, step - width, FAR)[None, :], len(a), axis=0).astype(np.int64)
    for i in range(1, a.shape[1] + 1):
        end = min(i - 1 + cells, b.shape[1])
        seen = np.full((len(a), cells), -1, np.int64)
        seen[:, : end - i + 1] = b[:, i - 1 : end]
        new = row + (a[:, i - 1 : i] != seen)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if i <= width:
            new[:, : width - i] = FAR
            new[:, width - i] = i
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row.min(axis=1)


def _searched(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        ids = WordIds(index.vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 5000):
                yield _search_batch(index, ids, batch.iloc[at : at + 5000])

    return run


def _search_batch(index: Index, ids: WordIds, batch: pd.DataFrame) -> pd.DataFrame:
    parts, bounds = [], [0]
    for text in batch["text"].tolist():
        words = (text or "").split()
        numbers = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        parts.append(numbers[numbers >= 0])
        bounds.append(bounds[-1] + len(parts[-1]))
    stream, edges = np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(bounds)
    pairs = sorted(index.candidates(stream)) if len(stream) else []
    doc = np.searchsorted(edges, [s for s, _ in pairs], side="right") - 1
    distance = index.distances(stream, pairs, edges[doc + 1].tolist()) if pairs else []
    keys = batch["doc_id"].tolist()
    rows = [
        (keys[d], index.ids[i], s - int(edges[d]), len(index.items[i]), int(e))
        for (s, i), d, e in zip(pairs, doc, distance)
        if e <= index.allowed[i]
    ]
    out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "item_words", "edits"])
    return out.astype({"doc_id": "Int64", "item_id": "Int64"})


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    target_recall: float = 0.95,
    block_items: int = 2_000,
) -> DataFrame:
    """Benchmark items (item_id, text) that stand in documents (doc_id, text): one row per pair.

    Windows begin at every word of every document and have the size of an item. Where a window holds enough
    of the benchmark's words and word pairs to be within the allowed edits of an item (a bound that loses
    none), its CGK embedding is walked and sampled at a few
    coordinates per repetition; equal samples make a candidate. Repetitions are as many as planted edits at
    the limit need for `target_recall`; where many do not reach it, keys take fewer coordinates, and at last
    all windows within the bounds are candidates. Every candidate is verified by its exact edit distance in words.

    Items are taken in blocks of `block_items`, each broadcast in turn, so what a task holds is bounded.
    Returns doc_id, item_id, start (words before it, of the best window), item_words, edits and similarity.

    Words are compared without case and punctuation. Items and texts that are null or have no words match
    nothing. Repeated items or documents give rows for each id. Items under five words must match exactly.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    items = materialize(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
        .where("item_id is not null")
        .withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-benchmark.count() // block_items))))),
        "items",
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, start long, item_words int, edits int"
    found = None
    for block in sorted(r["_block"] for r in items.select("_block").distinct().collect()):
        held = sorted((r["item_id"], r["text"] or "") for r in items.where(F.col("_block") == block).collect())
        shared = spark.sparkContext.broadcast(Index(held, similarity, target_recall))
        part = rows.mapInPandas(_searched(shared), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = F.min(F.struct("edits", "start", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        "best.start",
        "best.item_words",
        "best.edits",
        (1 - F.col("best.edits") / F.col("best.item_words")).alias("similarity"),
    )
