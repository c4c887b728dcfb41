"""Phrases whose words stand together more than their parts do, from FM-indexes of shards."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import mix64, shuffle_width
from barloom.session import materialize

#: Bytes of text that one index holds, but for a longer single text.
SHARD = 8 << 20
#: Bytes of text to a bucket, in which the counts of all shards meet.
BUCKET = 2 << 20

_MARK = b","  # stands for every separator of pieces, so it is in no word


def _bytes_table() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] += 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _MARK[0]
    table[0x09] = 0x20
    return bytes(table)


_TABLE = _bytes_table()


class _Numbers(dict):
    """Word -> number, in order of first use; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Word ids from 1 with a 0 before, between and after pieces, and the words by id, in byte order."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_TABLE).replace(_MARK, b" , ").split()
    numbers = _Numbers({_MARK: 0})
    ids = np.fromiter(map(numbers.__getitem__, raw), np.int64, len(raw))
    del raw
    words = pa.array(list(numbers)[1:], pa.large_binary())
    order = pc.array_sort_indices(words).to_numpy()
    place = np.zeros(len(words) + 1, np.int64)
    place[order + 1] = np.arange(1, len(words) + 1)
    ids = np.r_[0, place[ids], 0]
    return ids[np.r_[True, (ids[1:] != 0) | (ids[:-1] != 0)]], words.take(pa.array(order))


@dataclass(frozen=True)
class Index:
    """An FM-index whose suffixes are sorted by their first `depth` symbols: the last column, and where each
    symbol's suffixes begin. Intervals of patterns of up to `depth` symbols are whole."""

    last: np.ndarray
    first: np.ndarray

    def occurrences(self) -> np.ndarray:
        """Sorted keys of (symbol, place), by which `step` finds how often a symbol comes before a place."""
        return np.sort(self.last * (len(self.last) + 1) + np.arange(len(self.last)))

    def step(self, keys: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the interval of a symbol before a pattern begins, from where that of the pattern does."""
        return np.searchsorted(keys, symbol * (len(self.last) + 1) + at)


def build_index(ids: np.ndarray, depth: int) -> Index:
    """`ids` is read as a ring, so the symbol before the first is the last."""
    symbols = int(ids.max(initial=0)) + 1
    if symbols**depth < 1 << 62:
        key = np.zeros(len(ids), np.int64)
        for k in range(depth):
            key = key * symbols + np.roll(ids, -k)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort([np.roll(ids, -k) for k in reversed(range(depth))])
    return Index(np.roll(ids, 1)[order], np.r_[0, np.cumsum(np.bincount(ids, minlength=symbols))])


@dataclass(frozen=True)
class Phrases:
    """Word ids of each phrase (a row each), its count, and where its interval begins in the index of the text
    (`ahead`) and of the reversed text (`back`)."""

    words: np.ndarray
    count: np.ndarray
    ahead: np.ndarray
    back: np.ndarray


def extended(found: Phrases, ahead: Index, back: Index, left: bool, again: bool) -> Phrases:
    """All phrases with one more word, to the left or to the right, in the same piece.

    The symbols in a phrase's interval are those before it, or after it in the index of the reversed text;
    each makes an interval of its own by a step in that index, and in the other by how many smaller symbols
    the old interval holds. `again` says whether the phrases will be extended once more.
    """
    index, begin, other = (ahead, found.ahead, found.back) if left else (back, found.back, found.ahead)
    n = found.count
    place = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    symbols = len(index.first)
    key, count = np.unique(np.repeat(np.arange(len(n)) * symbols, n) + index.last[place], return_counts=True)
    of, symbol = key // symbols, key % symbols
    smaller = np.cumsum(count) - count
    smaller -= smaller[np.searchsorted(of, of)]
    kept = symbol > 0
    of, symbol, count, smaller = of[kept], symbol[kept], count[kept], smaller[kept]
    words = found.words[of]
    words = np.column_stack([symbol, words] if left else [words, symbol])
    across = other[of] + smaller
    stepped = index.step(index.occurrences(), symbol, begin[of]) if again else across
    return Phrases(words, count, *((stepped, across) if left else (across, stepped)))


def phrases_of(ids: np.ndarray, longest: int) -> list[Phrases]:
    """All phrases of 1 to `longest` words, by length, each with its count in the pieces of `ids`."""
    depth = max(1, longest - 1)
    ahead, back = build_index(ids, depth), build_index(ids[::-1], depth)
    count = np.diff(ahead.first)[1:]
    words = np.arange(1, len(count) + 1)
    found = [Phrases(words[:, None], count, ahead.first[1:-1], back.first[1:-1])]
    for k in range(2, longest + 1):
        found.append(extended(found[-1], ahead, back, left=k % 2 == 0, again=k < longest))
    return found


def _counted(lang: str, texts: list[str], longest: int, buckets: int) -> Iterator[dict]:
    """A row per bucket: its phrases, each ended by a line feed, and their counts."""
    ids, words = numbered(texts)
    if not len(words):
        return
    ended = pc.binary_join_element_wise(words, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    hashed = pd.util.hash_array(np.array([w.decode("utf-8", "surrogatepass") for w in words.to_pylist()], dtype=object))
    blank = pa.scalar(b" ", pa.large_binary())
    texts_of, counts, keys = [], [], []
    for found in phrases_of(ids, longest):
        places = found.words - 1
        parts = [(ended if k == places.shape[1] - 1 else words).take(pa.array(places[:, k])) for k in range(places.shape[1])]
        texts_of.append(pc.binary_join_element_wise(*parts, blank) if len(parts) > 1 else parts[0])
        counts.append(found.count)
        key = np.zeros(len(places), np.uint64)
        for k in range(places.shape[1]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashed[places[:, k]])
        keys.append(key % np.uint64(buckets))
    bucket = np.concatenate(keys).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    phrases = pa.concat_arrays(texts_of).take(pa.array(order))
    count = np.concatenate(counts)[order].astype("<i8")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    _, offsets, data = phrases.buffers()
    at = np.frombuffer(offsets, np.int64)[phrases.offset : phrases.offset + len(phrases) + 1]
    for b in np.flatnonzero(np.diff(edges)).tolist():
        low, high = int(edges[b]), int(edges[b + 1])
        first, end = int(at[low]), int(at[high])
        yield {
            "lang": lang,
            "bucket": b,
            "size": end - first,
            "n": high - low,
            "phrases": pa.compress(data.slice(first, end - first), "zstd", asbytes=True),
            "counts": pa.compress(pa.py_buffer(count[low:high].tobytes()), "zstd", asbytes=True),
        }


_PART = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("size", pa.int64()), ("n", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])


def _sharded(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                rows = list(_counted(lang, held.pop(lang), longest, buckets))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=_PART)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return run


def _merged(least: int):
    """Phrases of one bucket and language that all shards together hold often enough, and, as an empty phrase,
    how many words the bucket counts."""

    def run(parts: pa.Table) -> pa.Table:
        lang = parts.column("lang")[0].as_py()
        data = b"".join(pa.decompress(p, n, "zstd", asbytes=True) for p, n in zip(parts.column("phrases").to_pylist(), parts.column("size").to_pylist()))
        counts = [np.frombuffer(pa.decompress(c, 8 * n, "zstd", asbytes=True), "<i8") for c, n in zip(parts.column("counts").to_pylist(), parts.column("n").to_pylist())]
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        phrases = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])
        summed = pa.table({"phrase": phrases, "count": np.concatenate(counts)}).group_by("phrase").aggregate([("count", "sum")])
        total = summed.column("count_sum")
        often = summed.filter(pc.greater_equal(total, least))
        found, n = [x[:-1].decode() for x in often.column("phrase").to_pylist()], often.column("count_sum").to_pylist()
        single = pc.equal(pc.find_substring(summed.column("phrase"), b" "), -1)
        found.append("")
        n.append(pc.sum(total.filter(single)).as_py() or 0)
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(found, pa.string()), "f": pa.array(n, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, f): phrases of up to `longest` words that `docs` (lang, text) holds at least `least` times.

    Rows with an empty phrase add up to the number of words of their language. Every shard counts its
    phrases by its own FM-index; counts of all shards meet by the hash of the phrase, so a phrase is as many
    rows as shards hold it, however frequent it is. The result is written.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-size // BUCKET))
    parts = rows.mapInArrow(_sharded(longest, buckets), "lang string, bucket int, size long, n long, phrases binary, counts binary")
    return materialize(parts.groupBy("lang", "bucket").applyInArrow(_merged(least), "lang string, phrase string, f long"), "phrases")


def collocations(docs: DataFrame, most: int = 2000, longest: int = 3, least: int = 10, inside: int = 50) -> DataFrame:
    """The `most` best phrases of 2 to `longest` words of each language of `docs` (lang, text).

    A phrase that occurs a times, cut into parts that occur l and r times, scores floor(10^6 a a / (l r)); its
    lowest cut counts, the earliest of equal ones. Phrases of fewer than `least` occurrences are no candidates,
    and those that stand inside a longer one with at least `inside` percent of their occurrences are left out.
    Returns lang, rank (from 1; by score, a, then the phrase's bytes), phrase, a, l, r, n (words of the
    language) and score. Scores are whole decimals of 38 digits.

    Null texts count as empty, null languages as `und`. Repeated rows count each. Very long texts are
    indexed whole. Other columns are ignored; no rows, or no phrase often enough, give no rows.
    """
    counts = phrase_counts(docs, longest, least)
    words = counts.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    many = known.where(F.size("words") > 1)

    def run(first, n) -> F.Column:
        return F.array_join(F.slice("words", first, n), " ")

    size = F.size("words")
    cut = many.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, size - F.col("k")).alias("right")
    )
    parts = known.select("lang", "phrase", "f")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]
    )
    exact = cut.withColumn("score", F.expr("cast(1000000 * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    scored = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")

    pieces = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), size - 1),
                lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.array_join(F.slice("words", at, m), " ")),
            )
        )
    )
    longer = many.where(size > 2).select("lang", pieces.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    # the best of each of so many parts first, so that no task gets the best of all tasks
    part = F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(shuffle_width(docs.sparkSession)) + 1))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    within = Window.partitionBy("lang", "part").orderBy(*order)
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
