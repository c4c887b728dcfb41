"""A smoothed n-gram model as a weighted backoff automaton, learned and applied in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import hash_words, mix64, shuffle_width
from barloom.session import materialize

#: Fixed hashes: the end of a text as a token, and the state before its first token.
END, START = np.uint64(0x9D5C0FB10F34A3C7), np.uint64(0x3C6EF372FE94F82B)
#: What the base model adds to each count.
BASE = 0.1
#: The followers of a word grow about as this power of its count.
GROWTH = 0.5


@dataclass
class Block:
    """The tokens of a block's texts, one after another, each text with its end; n-grams by their order."""

    tokens: np.ndarray  # hashes
    edges: np.ndarray  # where each text begins, and the total
    grams: dict[int, np.ndarray]  # distinct hashes, sorted
    at: dict[int, np.ndarray]  # which of them each token completes, -1 where the text is too short for one


def read_block(texts: list[str], order: int = 3) -> Block:
    """Words between the six ASCII separators, A-Z lower-cased, and an end after each text.

    A text's first token follows the start; an n-gram of order 3 or more begins at the start or later.
    """
    words, starts = hash_words(texts, lower=True)
    tokens = np.insert(words, starts[1:], END)
    edges = starts + np.arange(len(starts))
    place = np.arange(len(tokens)) - np.repeat(edges[:-1], np.diff(edges))
    word, last = mix64(tokens), tokens
    grams, at = {}, {}
    for n in range(1, order + 1):
        if n > 1:
            before = np.r_[START, last[:-1]] if len(last) else last
            if n == 2:
                before[edges[:-1]] = START
            last = mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)
        there = place >= n - 2
        at[n] = np.full(len(tokens), -1)
        grams[n], at[n][there] = np.unique(last[there], return_inverse=True)
    return Block(tokens, edges, grams, at)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, first all lowest bytes, then the next, so that small numbers compress well; their size first."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    planes = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _gaps(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _from_gaps(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.uint64)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins among sorted hashes, and the end: buckets are ranges of the hash."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)
    return np.r_[np.searchsorted(hashes, edges), len(hashes)]


def _counted(buckets: int, order: int):
    """Per block and bucket, the block's distinct n-grams and how often its training texts hold them."""

    def count(block: int, texts: list[str], held: list[bool]) -> Iterator[pd.DataFrame]:
        read = read_block(texts, order)
        trained = np.repeat(~np.array(held, bool), np.diff(read.edges))
        for n, grams in read.grams.items():
            at = read.at[n][trained & (read.at[n] >= 0)]
            seen, ends = np.bincount(at, minlength=len(grams)), _buckets(grams, buckets)
            rows = [
                (block, k, n, _gaps(grams[ends[k] : ends[k + 1]]), _planes(seen[ends[k] : ends[k + 1]]))
                for k in np.flatnonzero(np.diff(ends)).tolist()
            ]
            yield pd.DataFrame(rows, columns=["block", "bucket", "gram", "hashes", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_block, texts, held = None, [], []
        for batch in batches:
            # a block is a run of rows, which may go on in the next batch
            for block, rows in batch.groupby("block", sort=True):
                if open_block is not None and block != open_block:
                    yield from count(open_block, texts, held)
                    texts, held = [], []
                open_block = int(block)
                texts += rows["text"].tolist()
                held += rows["held_out"].tolist()
        if open_block is not None:
            yield from count(open_block, texts, held)

    return run


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of a bucket's n-grams, sent back to each block in the order it named them.

    Rows of block -1 carry the bucket's sums by size class of the count (its binary digits): occurrences,
    types, types seen once and twice.
    """
    grams = [_from_gaps(x) for x in frame["hashes"]]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(at.max() + 1, np.int64)
    np.add.at(total, at, np.concatenate([_numbers(x) for x in frame["n"]]).astype(np.int64))
    ends = np.cumsum([len(x) for x in grams])
    back = [_planes(total[part]) for part in np.split(at, ends[:-1])]
    out = frame[["block", "bucket", "gram"]].assign(n=back, digits=0, tokens=0, types=0, once=0, twice=0)
    seen = pd.Series(total[total > 0])
    sums = seen.groupby(np.frexp(seen)[1].to_numpy()).agg(["sum", "size"]).reset_index(names="digits")
    sums = sums.rename(columns={"sum": "tokens", "size": "types"}).assign(
        block=-1, bucket=int(frame["bucket"].iloc[0]), gram=int(frame["gram"].iloc[0]), n=b"", once=0, twice=0
    )
    sums.loc[sums["digits"] == 1, "once"] = int((total == 1).sum())
    sums.loc[sums["digits"] == 2, "twice"] = int((total == 2).sum())
    return pd.concat([out, sums[out.columns]], ignore_index=True)


def aside(c, prior: float):
    """What a state seen c times adds to its count for its failure arc: as the number of its followers grows with c."""
    return prior * c**GROWTH


def prior_of_failure(sizes: list[tuple[int, int]], novel: int) -> float:
    """The factor by which states of one length set mass aside for their failure arcs.

    Of all steps out of the states, the share so set aside is that of Good and Turing: n-grams one longer
    that training holds once. `sizes` are occurrences and number of the states by size class, whose states
    count as of their mean size.
    """
    low, high = -10.0, 20.0  # binary logarithms of the least and greatest factor
    for _ in range(60):
        middle = (low + high) / 2
        a = [aside(c / types, 2.0**middle) for c, types in sizes]
        lost = sum(c * x / (c / types + x) for (c, types), x in zip(sizes, a))
        low, high = (middle, high) if lost < novel else (low, middle)
    return 2.0**low


@dataclass(frozen=True)
class Model:
    """What the states share: sums over all training tokens, and the factor of the mass set aside by a state's length."""

    tokens: int
    types: int
    discount: float
    prior: dict[int, float]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + BASE) / (self.tokens + BASE * (self.types + 1)))

    def root(self, c: np.ndarray) -> np.ndarray:
        """Arcs of the root: discounted counts; the mass taken off is one class of unknown words."""
        if not self.tokens:
            return np.zeros(len(c))
        return np.log10(np.where(c > 0, np.maximum(c - self.discount, 1e-300), self.discount * self.types) / self.tokens)


def train_model(sums: list) -> Model:
    """From rows of order, digits, tokens, types, once and twice; nothing counted gives a model without states."""
    by_order: dict[int, list] = {}
    for r in sums:
        by_order.setdefault(r["gram"], []).append(r)
    total = {n: [sum(r[c] for r in rows) for c in ("tokens", "types", "once", "twice")] for n, rows in by_order.items()}
    tokens, types, once, twice = total.get(1, [0, 0, 0, 0])
    # Good and Turing's share of what is unseen, as one discount of every count
    discount = once / (once + 2 * twice) if once and twice else 0.5
    prior = {n: prior_of_failure([(r["tokens"], r["types"]) for r in rows], total.get(n + 1, [0, 0, 0])[2]) for n, rows in by_order.items()}
    return Model(tokens, types, discount, prior)


@dataclass
class Automaton:
    """The part of the automaton that a block's texts can reach.

    A state is the root, the start of a text, or an n-gram shorter than the model's order that training
    holds; its failure arc leads to the same n-gram without its first word, at last to the root. A state's
    arc for a word is the n-gram made of both, by its index among the block's.
    """

    seen: dict[int, np.ndarray]  # training count of every n-gram of the block
    arc: dict[int, np.ndarray]  # log10 weight of the arc that it is, where training holds it
    failure: dict[int, np.ndarray]  # log10 weight of the failure arc of the state that the arc leaves


def build_automaton(read: Block, seen: dict[int, np.ndarray], model: Model) -> Automaton:
    """Weights by c, the count of an n-gram, of state h and word w: a state's arcs and its failure arc share all mass.

    An arc weighs (c(hw) + a * weight of w from the next state on the failure path) / (c(h) + a) and the
    failure arc a / (c(h) + a), where `aside` gives a state its own a; so weights from a state sum to 1 where those from the shorter one do.
    """
    arc, failure = {1: model.root(seen[1].astype(np.float64))}, {}
    end = np.searchsorted(read.grams[1], END)
    texts = seen[1][end] if end < len(read.grams[1]) else 0  # as many starts as ends
    for n in range(2, len(read.grams) + 1):
        there = np.flatnonzero(read.at[n] >= 0)
        at, size = read.at[n][there], len(read.grams[n])
        state, shorter = np.zeros(size), np.zeros(size, np.int64)
        left = seen[n - 1][read.at[n - 1][there - 1]]
        state[at] = np.where(np.isin(there, read.edges[:-1]), texts, left) if n == 2 else left
        shorter[at] = read.at[n - 1][there]
        a = aside(state, model.prior.get(n - 1, 1.0))
        with np.errstate(divide="ignore", invalid="ignore"):  # a state that training lacks has neither
            arc[n] = np.log10((seen[n] + a * 10.0 ** arc[n - 1][shorter]) / (state + a))
            failure[n] = np.log10(a / (state + a))
    return Automaton(seen, arc, failure)


def traverse(read: Block, automaton: Automaton) -> np.ndarray:
    """log10 probability of every token, the texts read from left to right.

    The state carried to a token is the longest run of tokens before it that is a state: reading w in state
    h leads to hw, or to the first of its shorter ones that exists. As that hangs on the last few tokens
    alone, all tokens of the block step together: where its state has no arc for it, a token pays for
    the failure arc and is tried again in the state it leads to, at last in the root, which has an arc for all.
    """
    order = len(read.grams)
    cost = np.zeros(len(read.tokens))
    length = np.zeros(len(read.tokens), np.int64)  # of the state that each token is read in
    for n in range(2, order + 1):
        there = np.flatnonzero(read.at[n] >= 0)
        length[there[~np.isnan(automaton.failure[n][read.at[n][there]])]] = n - 1
    for n in range(order, 0, -1):
        here = np.flatnonzero(length == n - 1)
        at = read.at[n][here]
        if n == 1:
            cost[here] += automaton.arc[1][at]
            break
        has = automaton.seen[n][at] > 0
        cost[here] += np.where(has, automaton.arc[n][at], automaton.failure[n][at])
        length[here] = np.where(has, order, n - 2)  # read, or on to the shorter state
    return cost


def _scored(model: Model, order: int):
    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("row")
        read = read_block(docs["text"].tolist(), order)
        counts = counts.sort_values(["gram", "bucket"])
        seen = {n: np.zeros(0, np.uint64) for n in read.grams}
        seen |= {n: np.concatenate([_numbers(x) for x in part["n"]]) for n, part in counts.groupby("gram")}
        score = traverse(read, build_automaton(read, seen, model))
        of_token = seen[1][read.at[1]]
        starts = read.edges[:-1]
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].astype("Int64"),
                "held_out": docs["held_out"],
                "n_tokens": np.diff(read.edges),
                "n_known": np.add.reduceat((of_token > 0).astype(np.int64), starts),
                "train_tokens": model.tokens,
                "base_score": np.add.reduceat(model.base(of_token.astype(np.float64)), starts),
                "score": np.add.reduceat(score, starts),
            }
        )

    return run


def lm_scores(
    docs: DataFrame, held_out: Column, order: int = 3, block_bytes: int = 8 << 20, most_block_bytes: int = 64 << 20
) -> DataFrame:
    """log10 probability of every whole text of a stored table (doc_id, text) under an n-gram automaton.

    Learns from rows where `held_out` is false. The corpus is dealt into blocks, runs of rows of about
    `block_bytes` (more from about 70 GB on, so that there are not too many pairs of blocks and buckets, up to
    `most_block_bytes`, which takes some 2 GB of a task). A block names each of its distinct n-grams of up to
    `order` tokens once, by 64-bit hashes in buckets that are ranges of the hash; a bucket adds the counts up
    over the corpus, in 64 bits, and answers each block in the block's order. So no task holds more of the model than a block
    or a bucket needs, a frequent word is one entry per block, and no n-gram is cut off. A block then builds
    the part of the automaton that its texts can reach and reads them once.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score. Null
    texts are empty: one end token. Repeated rows are rows each and count each in training. Null ids are kept.
    Other columns are ignored; no rows give no rows; without training rows every score is 0 and base_score
    that of a single unknown class. `docs` must be a scan, whose rows are the same each time.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    block_bytes = min(max(block_bytes, int((size["bytes"] * 1024) ** 0.5)), max(block_bytes, most_block_bytes))
    per_block = max(1, int(block_bytes * size["rows"] / max(1, size["bytes"])))
    buckets = max(1, size["bytes"] // block_bytes, min(shuffle_width(spark), size["bytes"] >> 20))
    row = F.monotonically_increasing_id()
    rows = docs.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        held_out.alias("held_out"),
    ).withColumn("block", F.col("row") - F.pmod(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(per_block)))
    named = rows.select("block", "text", "held_out").mapInPandas(
        _counted(buckets, order), "block long, bucket int, gram int, hashes binary, n binary"
    )
    answers = materialize(
        named.groupBy("gram", "bucket").applyInPandas(
            _totals, "block long, bucket int, gram int, n binary, digits int, tokens long, types long, once long, twice long"
        ),
        "answers",
    )
    # at most 64 rows an order
    sums = answers.where("block = -1").groupBy("gram", "digits").agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice")])
    model = train_model(sums.collect())
    return (
        rows.groupBy("block")
        .cogroup(answers.where("block >= 0").select("block", "bucket", "gram", "n").groupBy("block"))
        .applyInPandas(
            _scored(model, order),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
