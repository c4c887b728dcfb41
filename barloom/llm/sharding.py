"""Uniform distributed shuffle into shards of exact size."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that add up to `rows` and differ by one at most."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def communication_matrix(sent: list[int], received: list[int], seed: int) -> np.ndarray:
    """Rows that partition i sends to shard j under a uniform random permutation of all rows.

    Partition by partition, a multivariate hypergeometric draw without replacement from what the shards
    still lack; row sums are `sent`, column sums `received`, exactly.
    """
    rng = np.random.default_rng([seed, 0])
    lack = np.array(received, dtype=np.int64)
    matrix = np.zeros((len(sent), len(received)), dtype=np.int64)
    for i, n in enumerate(sent):
        matrix[i] = _draw(rng, lack, n)
        lack -= matrix[i]
    return matrix


def _draw(rng: np.random.Generator, lack: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(lack)
    rest = int(lack.sum())
    for j, have in enumerate(lack):
        if not n:
            break
        take = _hypergeometric(rng, int(have), rest - int(have), n)
        out[j] = take
        n -= take
        rest -= int(have)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy draws up to 10^9 rows; a larger population is split in halves, which are drawn in turn."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    half = (good + bad) // 2
    # the marked rows of a random half, then the drawn rows of that half
    marked = _normal_hypergeometric(rng, good, bad, half)
    first = _normal_hypergeometric(rng, half, good + bad - half, n)
    return _hypergeometric(rng, marked, half - marked, first) + _hypergeometric(
        rng, good - marked, good + bad - half - (good - marked), n - first
    )


def _normal_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """At 10^9 rows and more the normal limit stands for the law; kept inside its support."""
    total = good + bad
    p = good / total
    spread = (n * p * (1 - p) * (total - n) / max(1, total - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, spread)), max(0, n - bad)), min(good, n)))


def shard(rows: DataFrame, shards: int = 24, seed: int = 42, rows_per_block: int = 2048) -> DataFrame:
    """Put all rows into `shards` in uniformly random order; adds `shard` and `slot` (gapless from 0).

    1. The rows are written once with their partition and place in it, which fixes what is permuted.
    2. A hypergeometric communication matrix (partitions x shards, on the driver) gives exact counts.
    3. Each partition is permuted locally and dealt out by its row of the matrix.
    4. Every row draws a random key. The key's high part names a block of its shard, about `rows_per_block`
       rows; the exchange goes by block, so that no task gets a whole shard, and each block is permuted
       again by sorting its keys. Blocks follow one another in the shard, by their counts.

    Copies, ties and nulls in any column are rows like others; no rows give no rows; there are empty shards
    if rows are fewer. Columns named `shard` or `slot` (any case) of the input are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    fixed = materialize(
        rows.select(*[F.col(f"`{c}`") for c in kept])
        .withColumn("__shard_in", F.spark_partition_id())
        .withColumn("__shard_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "rows",
    )
    sent = sorted((r["__shard_in"], r["n"]) for r in fixed.groupBy("__shard_in").agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([n for _, n in sent], shard_sizes(sum(n for _, n in sent), shards), seed)
    row_of = {part: i for i, (part, _) in enumerate(sent)}
    ends = matrix.cumsum(axis=1)

    @F.pandas_udf("int")
    def deal(parts: pd.Series, places: pd.Series) -> pd.Series:
        parts, places = parts.to_numpy(), places.to_numpy(np.int64)
        out = np.zeros(len(parts), np.int32)
        for p in np.unique(parts):
            i, at = row_of[int(p)], parts == p
            out[at] = np.searchsorted(ends[i], _order(seed, int(p), sent[i][1])[places[at]], side="right")
        return pd.Series(out)

    blocks = max(1, -(-sum(n for _, n in sent) // (shards * rows_per_block)))
    key = F.xxhash64(F.lit(seed), F.lit("again"), "__shard_in", "__shard_place")
    dealt = (
        fixed.withColumn("shard", deal("__shard_in", "__shard_place"))
        .withColumn("__shard_key", key)
        .withColumn("__shard_block", F.pmod(F.shiftright("__shard_key", 24), F.lit(blocks)))
    )
    earlier = Window.partitionBy("shard").orderBy("__shard_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        dealt.groupBy("shard", "__shard_block")
        .agg(F.count("*").alias("_n"))
        .select("shard", "__shard_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("__shard_before")),
        "blocks",
    )
    again = Window.partitionBy("shard", "__shard_block").orderBy("__shard_key", "__shard_in", "__shard_place")
    return (
        dealt.join(starts, ["shard", "__shard_block"])
        .withColumn("slot", F.col("__shard_before") + F.row_number().over(again) - 1)
        .select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")
    )


@lru_cache(maxsize=8)
def _order(seed: int, part: int, rows: int) -> np.ndarray:
    """The local permutation of a partition, the same in every task that meets its rows."""
    return np.random.default_rng([seed, 1, part]).permutation(rows)
