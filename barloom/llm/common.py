"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import materialize

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package beside the driver's, where no PYTHONPATH or archive brings it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(name: str, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; a null id counts as empty text, so fold 0."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64
_CHUNK = 1 << 20


def byte_classes(separators: bytes, lower: bool = False) -> np.ndarray:
    """A table for `hash_words`: 0 for bytes between words, else the byte to hash. A space must be a separator."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255  # no UTF-8 byte is 255
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


_TABLES = {lower: byte_classes(b" \t\n\x0b\x0c\r", lower) for lower in (False, True)}


class _Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, _CHUNK + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])


_POWERS = _Powers()


def hash_words(texts: list[str], lower: bool = False, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text begins among them (and the total).

    Words lie between the six ASCII separators, or those of a table of `classes`; `lower` folds A-Z. A word's
    hash is a polynomial of its bytes, read off running sums over the whole batch, and mixed.
    """
    classes = _TABLES[lower] if classes is None else classes
    found, counts = [], []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at + 1, len(raw[at])
        while end < len(raw) and size + len(raw[end]) < _CHUNK:
            size += len(raw[end]) + 1
            end += 1
        data = classes[np.frombuffer(b" ".join(raw[at:end]) + b" ", np.uint8)]
        _POWERS.reach(len(data) + 1)
        word = data != 0
        edge = np.flatnonzero(np.diff(np.r_[False, word].astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.r_[np.uint64(0), np.cumsum(data.astype(np.uint64) * _POWERS.up[: len(data)])]
        found.append(mix64((sums[ends] - sums[starts]) * _POWERS.down[starts]))
        begins = np.cumsum([0] + [len(x) + 1 for x in raw[at:end]])
        counts.append(np.diff(np.searchsorted(starts, begins)))
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, np.cumsum(np.r_[0, np.concatenate(counts)]) if counts else np.zeros(1, np.int64)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number of each row in a column of a free name, and that name.

    The numbers are written, so they are the same however often and in whatever splits the rows are read.
    """
    name = "__row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def of_rows(rows: DataFrame, row: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a stored table whose number is in the column `row` of `ids`, or with `left_anti` the others.

    The numbers go to all tasks as a bit each, 64 to a row of a written table, at any size, so `rows` are not exchanged.
    """
    def bit(number: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))

    found = ids.where(F.col(row).isNotNull()).groupBy(F.shiftright(row, 6).alias("block"))
    blocks = materialize(found.agg(F.bit_or(bit(F.col(row))).alias("bits")), "row-bits")
    held = (F.shiftright(rows[row], 6) == blocks["block"]) & (blocks["bits"].bitwiseAND(bit(rows[row])) != 0)
    return rows.join(F.broadcast(blocks), held, how)


def crc_u32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, -(-rows // rows_per_block))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_limit(n: int, most: int) -> int:
    """Below which signed 64-bit hash lie about `most` of `n` rows; whole numbers, so right at any size."""
    return (most << 64) // max(n, most, 1) - (1 << 63)


def bounded_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About `most` rows, never many more, chosen by a 64-bit hash of `key`; all where there are no more than that."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.xxhash64(F.lit("sample"), *key) < F.lit(sample_limit(n, most)))
