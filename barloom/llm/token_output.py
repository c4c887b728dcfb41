"""Token ids in training order, as binary shards of fixed-stride records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import crc_u32, mix64
from barloom.llm.token_ids import END_ID, VOCABULARY, document_ids
from barloom.session import materialize, scratch_path

ROUNDS = 6
INDEX = "sequence long, slot long, shard long, record long, n_ids int, ids_crc32 long"


def feistel(index: np.ndarray, domain: int, key: int) -> np.ndarray:
    """A keyed permutation of [0, domain): a balanced Feistel network, walked along its cycle into the domain."""
    half = max(1, -(-max(1, domain - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(domain)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass(frozen=True)
class TokenShards:
    """Where shards are, what a record holds, and the row of each sequence."""

    path: str
    index: DataFrame
    ids_per_record: int
    records_per_shard: int
    sequences: int


def _sequences(size: int, vocabulary: str, end_id: int):
    """Concatenate the documents of a partition and cut the ids after every `size`; the last one may be short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, place = np.zeros(0, np.uint16), 0
        for batch in batches:
            parts = [rest]
            for text in batch["text"].tolist():
                ids = document_ids(text, vocabulary, end_id)
                if ids.size and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids over 65535 do not fit two bytes")
                parts.append(ids.astype("<u2"))
            stream = np.concatenate(parts)
            whole = len(stream) // size
            if whole:
                rows = stream[: whole * size].reshape(whole, size)
                yield pd.DataFrame(
                    {"_at": np.arange(place, place + whole), "n_ids": size, "ids": [r.tobytes() for r in rows]}
                )
                place += whole
            rest = stream[whole * size :]
        if len(rest):
            yield pd.DataFrame({"_at": [place], "n_ids": [len(rest)], "ids": [rest.tobytes()]})

    return run


def write_token_shards(
    docs: DataFrame,
    path: str | None = None,
    ids_per_record: int = 2048,
    records_per_shard: int = 2048,
    key: int = 42,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    text: str = "text",
) -> TokenShards:
    """Write the ids of all documents in a keyed random training order.

    Each partition's documents follow one another, every document with its end id, and are cut into
    sequences of `ids_per_record - 1` ids; only the last of a partition is padded. Sequence i of N gets the
    slot feistel(i): shard slot // records_per_shard, record slot % records_per_shard. A record is
    `ids_per_record` little-endian 16-bit ids: the sequence, zeros as padding, and the end id as its last,
    so every record of a shard starts at a multiple of the stride and training can resume at any slot. Shard
    folders are `shard=K` with one file each. `index` has a row per sequence.

    Null or empty texts are one end id; repeated rows are written each; no rows write nothing. Other
    columns and the order of rows with equal ids do not matter. The order depends on the key and on how the
    input is split, which `index` records.
    """
    spark, size = docs.sparkSession, ids_per_record - 1
    path = path or scratch_path(spark, "shards")
    # the ids are needed twice, to count the sequences and to write them: kept by the executors, and made
    # again from the input where an executor is lost (a scan's partitions and their rows are fixed)
    cut = (
        docs.select(F.col(text).alias("text"))
        .mapInPandas(_sequences(size, vocabulary, end_id), "_at long, n_ids int, ids binary")
        .withColumn("_part", F.spark_partition_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    sizes = sorted((r["_part"], r["n"]) for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, first = 0, {}
    for part, n in sizes:
        first[part] = total
        total += n

    @F.pandas_udf("sequence long, slot long, ids_crc32 long")
    def place(part: pd.Series, at: pd.Series, ids: pd.Series) -> pd.DataFrame:
        sequence = part.map(first).to_numpy(np.int64) + at.to_numpy(np.int64)
        crc = [crc_u32(x) for x in ids]
        return pd.DataFrame({"sequence": sequence, "slot": feistel(sequence, total, key), "ids_crc32": crc})

    placed = cut.select(place("_part", "_at", "ids").alias("p"), "n_ids", "ids").select(
        "p.sequence",
        "p.slot",
        F.floor(F.col("p.slot") / records_per_shard).alias("shard"),
        (F.col("p.slot") % records_per_shard).alias("record"),
        "n_ids",
        "p.ids_crc32",
        "ids",
    )
    index = materialize(placed.drop("ids"), "index")
    # the text writer passes bytes through and ends each record with the separator, here the end id's two bytes
    record = F.rpad("ids", 2 * size, F.lit(b"\0"))
    (
        placed.select("shard", "record", record.cast("string").alias("value"))
        .repartitionByRange("shard")
        .sortWithinPartitions("shard", "record")
        .select("value", "shard")
        .write.partitionBy("shard")
        .option("lineSep", chr(end_id & 0xFF) + chr(end_id >> 8))
        .text(path)
    )
    cut.unpersist()
    return TokenShards(path, index, ids_per_record, records_per_shard, total)


def read_token_shards(spark: SparkSession, shards: TokenShards, first_slot: int = 0) -> DataFrame:
    """The records from `first_slot` on, as (slot, ids binary); whole shards before it are not opened."""
    stride, per_shard = 2 * shards.ids_per_record, shards.records_per_shard
    if not shards.sequences:
        return spark.createDataFrame([], "slot long, ids binary")
    files = spark.read.format("binaryFile").load(shards.path).where(
        F.col("shard") >= first_slot // per_shard
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                n = len(content) // stride
                out = pd.DataFrame({"slot": np.arange(n) + int(shard) * per_shard})
                out["ids"] = [content[i * stride : (i + 1) * stride] for i in range(n)]
                yield out[out["slot"] >= first_slot]

    return files.select("shard", "content").mapInPandas(cut, "slot long, ids binary")
