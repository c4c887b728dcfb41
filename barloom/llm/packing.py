"""Packing of documents into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordering import positions
from barloom.llm.common import crc_u32
from barloom.llm.token_ids import END_ID, VOCABULARY, document_ids
from barloom.session import materialize

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fill windows from a multiset of lengths; returns (members as (length, count), repeats) in order.

    Each window takes the longest piece left and then the subset of the others that comes closest to the
    capacity. Subset sums are bits of one integer: adding a length shifts it, a count is split into powers
    of two, and the bits before each length let the counts be traced back. A filling is repeated as often
    as its members last, so the work depends on the distinct lengths (below `capacity`), not on the rows.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        seed = max(left)
        room = capacity - seed
        mask = (1 << (room + 1)) - 1
        sums, trail = 1, []
        for length in sorted((x for x in left if x <= room), reverse=True):
            spare = min(left[length] - (length == seed), room // length)
            if spare <= 0:
                continue
            trail.append((length, sums))
            step = 1
            while spare > 0:
                take = min(step, spare)
                sums |= (sums << (take * length)) & mask
                spare -= take
                step *= 2
            if sums >> room & 1:
                break
        rest, members = sums.bit_length() - 1, {seed: 1}
        for length, before in reversed(trail):
            while not before >> rest & 1:
                rest -= length
                members[length] = members.get(length, 0) + 1
        repeats = min(left[length] // n for length, n in members.items())
        for length, n in members.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
        plan.append((sorted(members.items(), reverse=True), repeats))
    return plan


def _pieces(window: int, vocabulary: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = document_ids(text, vocabulary, end_id)
                whole, data = len(ids), ids.tobytes()
                for at in range(0, whole, window):
                    size = min(window, whole - at)
                    rows.append((key, at, size, crc_u32(data[4 * at : 4 * (at + size)]), whole))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _places(plan: list, window: int) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, pieces per window, first window, offset in the window)."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for members, repeats in plan:
        offset = 0
        for length, n in members:
            found.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * repeats
            offset += n * length
        first += repeats
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def pack(
    docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY, end_id: int = END_ID, text: str = "text"
) -> DataFrame:
    """Pack the token ids of `docs` (doc_id, text) into windows: one row per piece.

    A document is cut only where it is longer than a window: full windows stand alone, and the rests are
    packed by `minimum_bin_slack`. Only the histogram of rests (at most `window` rows) goes to the driver;
    pieces get their place by rank within their length, from range partitions on (length, doc_id, start).

    Null or empty texts are one end id. Repeated rows are packed each on its own. A null doc_id is kept.
    Equal lengths go by doc_id, start and checksum. Other columns are not read. No rows give no pieces.
    """
    # one row per piece, no ids: small, and read three times below
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
            _pieces(window, vocabulary, end_id), PIECE
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(minimum_bin_slack(counts, window), window)
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length").indices.items():
                table = places[int(length)]
                rank = batch["pos"].to_numpy(np.int64)[rows] - before[int(length)]
                at = np.searchsorted(table[:, 0], rank, side="right") - 1
                inside = rank - table[at, 0]
                sequence[rows] = table[at, 2] + inside // table[at, 1]
                offset[rows] = table[at, 3] + inside % table[at, 1] * length
            yield batch.assign(sequence_id=sequence, offset=offset)[columns]

    ranked = positions(pieces, ["length", "doc_id", "start", "ids_crc32"]).drop("group_rows")
    return ranked.mapInPandas(place, f"{PIECE}, sequence_id long, offset long")
