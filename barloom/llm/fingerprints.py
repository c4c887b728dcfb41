"""Homomorphic multiset fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lanes of the equality part, each a sum modulo 2^32, and words of the likeness part, each of three 20-bit fields.
LANES, WORDS, HASHES = 8, 40, 2
FIELDS = 3
MASK = (1 << 40) | (1 << 20) | 1
PER_HASH = WORDS // HASHES
LANE_NAMES = [f"lane{i}" for i in range(LANES)]
WORD_NAMES = [f"word{i}" for i in range(WORDS)]
UNIT_BREAKS = r"(?<=[.!?|])\s+"


def paragraphs(text: Column) -> Column:
    """The lines of a text; an empty or null text has one empty paragraph."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fingerprint_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per `keys` with its sums `lane*`, `word*` and `units`, from the paragraphs of `text`.

    A paragraph's wide vector has two parts. The equality part is its SHA-256 as eight lanes modulo 2^32. The
    likeness part has 120 fields, in longs of three fields of 20 bits: every sentence of the paragraph sets
    the fields that its hash bits name. A document's fingerprint is the lane-wise sum over its paragraphs, so
    it does not depend on their order, and a paragraph is inserted or deleted by adding or subtracting its
    vector. Fields hold a million sentences before they carry; a carry blurs the likeness, never the equality.

    A null text is one empty paragraph, as an empty one is. Keys must name a text; equal keys are summed.
    """
    split = texts.select(*keys, F.explode(paragraphs(F.col(text))).alias("_paragraph"))
    return (
        paragraph_vectors(split, keys, "_paragraph")
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in [*LANE_NAMES, *WORD_NAMES, "units"]])
    )


def paragraph_vectors(split: DataFrame, keys: list[str], paragraph: str) -> DataFrame:
    """One row per sentence; the paragraph's lanes stand on its first one, so its vector is the sum of its rows."""
    digest = F.sha2(F.col(paragraph), 256)
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANE_NAMES)]
    units = split.select(*keys, *lanes, F.posexplode(F.split(paragraph, UNIT_BREAKS, -1)).alias("_at", "_unit")).select(
        *keys,
        *[F.when(F.col("_at") == 0, F.col(c)).otherwise(0).alias(c) for c in LANE_NAMES],
        *[F.xxhash64(F.lit(h), F.trim("_unit")).alias(f"_h{h}") for h in range(HASHES)],
    )
    return units.select(
        *keys,
        *LANE_NAMES,
        *[
            F.shiftrightunsigned(F.col(f"_h{i // PER_HASH}"), i % PER_HASH).bitwiseAND(F.lit(MASK)).alias(c)
            for i, c in enumerate(WORD_NAMES)
        ],
        F.lit(1).cast("long").alias("units"),
    )


def as_text(prefix: str = "") -> Column:
    """The fingerprint as hexadecimal text: equal for equal multisets of paragraphs."""
    lanes = [F.lpad(F.lower(F.hex(F.pmod(F.col(f"{prefix}lane{i}"), F.lit(1 << 32)))), 8, "0") for i in range(LANES)]
    words = [F.lpad(F.lower(F.hex(F.col(f"{prefix}word{i}"))), 16, "0") for i in range(WORDS)]
    return F.concat(*lanes, *words, F.lpad(F.lower(F.hex(F.col(f"{prefix}units"))), 8, "0"))


def likeness(a: str, b: str) -> Column:
    """0 to 1: the cosine of two fingerprints' signed fields, at least 0; 1 where the fingerprints are equal.

    Each sentence adds +1 or -1 to every field with equal chance, so a field minus half the sentences is a
    signed sum, and the cosine estimates the shared share of sentences with a deviation of 1/sqrt(120).
    """

    def fields(prefix: str) -> list[Column]:
        low = F.lit((1 << 20) - 1)
        return [
            (2 * F.shiftright(F.col(f"{prefix}word{i}"), 20 * f).bitwiseAND(low) - F.col(f"{prefix}units")).cast("double")
            for i in range(WORDS)
            for f in range(FIELDS)
        ]

    left, right = F.array(*fields(a)), F.array(*fields(b))
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(left) * norm(right)
    cosine = F.when(size > 0, dot / size).otherwise(0.0)
    whole = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in [*LANE_NAMES, *WORD_NAMES, "units"]])
    return F.when(whole(a) == whole(b), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))
