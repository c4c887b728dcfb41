"""Small stored tables and plain computations that the tests of the corpus operators share."""

import random

WORDS = [a + b + c for a in ("an", "er", "th", "is", "po", "qui") for b in ("on", "re", "la", "ti", "mo") for c in ("ds", "ng", "xe", "lo")]


def prose(seed, n):
    draw = random.Random(seed)
    words = [draw.choice(WORDS) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def changed(text, share, seed):
    """A copy with a share of its words replaced."""
    draw, words = random.Random(seed), text.split(" ")
    for i in draw.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def stored(spark, folder, rows, schema, name="documents"):
    path = f"{folder}/{name}.parquet"
    spark.createDataFrame(rows, schema).repartition(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Columns that clash with names used inside; every operator must leave them alone or carry them.
EXTRA = "row long, pos long, block long, key string, score double, hits int, _row long, shard string, posterior double"
EXTRA_VALUES = (7, 7, 7, "k", 0.5, 1, 7, "s", 0.1)

EDGES = [
    (1, prose(1, 60), "en", "a"),
    (1, prose(1, 60), "en", "a"),
    (2, prose(1, 60), "en", None),
    (3, None, None, "a"),
    (4, "", "en", "a"),
    (5, "", "en", "b"),
    (None, prose(2, 30), "en", "a"),
    (None, None, None, None),
    (6, "one", "en", "b"),
    (7, prose(3, 30_000), "en", "b"),
    (8, "x" * 50_000, "en", "b"),
    (9, "é\U0001f600 \t\n \x0b", "fr", "a"),
]
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"


def edge_table(spark, folder):
    return stored(spark, folder, [(*r, *EXTRA_VALUES) for r in EDGES], SCHEMA)


def no_rows(spark, folder):
    return stored(spark, folder, [], SCHEMA, "none")
