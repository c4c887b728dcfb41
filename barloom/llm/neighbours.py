"""The next document in an order over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordering import positions
from barloom.session import materialize


def edited(docs: DataFrame) -> DataFrame:
    """(row, next_row, next_doc_id, doc_id, text, edited) for every row of a stored table of documents (doc_id, text).

    The last floor(n/2) code points of a text give way to as many, or all, of the next document's: the next
    smaller doc_id, null ids last, equal ids by text; after the last comes the first. Places are found on ids
    alone, in range partitions. Texts are exchanged once, by row; what is sent on to another row is the part
    of a text that it needs, no more than half of its own length. Null texts are empty. `row` numbers the
    rows of the table as it is read, so `docs` must be a scan, which reads the same rows each time.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    narrow = rows.select(
        "row",
        (-F.col("doc_id").cast("decimal(20,0)")).alias("_order"),
        F.xxhash64("text").alias("_tie"),
        F.floor(F.char_length("text") / 2).cast("int").alias("half"),
    )
    placed = positions(narrow, [F.col("_order").asc_nulls_last(), F.col("_tie"), F.col("row")])
    placed = materialize(placed.select("row", "half", "pos", F.col("group_rows").alias("rows")), "places")
    after = placed.select(F.col("row").alias("owner"), "half", ((F.col("pos") + 1) % F.col("rows")).alias("pos"))
    wants = materialize(after.join(placed.select("pos", "row"), "pos").select("owner", "half", "row"), "wants")
    parts = rows.join(wants, "row").select(
        F.col("owner").alias("row"),
        F.col("row").alias("next_row"),
        # with it both joins read the same columns, so that one exchange of the texts serves both
        F.col("doc_id").alias("next_doc_id"),
        F.expr("substring(text, 1, half)").alias("_part"),
    )
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    return rows.join(parts, "row").select("row", "next_row", "next_doc_id", "doc_id", "text", F.concat(kept, "_part").alias("edited"))
