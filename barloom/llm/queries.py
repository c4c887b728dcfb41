"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.checks import collocation_sql, license_sql
from barloom.llm.common import table, workers_import

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@query("op7_minimum_bin_slack")
def packed(spark, sf_dir):
    from barloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op10_hypergeometric_shards")
def sharded(spark, sf_dir):
    from pyspark.sql import functions as F

    from barloom.llm.common import whole_text
    from barloom.llm.sharding import shard

    rows = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_training_order")
def training_order(spark, sf_dir):
    from barloom.llm.token_output import write_token_shards

    return write_token_shards(table(spark, sf_dir, "documents")).index


@query("op8_link_graph")
def judged_urls(spark, sf_dir):
    from barloom.llm.url_filter import judge_urls

    rules = [
        ("allow", "com/"),
        ("block", "example.com/en/"),
        ("allow", "www.example.com/en/"),
        ("block", "net/es/"),
        ("block", "net/fr/"),
    ]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op6_multiset_hash")
def fingerprinted(spark, sf_dir):
    from pyspark.sql import functions as F

    from barloom.llm import fingerprints as fp
    from barloom.llm.neighbours import edited
    from barloom.session import materialize

    rows = edited(table(spark, sf_dir, "documents")).select(
        "row", "next_row", "next_doc_id", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("text").alias("t")), F.struct(F.lit("b").alias("kind"), F.col("edited").alias("t")))).alias("v"),
    )
    about = ["row", "next_row", "next_doc_id", "doc_id", "n_chars", "edited_sha256", "kind"]
    both = materialize(fp.fingerprint_rows(rows.select(*about[:-1], "v.kind", "v.t"), about, "t"), "fingerprints")
    own, changed = both.where("kind = 'a'").drop("kind"), both.where("kind = 'b'").drop("kind", *about[1:-1])
    sums = [c for c in both.columns if c not in about]
    a = own.withColumnsRenamed({c: f"a_{c}" for c in sums})
    b = changed.withColumnsRenamed({c: f"b_{c}" for c in sums})
    c = own.select(F.col("row").alias("next_row"), *[F.col(x).alias(f"c_{x}") for x in sums])
    return a.join(b, "row").join(c, "next_row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fp.as_text("a_").alias("fingerprint"),
        fp.as_text("b_").alias("edited_fingerprint"),
        fp.likeness("a_", "b_").alias("near_edited"),
        fp.likeness("a_", "c_").alias("near_next"),
        "next_doc_id",
    )


@query("op2_empirical_bayes_quality")
def quality(spark, sf_dir):
    from barloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_weak_supervision")
def toxicity(spark, sf_dir):
    from barloom.llm.common import fold
    from barloom.llm.toxicity import toxicity_scores

    scores = toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold("doc_id", 4) != 2
    )
    return scores.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "posterior")


@query("op9_order_min_hash")
def near_duplicate_classes(spark, sf_dir):
    from barloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "class_row")


@query("op1_cgk_lsh")
def contaminated(spark, sf_dir):
    from barloom.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_backoff_automaton")
def lm_scored(spark, sf_dir):
    from barloom.llm.common import fold
    from barloom.llm.language_model import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


@query("op13_license_scan", license_sql())
def licensed(spark, sf_dir):
    from barloom.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


@query("op11_token_alignment")
def tokens_aligned(spark, sf_dir):
    from barloom.llm.token_alignment import alignment_digests

    digests = alignment_digests(table(spark, sf_dir, "documents"))
    return digests.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_phrase_index", collocation_sql())
def phrases_mined(spark, sf_dir):
    from barloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
