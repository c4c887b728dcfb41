"""Intermediate tables and who removes them."""

import os
import time

from pyspark.sql import functions as F

from barloom.session import SHUFFLE_CLEANUP, materialize, materialize_parts, release_scratch, scratch_root, shuffles_deleted


def test_scratch_is_released(spark):
    release_scratch(spark)
    before = set(os.listdir(scratch_root(spark)))
    tables = [materialize(spark.range(n), "kept") for n in (3, 4)]
    assert [t.count() for t in tables] == [3, 4]
    assert len(set(os.listdir(scratch_root(spark))) - before) == 2
    assert release_scratch(spark) == 2
    assert set(os.listdir(scratch_root(spark))) == before and release_scratch(spark) == 0


def shuffled_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def left_over(spark, before):
    """Files shuffled since then, once those on their way out are gone."""
    for _ in range(50):
        if not shuffled_files(spark) - before:
            return set()
        time.sleep(0.2)
    return shuffled_files(spark) - before


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffled_files(spark), spark.conf.get(SHUFFLE_CLEANUP, "false")
    dealt = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    stored = materialize(dealt, "dealt")
    assert not left_over(spark, before)
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == setting
    assert sum(r["count"] for r in stored.collect()) == 1000 and sum(r["count"] for r in dealt.collect()) == 1000


def test_the_setting_is_back_after_writers_that_overlap(spark):
    setting = spark.conf.get(SHUFFLE_CLEANUP, "false")
    first, second = shuffles_deleted(spark), shuffles_deleted(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == setting


def test_parts_are_one_table(spark):
    parts = [spark.range(k, k + 3).repartition(2, "id") for k in (0, 10, 20)]
    stored = materialize_parts(parts, "parts")
    assert sorted(r["id"] for r in stored.collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
