"""Queries over splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived
from barloom.catalog.ingest import TIME_SPLIT_SQL
from barloom.catalog.oracle import sql
from barloom.catalog.registry import query
from barloom.operators.splits import assign_split, infer_split_method, train_tail_roles, training_roles

BY_TIME = sql("select l.sample_id, s.split from bar_labels l join splits s on l.asof_date = s.asof_date", splits=TIME_SPLIT_SQL)


@query("time_split", BY_TIME)
def by_time(spark, sf):
    return assign_split(derived(spark, sf, "bar_labels"), "time").select("sample_id", "split")


@query("time_split_by_alias", BY_TIME)
def by_time_alias(spark, sf):
    return assign_split(derived(spark, sf, "bar_labels"), "time_by_asof_date").select("sample_id", "split")


STRATIFIED = """
select sample_id, asof_date, label, case when place < n_train then 'train' when place < n_train + n_valid then 'valid' else 'test' end as split
from (select *, case when n < 3 then n - n_train else least(n - n_train - 1, greatest(1, round_even(n * 0.15e0, 0)::bigint)) end as n_valid
      from (select *, case when n < 3 then greatest(1, n - 1) else least(n - 2, greatest(1, round_even(n * 0.7e0, 0)::bigint)) end as n_train
            from (select sample_id, asof_date, label, count(*) over (partition by label) as n,
                         row_number() over (partition by label order by md5(concat('42:', sample_id)), sample_id) - 1 as place
                  from bar_labels) a) b) c
"""


@query("stratified_split", sql("select sample_id, split from stratified", stratified=STRATIFIED))
def stratified(spark, sf):
    return assign_split(derived(spark, sf, "bar_labels"), "stratified_random").select("sample_id", "split")


@query(
    "stratified_split_counts",
    sql("select label, split, count(*) as n from stratified group by label, split", stratified=STRATIFIED),
)
def stratified_counts(spark, sf):
    return assign_split(derived(spark, sf, "bar_labels"), "stratified").groupBy("label", "split").agg(
        F.count("*").alias("n")
    )


@query(
    "training_roles",
    sql(
        """select l.sample_id, case when s.split = 'test' then null else s.split end as role
        from bar_labels l join splits s on l.asof_date = s.asof_date""",
        splits=TIME_SPLIT_SQL,
    ),
)
def roles(spark, sf):
    return training_roles(assign_split(derived(spark, sf, "bar_labels"), "time")).select("sample_id", "role")


@query(
    "train_tail_roles",
    sql(
        """select sample_id, case when place > n - greatest(1, round_even(n * 0.2e0, 0)::bigint) then 'valid' else 'train' end as role
        from (select sample_id, count(*) over () as n, row_number() over (order by asof_date, sample_id) as place from bar_labels) x"""
    ),
)
def tail_roles(spark, sf):
    return train_tail_roles(derived(spark, sf, "bar_labels").withColumn("split", F.lit("train"))).select(
        "sample_id", "role"
    )


@query(
    "infer_split_method",
    sql(
        """select max(case when split = 'train' then asof_date end) as train_max, min(case when split = 'valid' then asof_date end) as valid_min,
        max(case when split = 'valid' then asof_date end) as valid_max, min(case when split = 'test' then asof_date end) as test_min,
        'time_by_asof_date' as split_method from splits""",
        splits=TIME_SPLIT_SQL,
    ),
)
def inferred(spark, sf):
    return infer_split_method(assign_split(derived(spark, sf, "bar_labels"), "time"))


@query(
    "infer_split_method_mixed",
    sql(
        """select max(case when split = 'train' then asof_date end) as train_max, min(case when split = 'valid' then asof_date end) as valid_min,
        max(case when split = 'valid' then asof_date end) as valid_max, min(case when split = 'test' then asof_date end) as test_min,
        'unknown' as split_method from stratified""",
        stratified=STRATIFIED,
    ),
)
def inferred_mixed(spark, sf):
    return infer_split_method(assign_split(derived(spark, sf, "bar_labels"), "stratified"))
