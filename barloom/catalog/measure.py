"""Queries over metrics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived, labelled_windows, model_predictions, predictions
from barloom.catalog.ingest import TIME_SPLIT_SQL
from barloom.catalog.oracle import r, r_all, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import rounded
from barloom.operators import metrics as m
from barloom.operators import profile as p
from barloom.operators.dataset import build_samples
from barloom.operators.models import fill_features, scaler_statistics
from barloom.operators.splits import time_split
from barloom.schema import FEATURES


def both_models(spark, sf):
    return predictions(spark, sf).select(
        "sample_id",
        "y_true",
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("model"), F.col(f"score_{k}").alias("y_score")) for k in ("a", "b")]
            )
        ),
    )


CONFUSION = """
select model, count(*) as n, count_if(y_true = 1 and y_score >= 0.5)::bigint as tp, count_if(y_true = 0 and y_score >= 0.5)::bigint as fp,
       count_if(y_true = 1 and y_score < 0.5)::bigint as fn, count_if(y_true = 0 and y_score < 0.5)::bigint as tn
from long_preds group by model
"""
RATES = {
    "accuracy": "(tp + tn)::double / n",
    "precision": "coalesce(tp::double / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp::double / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0)",
}


@query(
    "confusion_metrics",
    sql("select model, n, tp, fp, fn, tn, " + ", ".join(r(e, n) for n, e in RATES.items()) + " from confusion",
        confusion=CONFUSION),
)
def confusion(spark, sf):
    return rounded(m.confusion_metrics(both_models(spark, sf), group=["model"]))


# equal scores share the mean of their places
PAIRS = """
select model, {auc} from (
  select model, sum(case when y_true = 1 then place end) - sum(y_true) * (sum(y_true) + 1) / 2.0e0 as won,
         sum(y_true) * sum(1 - y_true)::double as pairs
  from (
    select model, y_true, rank() over (partition by model order by y_score)
             + (count(*) over (partition by model, y_score) - 1) / 2.0e0 as place
    from long_preds) p
  group by model) x
"""


@query("roc_auc", sql(PAIRS.format(auc=r("won / pairs", "auc"))))
def auc(spark, sf):
    return rounded(m.roc_auc(both_models(spark, sf), group=["model"]))


COARSE = "select sample_id, model, y_true, round(y_score, 1) as y_score from long_preds"


@query("roc_auc_with_ties", sql(PAIRS.replace("long_preds", "coarse").format(auc=r("won / pairs", "auc")), coarse=COARSE))
def auc_ties(spark, sf):
    rows = both_models(spark, sf).withColumn("y_score", F.round("y_score", 1))
    return rounded(m.roc_auc(rows, group=["model"]))


SUMMARY = {
    "mean": "avg(y_score)",
    "std": "stddev_pop(y_score)",
    "min": "min(y_score)",
    "max": "max(y_score)",
    **{n: f"quantile_cont(y_score, {q})" for n, q in m.SCORE_QUANTILES.items()},
}


@query(
    "score_summary",
    sql("select model, " + ", ".join(r(e, n) for n, e in SUMMARY.items()) + " from long_preds group by model"),
)
def summary(spark, sf):
    return rounded(m.score_summary(both_models(spark, sf), group=["model"]))


@query(
    "label_score_means",
    sql(
        f"""select model, {r('pos', 'positive_mean_score')}, {r('neg', 'negative_mean_score')}, {r('pos - neg', 'pos_neg_gap')}
        from (select model, avg(case when y_true = 1 then y_score end) as pos, avg(case when y_true = 0 then y_score end) as neg
              from long_preds group by model) x"""
    ),
)
def score_means(spark, sf):
    return rounded(m.label_score_means(both_models(spark, sf), group=["model"]))


for _kind, _truth, _guess, _order in (("false_positive", 0, ">=", "desc"), ("false_negative", 1, "<", "asc")):
    query(
        f"top_{_kind}s",
        sql(
            f"""select sample_id, y_true::double as y_true, score_a as y_score, {1 - _truth} as y_pred from preds
            where y_true = {_truth} and score_a {_guess} 0.5 order by score_a {_order}, sample_id limit 15"""
        ),
    )(
        lambda spark, sf, kind=_kind: m.error_rows(model_predictions(spark, sf, "a"), kind, 15).select(
            "sample_id", "y_true", "y_score", "y_pred"
        )
    )


DATASET = "select w.*, s.split from windows w join splits s on w.asof_date = s.asof_date where w.rn >= 120"
# features with gaps: the windows that are too short have none, and one in seven lacks a value
GAPPY = """
select sample_id, label, {features} from (select l.*, f.* exclude (ts_code) from bar_labels l
  asof left join index_features f on l.ts_code = f.ts_code and l.asof_date >= f.trade_date) w
""".format(features=", ".join(f"case when rn >= 120 and rn % 7 != {i % 7} then {c} end as {c}" for i, c in enumerate(FEATURES)))


def gappy(spark, sf):
    built = build_samples(derived(spark, sf, "bar_labels"), derived(spark, sf, "index_bars"), 120, 120)
    known = F.col("skip_reason").isNull()
    cut = {c: F.when(known & (F.col("rn") % 7 != i % 7), F.col(c)) for i, c in enumerate(FEATURES)}
    return built.withColumns(cut).select("sample_id", "label", *FEATURES)


@query(
    "shape_check",
    sql(
        """select count(*) as meta_rows, count_if(rn >= 120)::bigint as feature_rows, true as feature_ids_unique,
        count(*) = count_if(rn >= 120) as ids_aligned, count(*) = count_if(rn >= 120) as is_consistent from
        (select l.sample_id, f.rn from bar_labels l asof left join index_features f on l.ts_code = f.ts_code and l.asof_date >= f.trade_date) x"""
    ),
)
def shape(spark, sf):
    return p.shape_check(derived(spark, sf, "bar_labels"), labelled_windows(spark, sf))


@query(
    "label_profile",
    sql(
        f"""select count(*) as n, count_if(label = 1)::bigint as positive_count, count_if(label = 0)::bigint as negative_count,
        {r('count_if(label = 1)::double / count(*)', 'positive_ratio')} from bad_labels"""
    ),
)
def labels(spark, sf):
    return rounded(p.label_profile(derived(spark, sf, "bad_labels")))


@query(
    "split_label_counts",
    sql(
        """select coalesce(s.split, '<NA>') as split, l.label, count(*) as n from bad_labels l
        left join splits s on l.asof_date = s.asof_date group by 1, 2""",
        splits=TIME_SPLIT_SQL,
    ),
)
def split_labels(spark, sf):


    dates = time_split(derived(spark, sf, "bar_labels")).select("asof_date", "split").distinct()
    return p.split_label_counts(derived(spark, sf, "bad_labels").join(dates, "asof_date", "left"))


def _per_feature(template: str, source: str) -> str:
    return " union all ".join("select '{c}' as feature, ".format(c=c) + template.replace("{c}", c) + f" from {source}" for c in FEATURES)


MISSING = _per_feature("count_if({c} is null)::bigint as missing_count, count_if({c} is null)::double / count(*) as ratio", "gappy")


@query("missingness", sql(f"select feature, missing_count, {r('ratio', 'missing_ratio')} from missing", gappy=GAPPY, missing=MISSING))
def missing(spark, sf):
    return rounded(p.missingness(gappy(spark, sf)))


@query(
    "top_missing",
    sql(f"select feature, missing_count, {r('ratio', 'missing_ratio')} from missing order by ratio desc, feature limit 5",
        gappy=GAPPY, missing=MISSING),
)
def top_missing(spark, sf):
    return rounded(p.top_missing(gappy(spark, sf), 5))


@query(
    "global_missingness",
    sql(
        f"""select sum(missing_count)::bigint as missing_cells, (select count(*) * 11 from gappy)::bigint as cells,
        {r('sum(missing_count)::double / (select count(*) * 11 from gappy)', 'missing_ratio')} from missing""",
        gappy=GAPPY,
        missing=MISSING,
    ),
)
def missing_overall(spark, sf):
    return rounded(p.global_missingness(gappy(spark, sf)))


SPREAD = _per_feature("var_pop({c}) as v, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as kinds", "gappy")


@query(
    "feature_spread",
    sql(f"select feature, {r('v', 'variance')}, kinds <= 1 as is_constant from spread", gappy=GAPPY, spread=SPREAD),
)
def spread(spark, sf):
    return rounded(p.feature_spread(gappy(spark, sf)))


@query(
    "low_variance",
    sql(f"select feature, {r('v', 'variance')}, kinds <= 1 as is_constant from spread order by v, feature limit 4",
        gappy=GAPPY, spread=SPREAD),
)
def low_variance(spark, sf):
    return rounded(p.low_variance(gappy(spark, sf), 4))


NUMERIC = {
    "mean": "avg({c})",
    "std": "stddev_samp({c})",
    "min": "min({c})",
    "max": "max({c})",
    **{n: f"quantile_cont({{c}}, {q})" for n, q in p.QUARTILES.items()},
}


@query(
    "numeric_summary",
    sql(
        "select feature, " + r_all(list(NUMERIC)) + " from numeric_rows",
        gappy=GAPPY,
        numeric_rows=_per_feature(", ".join(f"{e} as {n}" for n, e in NUMERIC.items()), "gappy"),
    ),
)
def numeric(spark, sf):
    return rounded(p.numeric_summary(gappy(spark, sf)))


@query(
    "dataset_snapshot",
    sql(
        "select count(*) as n_samples, "
        + ", ".join(f"count_if(split = '{s}')::bigint as n_{s}" for s in ("train", "valid", "test"))
        + f", {r('avg(label)', 'positive_ratio_all')}, "
        + ", ".join(r(f"avg(case when split = '{s}' then label end)", f"positive_ratio_{s}") for s in ("train", "valid", "test"))
        + """, min(asof_date) as date_min, max(asof_date) as date_max, count(distinct ts_code) as n_unique_ts_code,
        'derived' as label_source from dataset""",
        splits=TIME_SPLIT_SQL,
        dataset=DATASET,
    ),
)
def snapshot(spark, sf):
    return rounded(p.dataset_snapshot(labelled_windows(spark, sf)))


@query(
    "scaler_statistics",
    sql(
        f"select feature, {r('mean', 'mean')}, {r('scale', 'scale')} from stats",
        splits=TIME_SPLIT_SQL,
        train=f"select * from ({DATASET}) d where split = 'train'",
        stats=_per_feature("avg({c}) as mean, stddev_pop({c}) as scale", "train"),
    ),
)
def scaler(spark, sf):
    train = labelled_windows(spark, sf).where(F.col("split") == "train")
    return rounded(scaler_statistics(fill_features(train)))
