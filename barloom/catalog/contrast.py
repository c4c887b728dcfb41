"""Queries over ranking and the comparison of two prediction sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived, labelled_windows, predictions
from barloom.catalog.oracle import r, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import rounded
from barloom.operators import compare as c
from barloom.operators import ranking as k

TOP = 50


def side(both, model, name="y_score"):
    return both.select("sample_id", "ts_code", "asof_date", "y_true", F.col(f"score_{model}").alias(name))


def paired(spark, sf):
    """Both sets aligned; set b names its score differently and has no symbol or date."""
    both = predictions(spark, sf)
    a = both.select("sample_id", "ts_code", "asof_date", "y_true", F.col("score_a").alias("y_score"))
    b = both.select("sample_id", "y_true", F.col("score_b").alias("score"))
    return c.align_predictions(a, b)


def scan_side(spark, sf, model):
    return side(predictions(spark, sf), model, "score").drop("y_true")


def scan_sides(spark, sf):
    both = predictions(spark, sf)
    return [side(both, m, "score").drop("y_true") for m in ("a", "b")]


@query("sort_by_score", sql("select sample_id, score_a as score from preds order by score_a desc, sample_id"))
def sorted_scores(spark, sf):
    return k.sort_by_score(scan_side(spark, sf, "a")).select("sample_id", "score")


@query(
    "rank_by_score",
    sql("select sample_id, score_a as score, row_number() over (order by score_a desc, sample_id) as rank from preds"),
)
def ranked(spark, sf):
    return k.rank_by_score(scan_side(spark, sf, "a")).select("sample_id", "score", "rank")


@query(
    "rank_by_score_per_date",
    sql(
        """select sample_id, asof_date, row_number() over (partition by asof_date order by score_a desc, sample_id) as rank from preds"""
    ),
)
def ranked_by_date(spark, sf):
    return k.rank_by_score(scan_side(spark, sf, "a"), group=("asof_date",)).select("sample_id", "asof_date", "rank")


@query(
    "model_intersection",
    sql(
        f"""select sample_id, ts_code, asof_date, score_a as score_lgbm, rank_a as rank_lgbm, score_b as score_xgb, rank_b as rank_xgb,
        {r('(score_a + score_b) / 2', 'score_mean')}, least(score_a, score_b) as score_min, rank_a + rank_b as rank_sum
        from (select *, row_number() over (order by score_a desc, sample_id) as rank_a,
                     row_number() over (order by score_b desc, sample_id) as rank_b from preds) x
        order by (score_a + score_b) / 2 desc, least(score_a, score_b) desc, rank_a + rank_b, sample_id limit 200"""
    ),
)
def intersection(spark, sf):
    return rounded(k.intersect_models(dict(zip(["lgbm", "xgb"], scan_sides(spark, sf))), 200))


@query("top_scores", sql("select sample_id, score_a as score from preds order by score_a desc, sample_id limit 20"))
def top(spark, sf):
    return k.top_scores(scan_side(spark, sf, "a"), 20).select("sample_id", "score")


@query("bottom_scores", sql("select sample_id, score_a as score from preds order by score_a, sample_id limit 20"))
def bottom(spark, sf):
    return k.bottom_scores(scan_side(spark, sf, "a"), 20).select("sample_id", "score")


@query("latest_asof", sql("select max(asof_date) as latest_asof_date from preds"))
def newest(spark, sf):
    return k.latest_asof(scan_side(spark, sf, "a"))


@query(
    "align_predictions",
    sql("select sample_id, ts_code, asof_date, score_a, score_b, y_true::double as y_true_a from preds"),
)
def aligned(spark, sf):
    return paired(spark, sf).select("sample_id", "ts_code", "asof_date", "score_a", "score_b", "y_true_a")


@query(
    "align_by_symbol_and_date",
    sql(
        """select ts_code, asof_date, score_a, score_b, concat(ts_code, '|', cast(asof_date as string)) as join_key from preds"""
    ),
)
def aligned_by_pair(spark, sf):
    a, b = (df.drop("sample_id") for df in scan_sides(spark, sf))
    return c.align_predictions(a, b).select("ts_code", "asof_date", "score_a", "score_b", c.KEY)


@query(
    "alignment_info",
    sql(
        """select count(*) as rows_a, count_if(y_true = 1)::bigint as rows_b, count_if(y_true = 1)::bigint as rows_aligned from preds"""
    ),
)
def info(spark, sf):
    both = predictions(spark, sf)
    a, b = side(both, "a"), side(both, "b").where("y_true = 1")
    return c.alignment_info(a, b, c.align_predictions(a, b))


@query("pearson", sql(f"select {r('corr(score_a, score_b)', 'pearson')} from preds"))
def pearson(spark, sf):
    return rounded(c.pearson(paired(spark, sf)))


AVERAGE_RANKS = """
select rank() over (order by score_a) + (count(*) over (partition by score_a) - 1) / 2.0e0 as ra,
       rank() over (order by score_b) + (count(*) over (partition by score_b) - 1) / 2.0e0 as rb from {source}
"""


@query(
    "spearman",
    sql(f"select {r('corr(ra, rb)', 'spearman')} from ranks", ranks=AVERAGE_RANKS.format(source="preds")),
)
def spearman(spark, sf):
    return rounded(c.spearman(paired(spark, sf)))


@query(
    "spearman_with_ties",
    sql(
        f"select {r('corr(ra, rb)', 'spearman')} from ranks",
        coarse="select round(score_a, 1) as score_a, round(score_b, 1) as score_b from preds",
        ranks=AVERAGE_RANKS.format(source="coarse"),
    ),
)
def spearman_ties(spark, sf):
    rows = paired(spark, sf)
    return rounded(c.spearman(rows.withColumns({s: F.round(s, 1) for s in ("score_a", "score_b")})))


@query("top_n_of_a", sql(f"select sample_id, score_a from preds order by score_a desc, sample_id limit {TOP}"))
def top_a(spark, sf):
    return c.top_n_of(paired(spark, sf), "a", TOP).select("sample_id", "score_a")


@query(
    "top_n_overlap",
    sql(f"select sample_id, score_a, score_b, {r('(score_a + score_b) / 2', 'avg_score')} from top_flags where in_a and in_b"),
)
def overlap(spark, sf):
    return rounded(c.top_n_overlap(paired(spark, sf), TOP).select("sample_id", "score_a", "score_b", "avg_score"))


@query(
    "overlap_counts",
    sql(
        f"""select 50 as top_n, count_if(in_a and in_b)::bigint as overlap_count, {r('count_if(in_a and in_b) / 50.0e0', 'overlap_ratio')},
        count_if(in_a and not in_b)::bigint as a_only_count, count_if(in_b and not in_a)::bigint as b_only_count from top_flags"""
    ),
)
def overlap_numbers(spark, sf):
    return rounded(c.overlap_counts(paired(spark, sf), TOP))


@query("only_in_top_a", sql("select sample_id, score_a, score_b from top_flags where in_a and not in_b"))
def only_a(spark, sf):
    return c.only_in_top(paired(spark, sf), "a", TOP).select("sample_id", "score_a", "score_b")


@query("only_in_top_b", sql("select sample_id, score_a, score_b from top_flags where in_b and not in_a"))
def only_b(spark, sf):
    return c.only_in_top(paired(spark, sf), "b", TOP).select("sample_id", "score_a", "score_b")


# scores have six digits; rounding their difference again makes ties of equal differences
DELTA = "select *, round(score_a - score_b, 6) as delta from preds"


@query(
    "disagreement",
    sql(
        f"""(select sample_id, {r('delta', 'delta')}, 'a_more_bullish' as side from deltas order by score_a - score_b desc, sample_id limit {TOP})
        union all (select sample_id, {r('delta', 'delta')}, 'b_more_bullish' as side from deltas order by score_a - score_b, sample_id limit {TOP})""",
        deltas=DELTA,
    ),
)
def disagreement(spark, sf):
    return rounded(c.disagreement(paired(spark, sf), TOP).select("sample_id", "delta", "side"))


@query(
    "label_mismatches",
    sql("select count_if(y_true != (rn % 2))::bigint as label_mismatch_count from (select w.label as y_true, w.rn from windows w where rn >= 120) x"),
)
def mismatches(spark, sf):
    """Set b claims the parity of the row number as its truth."""
    rows = labelled_windows(spark, sf)
    a = rows.select("sample_id", F.col("label").alias("y_true"), F.col("confidence").alias("y_score"))
    b = rows.select("sample_id", (F.col("rn") % 2).alias("y_true"), F.col("confidence").alias("y_score"))
    return c.label_mismatches(c.align_predictions(a, b))


def _errors(model: str, truth: int, guess: str, order: str) -> str:
    return f"""select sample_id, score_{model} from preds where y_true = {truth} and score_{model} {guess} 0.5
    order by score_{model} {order}, sample_id limit {TOP}"""


for _model in ("a", "b"):
    query(f"false_positives_{_model}", sql(_errors(_model, 0, ">=", "desc")))(
        lambda spark, sf, m=_model: c.worst_errors(paired(spark, sf), m, "false_positive", TOP).select("sample_id", f"score_{m}")
    )
    query(f"false_negatives_{_model}", sql(_errors(_model, 1, "<", "asc")))(
        lambda spark, sf, m=_model: c.worst_errors(paired(spark, sf), m, "false_negative", TOP).select("sample_id", f"score_{m}")
    )


@query(
    "misclassified",
    sql(
        """select sample_id, case when ea and eb then 'both' when ea then 'only_a' else 'only_b' end as wrong
        from (select sample_id, (score_a >= 0.5) != (y_true = 1) as ea, (score_b >= 0.5) != (y_true = 1) as eb from preds) x where ea or eb"""
    ),
)
def misclassified(spark, sf):
    return c.misclassified(paired(spark, sf)).select("sample_id", "wrong")


RATES = """
select m.model, accuracy, f1, won / pairs as auc from
 (select model, (tp + tn)::double / n as accuracy, 2.0e0 * tp / nullif(2 * tp + fp + fn, 0) as f1 from (
   select model, count(*) as n, count_if(y_true = 1 and y_score >= 0.5) as tp, count_if(y_true = 0 and y_score >= 0.5) as fp,
          count_if(y_true = 1 and y_score < 0.5) as fn, count_if(y_true = 0 and y_score < 0.5) as tn from long_preds group by model) c) m
join (select p.model, sum(case when p.y_score > q.y_score then 1.0e0 when p.y_score = q.y_score then 0.5e0 else 0 end) as won, count(*) as pairs
      from (select * from long_preds where y_true = 1) p join (select * from long_preds where y_true = 0) q on p.model = q.model
      group by p.model) x on m.model = x.model
"""


@query("model_metrics", sql(f"select model, {r('accuracy', 'accuracy')}, {r('f1', 'f1')}, {r('auc', 'auc')} from rates", rates=RATES))
def model_metrics(spark, sf):
    return rounded(c.model_metrics(paired(spark, sf)).select("model", "accuracy", "f1", "auc"))


@query(
    "metric_winner",
    sql(
        " union all ".join(
            f"""select '{n}' as metric, case when a.{n} > b.{n} then 'a' when b.{n} > a.{n} then 'b' else 'tie' end as winner
            from rates a join rates b on a.model = 'a' and b.model = 'b'"""
            for n in ("accuracy", "f1", "auc")
        ),
        rates=RATES,
    ),
)
def winner(spark, sf):
    return c.metric_winner(c.model_metrics(paired(spark, sf)))


@query(
    "label_wise_scores",
    sql(
        f"""select model, {r('pos', 'positive_mean_score')}, {r('neg', 'negative_mean_score')}, {r('pos - neg', 'pos_neg_gap')}
        from (select model, avg(case when y_true = 1 then y_score end) as pos, avg(case when y_true = 0 then y_score end) as neg
              from long_preds group by model) x"""
    ),
)
def label_wise(spark, sf):
    return rounded(c.label_wise_scores(paired(spark, sf)))


BUCKET_TESTS = {
    "topN_a": "in_a",
    "topN_b": "in_b",
    "overlap_topN": "in_a and in_b",
    "a_only_topN": "in_a and not in_b",
    "b_only_topN": "in_b and not in_a",
}


@query(
    "future_return_buckets",
    sql(
        " union all ".join(
            f"""select '{n}' as bucket, count(*) as count, {r('avg(future_return)', 'mean')}, {r('median(future_return)', 'median')},
            {r('stddev_pop(future_return)', 'std')} from top_flags where {t}"""
            for n, t in BUCKET_TESTS.items()
        )
    ),
)
def buckets(spark, sf):
    future = derived(spark, sf, "bar_labels").select("sample_id", "future_return")
    return rounded(c.future_return_buckets(paired(spark, sf), future, TOP))


@query(
    "future_return_buckets_by_pair",
    sql(
        " union all ".join(
            f"""select '{n}' as bucket, count(*) as count, {r('avg(future_return)', 'mean')}, {r('median(future_return)', 'median')},
            {r('stddev_pop(future_return)', 'std')} from top_flags where {t}"""
            for n, t in BUCKET_TESTS.items()
        )
    ),
)
def buckets_by_pair(spark, sf):
    """The sets share symbol and date only, while the returns carry a sample id too."""
    both = predictions(spark, sf)
    a, b = (both.select("ts_code", "asof_date", "y_true", F.col(f"score_{m}").alias("y_score")) for m in ("a", "b"))
    future = derived(spark, sf, "bar_labels").select("sample_id", "ts_code", "asof_date", "future_return")
    return rounded(c.future_return_buckets(c.align_predictions(a, b), future, TOP))
