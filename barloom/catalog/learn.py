"""Queries over scaling, model training, scoring and scanning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.catalog.inputs import derived, labelled_windows
from barloom.catalog.ingest import TIME_SPLIT_SQL
from barloom.catalog.measure import DATASET, _per_feature
from barloom.catalog.oracle import r, r_all, sql
from barloom.catalog.registry import query
from barloom.catalog.shape import rounded
from barloom.operators import boosting
from barloom.operators import models as m
from barloom.plans.jobs import scan, scan_features, scan_intersection, train_and_validate
from barloom.schema import FEATURES
from barloom.session import materialize, scratch_path

TRAIN = f"select * from ({DATASET}) d where split = 'train'"
STATS = _per_feature("avg({c}) as mean, stddev_pop({c}) as scale", "train")


@query(
    "scaled_features",
    sql(
        "select t.sample_id, "
        + ", ".join(
            r(f"({c} - (select mean from stats where feature = '{c}')) / (select scale from stats where feature = '{c}')", c)
            for c in FEATURES
        )
        + " from train t",
        splits=TIME_SPLIT_SQL,
        train=TRAIN,
        stats=STATS,
    ),
)
def scaled(spark, sf):
    train = m.fill_features(samples(spark, sf).where(F.col("split") == "train"))
    return rounded(m.apply_scaler(train, m.scaler_statistics(train)).select("sample_id", *FEATURES))


@query(
    "balance_weights",
    sql(
        f"""select label, count(*) as n, {r('(select count(*) from train) / (2.0e0 * count(*))', 'class_weight')} from train group by label""",
        splits=TIME_SPLIT_SQL,
        train=TRAIN,
    ),
)
def weights(spark, sf):
    train = samples(spark, sf).where(F.col("split") == "train").select("label")
    return rounded(
        m.balance_weights(train).groupBy("label").agg(F.count("*").alias("n"), F.max(m.WEIGHT).alias("class_weight"))
    )


def samples(spark, sf):
    """The dataset as a table: training passes over it many times."""
    return materialize(labelled_windows(spark, sf).drop("future_return"), "samples")


NEWTON_STEPS = 9


def logistic_sql(body: str, **extra: str) -> str:
    """Newton steps from 0, unrolled: sums of gradient and curvature, then elimination by one term after another.

    `terms` holds the optimum of the standardised features, intercept first, in one row.
    """
    d = len(FEATURES) + 1
    place = {c: k + 2 for k, c in enumerate(FEATURES)}
    scaled = ", ".join(
        f"({c} - (select mean from stats where feature = '{c}')) / (select scale from stats where feature = '{c}')" for c in FEATURES
    )
    named = {"design": f"select label::double as label, [1.0e0, {scaled}] as x from train"}
    margin = " + ".join(f"x[{k}] * w[{k}]" for k in range(1, d + 1))
    named["w0"] = f"select [{', '.join(['0.0e0'] * d)}] as w"
    for t in range(NEWTON_STEPS):
        named[f"p{t}"] = f"select x, label, 1 / (1 + exp(-({margin}))) as p from design cross join w{t}"
        gradient = [f"sum((p - label) * x[{i}])" for i in range(1, d + 1)]
        cells = [f"sum(p * (1 - p) * x[{i}] * x[{j}]) as h{i}_{j}" for i in range(1, d + 1) for j in range(i, d + 1)]
        named[f"q{t}"] = f"select {', '.join(f'{g} as g{i + 1}' for i, g in enumerate(gradient))}, {', '.join(cells)} from p{t}"
        lines = []
        for i in range(1, d + 1):
            ridge = "" if i == 1 else " + 1.0e0"
            own = [f"h{min(i, j)}_{max(i, j)}" + (ridge if i == j else "") for j in range(1, d + 1)]
            lines.append(f"[{', '.join(own)}, g{i}" + ("" if i == 1 else f" + w[{i}]") + "]")
        named[f"e{t}_0"] = f"select w, [{', '.join(lines)}] as a from q{t} cross join w{t}"
        for k in range(1, d + 1):
            line = f"[case when i = {k} then a[i][j] / a[{k}][{k}] else a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}] end for j in range(1, {d + 2})]"
            named[f"e{t}_{k}"] = f"select w, [{line} for i in range(1, {d + 1})] as a from e{t}_{k - 1}"
        named[f"w{t + 1}"] = f"select [w[i] - a[i][{d + 1}] for i in range(1, {d + 1})] as w from e{t}_{d}"
    named["terms"] = f"select w from w{NEWTON_STEPS}"
    fitted = " + ".join(
        f"(coalesce({c}, 0) - (select mean from stats where feature = '{c}')) / (select scale from stats where feature = '{c}') * w[{k}]"
        for c, k in place.items()
    )
    chance = f"1 / (1 + exp(-(w[1] + {fitted})))"
    return sql(body.format(chance=chance), splits=TIME_SPLIT_SQL, train=TRAIN, stats=SCALES, **named, **extra)


SCALES = f"select feature, mean, case when scale > 0 then scale else 1 end as scale from ({STATS}) s"
TERMS_SQL = " union all ".join(
    f"select '{c}' as term, {r(f'w[{k + 1}]', 'weight')} from terms" for k, c in enumerate(["intercept", *FEATURES])
)
VALID = "select d.*, {chance} as y_score from (" + DATASET + ") d cross join terms where d.split = 'valid'"
VALIDATED_SQL = f"select sample_id, label as y_true, {r('y_score', 'y_score')}, (y_score >= 0.5)::int as y_pred from ({VALID}) v"
RATES_SQL = (
    "select n, tp, fp, fn, tn, "
    + r("(tp + tn) / n", "accuracy")
    + ", "
    + r("coalesce(tp / nullif(tp + fp, 0), 0)", "precision")
    + ", "
    + r("coalesce(tp / nullif(tp + fn, 0), 0)", "recall")
    + ", "
    + r("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1")
    + ", "
    + r("auc", "auc")
    + f""" from (select count(*) as n, count_if(label = 1 and y_score >= 0.5)::bigint as tp, count_if(label <> 1 and y_score >= 0.5)::bigint as fp,
    count_if(label = 1 and y_score < 0.5)::bigint as fn, count_if(label <> 1 and y_score < 0.5)::bigint as tn,
    (sum(case when label = 1 then place end) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0e0)
      / nullif(count_if(label = 1) * count_if(label = 0), 0) as auc
    from (select *, rank() over (order by y_score) + (count(*) over (partition by y_score) - 1) / 2.0e0 as place from ({VALID}) v) u) c"""
)


@query("logistic_regression", logistic_sql(TERMS_SQL))
def logistic(spark, sf):
    terms = m.logistic_terms(samples(spark, sf).where(F.col("split") == "train"))
    return rounded(spark.createDataFrame(list(terms.items()), "term string, weight double"))


def _validated(name, **params):
    return lambda spark, sf: rounded(train_and_validate(samples(spark, sf), name, **params).predictions)


query("validate_logistic_regression", logistic_sql(VALIDATED_SQL))(_validated("logistic_regression"))
query("validate_boosted_trees_balanced")(_validated("lightgbm"))
query("validate_boosted_trees")(_validated("xgboost"))


@query("validation_metrics", logistic_sql(RATES_SQL))
def validation_metrics(spark, sf):
    return rounded(train_and_validate(samples(spark, sf), "logistic_regression").metrics)


SCORED_SQL = "select sample_id, " + r("{chance}", "score") + " from (" + DATASET + ") d cross join terms"


@query("saved_model_scores", logistic_sql(SCORED_SQL))
def saved_model(spark, sf):
    rows, path = samples(spark, sf), scratch_path(spark, "model")
    m.save_model(m.train_model(rows.where(F.col("split") == "train")), path)
    return rounded(m.score(m.load_model(path), rows).select("sample_id", "score"))


PURE_SQL = f"select {r_all(FEATURES)}, {r('{chance}', 'score')} from ({DATASET}) d cross join terms"


@query("predict_proba", logistic_sql(PURE_SQL))
def pure_scores(spark, sf):
    rows = samples(spark, sf)
    model = m.train_model(rows.where(F.col("split") == "train"))
    return rounded(m.predict_proba(model, rows.select(*FEATURES)))


SCAN_SQL = (
    "select concat(ts_code, '_', cast(trade_date as string)) as sample_id, ts_code, trade_date as asof_date, "
    + r("{chance}", "score")
    + """ from index_features f cross join terms where rn >= 160
    and trade_date = (select max(trade_date) from index_bars p where p.ts_code = f.ts_code)"""
)


@query("scan", logistic_sql(SCAN_SQL))
def scanned(spark, sf):
    model = m.train_model(samples(spark, sf).where(F.col("split") == "train"))
    return rounded(scan(model, scan_features(derived(spark, sf, "index_bars"))))


@query("scan_intersection")
def scanned_by_two(spark, sf):
    train = samples(spark, sf).where(F.col("split") == "train")
    models = m.train_models(train, {"lgbm": "lightgbm", "xgb": "xgboost"})
    return rounded(scan_intersection(models, derived(spark, sf, "index_bars"), 200))


FIRST_TREES = {
    "second_order_trees_by_level": replace(boosting.SETTINGS["xgboost"], trees=3, depth=3, bins=16),
    "second_order_trees_by_leaf": replace(boosting.SETTINGS["lightgbm"], trees=3, depth=3, bins=16, leaves=None),
}


def trees_sql(settings: boosting.Settings) -> str:
    """The first trees, unrolled: a histogram, the best split and the next nodes per level."""
    s, lam = settings, settings.penalty
    values = ", ".join(f"floor(coalesce({c}, 0) * 10000 + 0.37)::double" for c in FEATURES)
    edges = " union all ".join(
        f"select {k} as feature, list(distinct v) as cuts from (select x[{k + 1}] as v, row_number() over (order by x[{k + 1}]) as place, "
        f"count(*) over () as n, max(x[{k + 1}]) over () as high from valued) z "
        f"where v < high and place in (select (j * n) // {s.bins} + 1 from range(1, {s.bins}) j(j))"
        for k in range(len(FEATURES))
    )
    weight = "(select count(*) from valued) / (2.0e0 * (select count(*) from valued o where o.label = v.label))" if s.balanced else "1.0e0"
    steps = [
        f"valued as (select sample_id, label::double as label, [{values}] as x from train where label in (0, 1))",
        f"edges as ({edges})",
        f"m0 as (select sample_id, label, {weight} as w, 0.0e0 as m, ["
        + ", ".join(f"len([c for c in (select cuts from edges where feature = {k}) if c < x[{k + 1}]])" for k in range(len(FEATURES)))
        + "] as b from valued v)",
    ]
    for t in range(s.trees):
        drawn = f"substr(md5(sample_id || ':{s.seed}:{t}'), 1, 8) < '{int(s.row_share * 2**32):08x}'"
        steps.append(
            f"n{t}_0 as (select *, 1 as node, {drawn} as drawn, w * (p - label) as g, w * p * (1 - p) as h "
            f"from (select *, 1 / (1 + exp(-m)) as p from m{t}))"
        )
        for level in range(s.depth):
            cells = " union all ".join(
                f"select node, {k} as feature, b[{k + 1}] as bin, sum(g) as g, sum(h) as h, count(*) as n from n{t}_{level} "
                f"where drawn and node >= {1 << level} group by node, bin"
                for k in boosting._picked(s.seed, t, len(FEATURES), s.column_share)
            )
            run = "over (partition by node, feature order by bin rows unbounded preceding)"
            whole = "over (partition by node, feature)"
            steps += [
                f"c{t}_{level} as ({cells})",
                f"u{t}_{level} as (select node, feature, bin, sum(g) {run} as gl, sum(h) {run} as hl, sum(n) {run} as nl, "
                f"sum(g) {whole} as g, sum(h) {whole} as h, sum(n) {whole} as n from c{t}_{level})",
                f"s{t}_{level} as (select node, feature, bin from (select *, row_number() over (partition by node order by gain desc, feature, bin) as place "
                f"from (select *, round(gl * gl / (hl + {lam}) + (g - gl) * (g - gl) / (h - hl + {lam}) - g * g / (h + {lam}), 7) as gain from u{t}_{level} "
                f"where n > nl and least(hl, h - hl) >= {s.min_curvature} and least(nl, n - nl) >= {s.min_rows}) where gain > 0) where place = 1)",
                f"n{t}_{level + 1} as (select r.* exclude (node), case when s.node is null then r.node else 2 * r.node + (r.b[s.feature + 1] > s.bin)::int end as node "
                f"from n{t}_{level} r left join s{t}_{level} s on r.node = s.node)",
            ]
        steps.append(
            f"m{t + 1} as (select sample_id, label, w, m + {s.rate} * coalesce(value, 0) as m, b from n{t}_{s.depth} left join "
            f"(select node, -sum(g) / (sum(h) + {lam}) as value from n{t}_{s.depth} where drawn group by node) using (node))"
        )
    named = {name: text for name, text in (step.split(" as (", 1) for step in steps)}
    named = {name: text.removesuffix(")") for name, text in named.items()}
    return sql(f"select sample_id, {r('1 / (1 + exp(-m))', 'score')} from m{s.trees}", splits=TIME_SPLIT_SQL, train=TRAIN, **named)


def _first_trees(settings):
    def run(spark, sf):
        train = samples(spark, sf).where(F.col("split") == "train")
        train = train.withColumns({c: F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 10000 + 0.37).cast("double") for c in FEATURES})
        return rounded(boosting.train_boosted(train, settings).score(train).select("sample_id", "score"))

    return run


for _name, _settings in FIRST_TREES.items():
    query(_name, trees_sql(_settings))(_first_trees(_settings))


def _whole_model(name):
    def run(spark, sf):
        rows = samples(spark, sf)
        model = boosting.train_boosted(rows.where(F.col("split") == "train"), replace(boosting.SETTINGS[name], trees=20))
        return rounded(model.score(rows.where(F.col("split") == "valid")).select("sample_id", F.col("label").alias("y_true"), "score"))

    return run


query("second_order_scores_by_level")(_whole_model("xgboost"))
query("second_order_scores_by_leaf")(_whole_model("lightgbm"))
