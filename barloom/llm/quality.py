"""Document quality by hierarchical empirical Bayes over sites."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bounded_sample
from barloom.llm.classify import Logistic, fit_logistic
from barloom.session import materialize

FEATURES = [
    "log_words", "upper", "digit", "exclaim", "symbol", "pipe", "sentence_marks", "repeated", "distinct", "word_length", "shouted",
]


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int8)
    for k, members in enumerate(
        [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#$%&*<>{}[]\\^~=_@", b"|", b".,;:?'\"-()"], start=1
    ):
        table[list(members)] = k
    return table


CLASSES = _classes()


def text_features(text: str) -> list[float]:
    """Shape of a whole text; all 0 where it has no word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    per = np.bincount(CLASSES[raw], minlength=7) / len(raw)
    repeated = sum(map(eq, words, words[1:])) / n
    shouted = sum(map(str.isupper, words)) / n
    return [
        float(np.log1p(n)), *(float(np.sqrt(x)) for x in per[1:7]), repeated, len(set(words)) / n,
        min(len(text) / n, 100.0) / 10, shouted,
    ]


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch.drop(columns=["text"])
        out["features"] = [text_features(t or "") for t in batch["text"].tolist()]
        yield out


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def shrunk(level: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """Add `posterior`: the site's mean quality, shrunk toward its parent's by the level's own spread.

    `level` has per site `n` documents, their `good` evidence and the `parent` posterior. The beta prior of a
    level has the parent as its mean; its weight comes from the moments of the sites (more spread between
    sites than their sizes explain gives a smaller weight), one number per level.
    """
    share = F.col("good") / F.col("n")
    noise = F.col(parent) * (1 - F.col(parent))
    moments = level.where("n > 0").agg(
        F.sum(F.col("n") * (share - F.col(parent)) ** 2).alias("spread"),
        F.sum(noise).alias("within"),
        F.sum(F.col("n") * noise).alias("total"),
    ).first()
    spread, within, total = (float(moments[i] or 0.0) for i in range(3))
    # E[spread] = within + (total - within) / (weight + 1)
    excess = max(spread - within, 1e-6 * max(total, 1e-9))
    weight = min(max((total - within) / excess - 1.0, 1.0), 1e6)
    return level.withColumn("posterior", (F.col("good") + weight * F.col(parent)) / (F.col("n") + weight))


def site_posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, host_posterior, posterior, global_rate) from rows with host, path and `evidence` in 0..1.

    Grouped sums first by (host, path), then by host: a host with a third of all rows is a partial sum in
    every task before the exchange.
    """
    paths = materialize(
        rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("evidence").alias("good")),
        "paths",
    )
    total = paths.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    rate = (float(total["g"] or 0.0) + 0.5) / (float(total["n"] or 0.0) + 1.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("_parent", F.lit(rate))
    hosts = shrunk(hosts, ["host"], "_parent").select(F.col("host").alias("_host"), F.col("posterior").alias("host_posterior"))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).drop("_host")
    return materialize(
        shrunk(both, ["host", "path"], "host_posterior")
        .select("host", "path", "host_posterior", "posterior", F.lit(rate).alias("global_rate")),
        "sites",
    )


def fit_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = 20_000
) -> tuple[Logistic, DataFrame, DataFrame]:
    """The document classifier, every document's evidence (doc_id, host, path, evidence), and the sites.

    The classifier reads the shape of the whole text and is fitted on at most `fit_rows` labelled rows chosen
    by hash. The evidence of all documents is summed by site; see `site_posteriors`.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        "text",
    )
    schema = "doc_id long, row_key long, host string, path string, features array<double>"
    shaped = materialize(rows.mapInPandas(_featured, schema), "shaped")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality"))
    labelled = materialize(shaped.join(known, "doc_id").select("row_key", "features", "quality"), "labelled")
    sample = sorted(bounded_sample(labelled, fit_rows, "row_key").collect())
    x = np.array([r["features"] for r in sample], dtype=float).reshape(-1, len(FEATURES))
    model = fit_logistic(x, np.array([r["quality"] for r in sample], dtype=float))

    @F.pandas_udf("double")
    def judge(features: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(features.to_numpy())) if len(features) else np.zeros(0))

    judged = materialize(shaped.withColumn("evidence", judge("features")).drop("features"), "judged")
    return model, judged, site_posteriors(judged)


def combined(evidence: Column, posterior: Column, rate: Column, site_weight: float) -> Column:
    """The document's log odds plus what its site says beyond the global rate, as a probability."""
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return 1 / (1 + F.exp(-(logit(bounded(evidence)) + site_weight * (logit(bounded(posterior)) - logit(bounded(rate))))))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    fit_rows: int = 20_000,
    site_weight: float = 0.5,
    threshold: float = 0.5,
) -> DataFrame:
    """Score every document of `docs` (doc_id, text, ...); `labels` has doc_id and quality (0 or 1).

    Sites are `source` and, as their paths, `lang` unless columns are given. The score adds to the document's
    log odds (`fit_quality`) `site_weight` times what its site says beyond the global rate. Returns doc_id,
    host, path, evidence, host_posterior, site_posterior, score and accepted (score >= threshold).

    A null text counts as empty; an empty one has shape 0 and is judged like others. Null hosts and paths are
    sites of their own. Labels of unknown, null or repeated ids count where they match. Without labels the
    evidence is 1/2 and all are accepted. Repeated rows are rows each. Other columns are ignored.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    _, judged, sites = fit_quality(docs, labels, host, path, fit_rows)
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    match = judged["host"].eqNullSafe(sites["_host"]) & judged["path"].eqNullSafe(sites["_path"])
    return (
        judged.join(sites, match)
        .withColumn("score", combined(F.col("evidence"), F.col("posterior"), F.col("global_rate"), site_weight))
        .select(
            "doc_id", "host", "path", "evidence", "host_posterior",
            F.col("posterior").alias("site_posterior"), "score", (F.col("score") >= threshold).alias("accepted"),
        )
    )


def accepted_rows(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    fit_rows: int = 20_000,
    site_weight: float = 0.5,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of `docs` that `quality_scores` accepts, judged where they are read; only sites are joined.

    The sites come from a written table, so Spark broadcasts them where they are few and else splits hot ones.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model, _, sites = fit_quality(docs, labels, host, path, fit_rows)

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        x = np.array([text_features(t or "") for t in text.tolist()], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(model.probability(x))

    names = ["__quality_host", "__quality_path", "__quality_evidence"]
    rows = docs.withColumns(dict(zip(names, [host.cast("string"), path.cast("string"), judge("text")])))
    sites = sites.withColumnsRenamed({c: f"__site_{c}" for c in sites.columns})
    match = rows[names[0]].eqNullSafe(sites["__site_host"]) & rows[names[1]].eqNullSafe(sites["__site_path"])
    score = combined(F.col(names[2]), F.col("__site_posterior"), F.col("__site_global_rate"), site_weight)
    return rows.join(sites, match).where(score >= threshold).select(*[rows[f"`{c}`"] for c in docs.columns])
