"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.classify import Logistic, fit_logistic, sigmoid
from barloom.llm.common import bounded_sample
from barloom.session import materialize

#: Lexicon words, which need no labels (fixed values).
LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb imbecile cretin fool dimwit dunce halfwit",
    "contempt": "loser losers pathetic worthless useless scum trash garbage vermin filth filthy clown disgusting vile",
    "violence": "kill murder destroy exterminate strangle beat stab",
    "slurs_de": "dummkopf vollidiot abschaum trottel arschloch wertlos widerlich",
    "slurs_fr": "imbécile crétin connard ordure abruti minable dégoûtant",
    "slurs_es": "idiota imbécil estúpido basura asqueroso inútil escoria",
}
STEMS = (3, 4, 5, 6, 7, 8)
#: A voter says none, one, two, or three and more of its cues.
LEVELS = 4


def plain(word: str) -> str:
    """Lower-cased letters and digits of a word."""
    word = word.lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def cues_of(word: str) -> list[str]:
    """What a word may be known by: itself, or that it begins with a stem and is longer than it."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)] if len(word) >= 3 else []


@dataclass(frozen=True)
class Voters:
    """Cue -> voter number, and how many voters there are."""

    cues: tuple[tuple[str, int], ...]
    count: int


class VotesOfWord(dict):
    """Raw word -> voters that one of its cues belongs to; emptied at `limit` words."""

    def __init__(self, voters: Voters, limit: int = 400_000) -> None:
        super().__init__()
        self.cues, self.limit = dict(voters.cues), limit

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = tuple(sorted({self.cues[c] for c in cues_of(plain(raw)) if c in self.cues}))
        self[raw] = found
        return found


@lru_cache(maxsize=2)
def votes_of_word(voters: Voters) -> VotesOfWord:
    return VotesOfWord(voters)


def count_votes(text: str, voters: Voters) -> list[int]:
    """Hits of each voter in the whole text."""
    hits = [0] * voters.count
    for found in filter(None, map(votes_of_word(voters).__getitem__, text.split())):
        for voter in found:
            hits[voter] += 1
    return hits


def lower_bound(right: float, wrong: float, z: float = 1.0) -> float:
    """Wilson's lower bound of a share."""
    n = right + wrong
    if n <= 0:
        return 0.0
    p = right / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def nested(a: str, b: str) -> bool:
    """Whether every word of one cue is one of the other's."""
    a, b = sorted((a, b), key=lambda c: len(c.rstrip("*")))
    return a == b or a.endswith("*") and b.rstrip("*").startswith(a[:-1])


def _levels(text: str | None) -> Counter:
    """How often each cue stands in a text, up to the highest level."""
    found: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for cue in cues_of(plain(word)):
            found[cue] += n
    return found


def mine_cues(sample: DataFrame, least: int = 3, bound: float = 0.6, covers: int = 3) -> list[tuple[str, tuple[int, ...]]]:
    """Words and stems that mark toxic rows of a bounded labelled sample (text, toxic), and toxic rows that hold each.

    A cue is proposed at a level (so many times in a row or more) by one half of the distinct texts and taken
    if the lower bound of its precision is at least `bound` in the other half as well. Of those, cues are picked
    by the toxic rows they add, until each row is covered `covers` times or no cue adds `least` rows, so rare
    words of a much copied row do not become cues once that row is explained. Of nested cues one is picked.
    """
    rows = sample.dropDuplicates(["text"]).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int"))
    rows = materialize(rows.select("text", "toxic", "half"), "distinct-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for text, toxic, half in zip(batch["text"].tolist(), batch["toxic"].tolist(), batch["half"].tolist()):
                for cue, n in _levels(text).items():
                    for level in range(1, min(n, LEVELS - 1) + 1):
                        seen.setdefault((cue, level), [0, 0, 0, 0])[2 * int(half) + int(toxic)] += 1
        found = [(c, level, *n) for (c, level), n in seen.items()]
        for at in range(0, len(found), 20_000):
            yield pd.DataFrame(found[at : at + 20_000], columns=["cue", "level", "good0", "bad0", "good1", "bad1"]).astype({"cue": object})

    names = ["good0", "bad0", "good1", "bad1"]
    counted = rows.mapInPandas(count, "cue string, level int, good0 long, bad0 long, good1 long, bad1 long").groupBy("cue", "level")
    counted = counted.agg(*[F.sum(c).alias(c) for c in names]).where(F.col("bad0") + F.col("bad1") >= least)
    counted = counted.where(F.col("bad0") + F.col("bad1") >= F.col("good0") + F.col("good1"))
    sure: dict[str, dict[int, float]] = {}
    for r in counted.collect():
        bounds = [lower_bound(r["bad0"], r["good0"]), lower_bound(r["bad1"], r["good1"])]
        if min(bounds) >= bound:
            sure.setdefault(r["cue"], {})[r["level"]] = min(bounds)
    chosen = frozenset(sure)

    # at most the toxic rows of the bounded sample, each with its chosen cues
    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{c: min(n, LEVELS - 1) for c, n in _levels(t).items() if c in chosen} for t in batch["text"].tolist()]
            yield pd.DataFrame({"cues": [sorted(f) for f in found], "levels": [[f[c] for c in sorted(f)] for f in found]})

    toxic_rows = rows.where("toxic = 1").mapInPandas(marked, "cues array<string>, levels array<int>").collect()
    cover: dict[str, set[int]] = {}
    value: dict[str, float] = {}
    for c, levels in sure.items():
        value[c] = max(levels.values())
    for i, r in enumerate(sorted(toxic_rows)):
        for c, n in zip(r["cues"], r["levels"]):
            if n >= min(sure[c]):
                cover.setdefault(c, set()).add(i)
    wanted = dict.fromkeys(range(len(toxic_rows)), covers)
    found = []
    while cover:
        # of equal cover the more precise, then a stem, which also knows words not seen yet
        gain = {c: sum(i in wanted for i in rows_of) for c, rows_of in cover.items()}
        best = max(cover, key=lambda c: (gain[c] * value[c], c.endswith("*"), -len(c), c))
        if gain[best] < least:
            break
        found.append((best, tuple(sorted(cover[best]))))
        for i in cover[best] & wanted.keys():
            wanted[i] -= 1
            if not wanted[i]:
                del wanted[i]
        cover = {c: r for c, r in cover.items() if not nested(c, best) and gain[c] >= least}
    return found


def lexicon_cues(sample: DataFrame) -> dict[str, str]:
    """Lexicon words, by lexicon, but for those that the sample shows in clean rows rather than in toxic ones."""
    of = {word: name for name, words in LEXICONS.items() for word in words.split()}

    @F.pandas_udf("array<string>")
    def held(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted({plain(w) for w in (t or "").split()} & of.keys()))

    seen = sample.dropDuplicates(["text"]).select("toxic", F.explode(held("text")).alias("word")).groupBy("word")
    wrong = {r["word"] for r in seen.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect() if lower_bound(r["n"] - r["bad"], r["bad"]) > 0.5}
    return {w: name for w, name in of.items() if w not in wrong}


def build_voters(mined: list[tuple[str, tuple[int, ...]]], lexicon: dict[str, str], lift: float = 1.3, least: int = 3) -> Voters:
    """Cues that stand in the same toxic rows more often than chance are one voter, as their votes are not independent.

    So forms of one language, which share rows and no others, vote together, and are counted together. Lexicon
    words that were not mined are a voter for each lexicon.
    """
    total = len({i for _, rows in mined for i in rows})
    group = list(range(len(mined)))

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    sets = [set(rows) for _, rows in mined]
    for a in range(len(mined)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least and both * total > lift * len(sets[a]) * len(sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    cues: dict[str, str] = {cue: f"mined{root(k):06d}" for k, (cue, _) in enumerate(mined)}
    cues |= {w: name for w, name in lexicon.items() if w not in cues}
    numbers = {name: k for k, name in enumerate(sorted(set(cues.values())))}
    return Voters(tuple(sorted((c, numbers[name]) for c, name in cues.items())), len(numbers))


@dataclass(frozen=True)
class LabelModel:
    """Chance of each level of each voter on toxic and on clean rows, of rows without a vote, and of a toxic row."""

    toxic: np.ndarray
    clean: np.ndarray
    silent: tuple[float, float]
    prior: float

    def posterior(self, levels: np.ndarray) -> np.ndarray:
        """A voter without a hit abstains; only a row on which all abstain is told by that."""
        ratio = np.log(self.toxic) - np.log(self.clean)
        ratio[:, 0] = 0.0
        evidence = ratio[np.arange(ratio.shape[0]), levels].sum(axis=1) if ratio.shape[0] else np.zeros(len(levels))
        none = np.log(self.silent[0]) - np.log(self.silent[1])
        return sigmoid(np.log(self.prior) - np.log1p(-self.prior) + np.where(levels.any(axis=1), evidence, none))


def model_of(counts: np.ndarray, voters: int) -> LabelModel:
    """From soft counts of toxic and clean rows: by voter and level, then of silent rows, then of all."""
    by = counts[:, : voters * LEVELS].reshape(2, voters, LEVELS)
    # where nothing was seen, a vote speaks for toxic
    before = np.array([[1.0, 0.4, 0.3, 0.3], [1.0, 0.2, 0.02, 0.02]])
    rates = (by + before[:, None, :]) / (by.sum(axis=2, keepdims=True) + before.sum(axis=1)[:, None, None])
    silent, total = counts[:, -2], counts[:, -1]
    quiet = (silent + [0.5, 1.0]) / (total + [1.0, 2.0])
    prior = float(np.clip((total[0] + 0.5) / (total.sum() + 5.0), 1e-4, 0.5))
    return LabelModel(rates[0], rates[1], (float(quiet[0]), float(quiet[1])), prior)


def soft_counts(levels: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    rows = []
    for mass in (n * p, n * (1 - p)):
        by = np.stack([mass @ (levels == k) for k in range(LEVELS)], axis=1).ravel()
        rows.append(np.r_[by, mass[~levels.any(axis=1)].sum(), mass.sum()])
    return np.array(rows)


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = 8, tolerance: float = 0.01) -> LabelModel:
    """Expectation maximisation over a written table of distinct patterns: levels, known (0, 1, else -1), n.

    Rows with a label keep their class. The first model is that of the labelled rows alone; each round adds up
    soft counts in one pass, of which the driver sees as many numbers as voters have levels.
    """

    def counts(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, voters * LEVELS + 2))
            for batch in batches:
                if not len(batch):
                    continue
                levels = np.array(batch["levels"].tolist(), np.int64).reshape(len(batch), voters)
                known, n = batch["known"].to_numpy(), batch["n"].to_numpy(float)
                if model is None:
                    n = np.where(known >= 0, n, 0.0)
                p = known.astype(float) if model is None else np.where(known >= 0, known, model.posterior(levels))
                total += soft_counts(levels, n, p)
            yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

        sums = patterns.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        found = np.zeros((2, voters * LEVELS + 2))
        found.ravel()[[r["at"] for r in sums]] = [r["x"] for r in sums]
        return found

    before = None
    for _ in range(rounds):
        model = model_of(counts(None if before is None else before), voters)
        if before is not None and np.abs(np.log(model.toxic / model.clean) - np.log(before.toxic / before.clean)).max(initial=0) < tolerance:
            break
        before = model
    return model


def vote_features(hits: np.ndarray) -> np.ndarray:
    """Whether each voter has one, two, three and more hits, whether there is none at all, and all hits."""
    return np.column_stack([*(hits >= k for k in range(1, LEVELS)), ~hits.any(axis=1), np.log1p(hits.sum(axis=1))]).astype(float)


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    classifier: Logistic

    def scores(self, hits: np.ndarray) -> np.ndarray:
        return self.classifier.probability(vote_features(hits))


def _hits(rows: list, voters: Voters) -> np.ndarray:
    return np.array(rows, dtype=np.int64).reshape(-1, voters.count)


def _voted(voters: Voters):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=["text"])
            out["hits"] = [count_votes(t or "", voters) for t in batch["text"].tolist()]
            yield out

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, fit_rows: int = 20_000
) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the votes on every document: doc_id, row_key (of id and text), hits per voter.

    Cues are lexicon words and what is mined from at most `fit_rows` labelled rows; those that depend on each
    other make one voter. The votes on all rows, counted by distinct pattern, fit a generative model of how
    often each voter speaks on toxic and on clean text; a linear classifier learns its posteriors, from at most
    `fit_rows` rows that have votes and all that have none, which are alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if learn_from is not None:
        known = known.where(learn_from)
    known = materialize(known, "labels")
    chosen = bounded_sample(known, fit_rows, "doc_id")
    sample = materialize(rows.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"), "sample")
    voters = build_voters(mine_cues(sample), lexicon_cues(sample))

    voted = materialize(rows.mapInPandas(_voted(voters), "doc_id long, row_key long, hits array<int>"), "votes")
    levels = F.transform("hits", lambda x: F.least(x, F.lit(LEVELS - 1)))
    marked = voted.join(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    patterns = marked.groupBy(levels.alias("levels"), F.coalesce("toxic", F.lit(-1)).alias("known")).agg(F.count("*").alias("n"))
    patterns = materialize(patterns, "patterns")
    model = fit_label_model(patterns, voters.count)

    spoken = F.exists("hits", lambda x: x > 0)
    all_spoken, all_rows = voted.where(spoken).count(), voted.count()
    taught = sorted(bounded_sample(voted.where(spoken), fit_rows, "row_key").select("row_key", "hits").collect())
    hits = np.vstack([np.zeros((1, voters.count), np.int64), _hits([r["hits"] for r in taught], voters)])
    weight = np.r_[all_rows - all_spoken, np.full(len(taught), all_spoken / max(1, len(taught)))]
    classifier = fit_logistic(vote_features(hits), model.posterior(np.minimum(hits, LEVELS - 1)), weight=weight)
    return ToxicityModel(voters, model, classifier), voted


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    fit_rows: int = 20_000,
    threshold: float = 0.3,
) -> DataFrame:
    """Score every document of `docs` (doc_id, text); `labels` has doc_id and toxic (0 or 1).

    Labels are read only where `learn_from`, a column over doc_id, holds; see `fit_toxicity`. Inputs of a score
    are the text's words only. Returns doc_id, posterior, score and predicted (score >= threshold).

    Null texts count as empty, which get no votes and the score of texts without cues. Very long texts are read
    whole. Repeated rows are rows each; a repeated label counts once, the toxic one where they differ. Without
    labels only the lexicons vote. Other columns, whatever their names, are ignored; no rows give no rows.
    """
    model, voted = fit_toxicity(docs, labels, learn_from, fit_rows)

    @F.pandas_udf("posterior double, score double")
    def judge(hits: pd.Series) -> pd.DataFrame:
        h = _hits(hits.tolist(), model.voters)
        return pd.DataFrame({"posterior": model.labels.posterior(np.minimum(h, LEVELS - 1)), "score": model.scores(h)})

    return voted.withColumn("_j", judge("hits")).select(
        "doc_id", "_j.posterior", "_j.score", (F.col("_j.score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, fit_rows: int = 20_000, threshold: float = 0.3
) -> DataFrame:
    """The rows of `docs`, with all their columns, that `toxicity_scores` does not call toxic, judged where they
    are read: no exchange. Nulls, long texts, repeats and no rows are as there.
    """
    model, _ = fit_toxicity(docs, labels, learn_from, fit_rows)

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_hits([count_votes(t or "", model.voters) for t in text.tolist()], model.voters)))

    return docs.where(judge("text") < threshold)
