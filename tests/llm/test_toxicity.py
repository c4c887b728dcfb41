"""The toxicity label model against plain sums, and its results on planted forms of several languages."""

import random

import numpy as np
import pytest
from corpus import prose, stored
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import toxicity as module
from barloom.llm.classify import fit_logistic
from barloom.llm.common import bounded_sample, fold, sample_limit
from barloom.llm.toxicity import LabelModel, build_voters, fit_label_model, lower_bound, mine_cues, model_of, nested, soft_counts, toxicity_scores

FORMS = {"en": ["you moron", "what a clown", "pathetic loser"], "de": ["achlichver", "achlichau", "achlichtz"], "es": ["bomentera", "bomenteco", "bomenteja"]}


def planted(n, seed=5):
    """(doc_id, text, lang, toxic): one in eight is toxic, and clean texts hold a single form now and then."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        lang = draw.choice(["en", "en", "de", "es"])
        words = prose(1000 + k, 60).split()
        toxic = k % 8 == 0
        for _ in range(3 if toxic else int(lang != "en" and draw.random() < 0.08)):
            words.insert(draw.randrange(len(words)), draw.choice(FORMS[lang]))
        rows.append((k, " ".join(words), lang, int(toxic)))
    return rows


def test_every_language_is_caught(spark, tmp_path):
    rows = planted(1600)
    docs = stored(spark, tmp_path, [r[:2] for r in rows], "doc_id long, text string")
    labels = stored(spark, tmp_path, [(r[0], r[3]) for r in rows], "doc_id long, toxic int", "labels")
    held = {r["doc_id"] for r in docs.where(fold("doc_id", 4) == 2).collect()}
    called = {r["doc_id"]: r["predicted"] for r in toxicity_scores(docs, labels, fold("doc_id", 4) != 2).collect()}
    for lang in FORMS:
        toxic = [called[d] for d, _, x, t in rows if x == lang and t and d in held]
        clean = [called[d] for d, _, x, t in rows if x == lang and not t and d in held]
        assert len(toxic) > 8 and np.mean(toxic) >= 0.9 and np.mean(clean) < 0.01


def test_soft_counts_equal_plain_sums(spark):
    draw = random.Random(1)
    rows = [([draw.choice([0, 0, 1, 2, 3]) for _ in range(3)], draw.choice([-1, 0, 1]), draw.randrange(1, 9)) for _ in range(60)]
    model = fit_label_model(spark.createDataFrame(rows, "levels array<int>, known int, n long"), 3, rounds=3, tolerance=0.0)
    expected = None
    for _ in range(3):
        total = np.zeros((2, 3 * 4 + 2))
        for levels, known, n in rows:
            if known < 0 and expected is None:
                continue
            p = known if known >= 0 else expected.posterior(np.array([levels]))[0]
            for side, mass in ((0, n * p), (1, n * (1 - p))):
                for voter, level in enumerate(levels):
                    total[side, 4 * voter + level] += mass
                total[side, -2] += mass * (not any(levels))
                total[side, -1] += mass
        expected = model_of(total, 3)
    assert np.allclose(model.toxic, expected.toxic) and np.allclose(model.clean, expected.clean)
    assert np.allclose(model.silent, expected.silent) and model.prior == pytest.approx(expected.prior)
    levels = np.array([r[0] for r in rows])
    assert np.allclose(soft_counts(levels, np.ones(60), np.full(60, 0.5))[0], soft_counts(levels, np.ones(60), np.full(60, 0.5))[1])


def test_silence_of_a_voter_is_no_evidence():
    model = LabelModel(np.array([[0.5, 0.2, 0.2, 0.1]] * 2), np.array([[0.97, 0.01, 0.01, 0.01]] * 2), (0.1, 0.9), 0.1)
    one = LabelModel(model.toxic[:1], model.clean[:1], model.silent, 0.1)
    assert model.posterior(np.array([[2, 0]]))[0] == pytest.approx(one.posterior(np.array([[2]]))[0])
    odds = 0.1 / 0.9
    assert model.posterior(np.array([[2, 0], [0, 0], [1, 3]])) == pytest.approx([x / (1 + x) for x in (odds * 20, odds / 9, odds * 200)])


def test_dependent_cues_make_one_voter():
    mined = [("aa*", tuple(range(10))), ("bb*", tuple(range(1, 10))), ("cc", tuple(range(10, 40)))]
    voters = build_voters(mined, {"idiot": "insults"})
    of = dict(voters.cues)
    assert of["aa*"] == of["bb*"] != of["cc"] and of["idiot"] not in (of["aa*"], of["cc"]) and voters.count == 3
    assert nested("bom*", "bomente*") and nested("bom*", "bomber") and not nested("bom", "bomber") and nested("x", "x")


def test_cues_hold_in_the_half_that_did_not_propose_them(spark):
    draw = random.Random(2)
    rows = [(f"{prose(k, 30)} rare{k} " + ("tell tale" if k % 4 == 0 and draw.random() < 0.9 else ""), int(k % 4 == 0)) for k in range(240)]
    found = [c for c, _ in mine_cues(spark.createDataFrame(rows, "text string, toxic int"))]
    assert {"tell", "tale"} & set(found) or {"tel*", "tal*"} & set(found)
    assert not any(c.startswith("rare") for c in found)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.integers(0, 200))
def test_lower_bound_lies_below_the_share(right, wrong):
    low = lower_bound(right, wrong)
    assert 0 <= low <= (right / (right + wrong) if right + wrong else 0) + 1e-12


def test_sample_threshold_at_any_size(spark):
    for n in (30_000, 10**10, 10**11, 10**15):
        share = (sample_limit(n, 20_000) + 2**63) / 2**64
        assert share * n == pytest.approx(20_000, rel=1e-3)
    assert bounded_sample(spark.range(5), 10, "id").count() == 5
    assert 60 <= bounded_sample(spark.range(5000), 100, "id").count() <= 150


def test_weights_count_rows():
    x, y = np.array([[0.0], [1.0], [2.0]]), np.array([0.0, 1.0, 1.0])
    a = fit_logistic(np.repeat(x, [3, 1, 2], axis=0), np.repeat(y, [3, 1, 2]))
    b = fit_logistic(x, y, weight=np.array([3.0, 1.0, 2.0]))
    assert np.allclose(a.probability(x), b.probability(x))
    assert module.fit_logistic(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((1, 2)))[0] == 0.5
