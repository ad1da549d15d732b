import numpy as np
import pytest

from lodestone.llm import toxicity
from lodestone.llm.common import Scratch

from .support import documents, empty


def made_up(rng, n, share):
    vocabulary = ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(800)]
    texts, labels = [], []
    for _ in range(n):
        words = list(rng.choice(vocabulary, rng.integers(5, 200)))
        bad = rng.random() < share
        if bad:
            for _ in range(max(1, len(words) // 30)):
                words[rng.integers(len(words))] = rng.choice(["vilex", "nastyo", "grimmy"]) + rng.choice(["", "s", "er"])
        texts.append(" ".join(words))
        labels.append(bad)
    return texts, np.array(labels)


def test_held_out_ranking_from_positives_and_unlabelled_text():
    rng = np.random.default_rng(3)
    texts, bad = made_up(rng, 3000, 0.15)
    labelled = rng.random(len(bad)) < 0.4
    used = [i for i in range(2000) if bad[i] or not labelled[i]]  # labelled clean texts stay out, as in learn()
    model = toxicity.PositiveUnlabelled().fit([toxicity.document_features(texts[i]) for i in used], (bad & labelled)[used], 0.15)
    predicted = np.array([model.score(t) >= 0.5 for t in texts[2000:]])
    truth = bad[2000:]
    assert (predicted & truth).sum() / truth.sum() > 0.9
    assert (predicted & ~truth).sum() / (~truth).sum() < 0.05


def test_scores_agree_with_document_features():
    rng = np.random.default_rng(4)
    texts, bad = made_up(rng, 200, 0.3)
    model = toxicity.PositiveUnlabelled().fit([toxicity.document_features(t) for t in texts], bad, 0.3)
    for t in [*texts[:20], "", "  ", "x" * 5000]:
        index, value = toxicity.document_features(t)
        f = model.bias + float((model.weights[index] * value).sum())
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-np.clip(f, -30, 30))), abs=1e-4)


def test_risk_and_its_slopes_by_hand():
    """The estimator written out, and its slopes by differences; below zero the corrected part alone climbs."""
    rng = np.random.default_rng(6)
    for prior, shift in ((0.2, 0.0), (0.6, 0.0), (0.9, 3.0)):
        positive = rng.random(40) < 0.4
        f = rng.normal(size=40) + np.where(positive, shift, -shift)
        loss = lambda z: np.log1p(np.exp(-z))
        plus = lambda f: prior * sum(loss(x) for x in f[positive]) / positive.sum()
        rest = lambda f: sum(loss(-x) for x in f[~positive]) / (~positive).sum() - prior * sum(loss(-x) for x in f[positive]) / positive.sum()
        first, second, slopes = toxicity.risk_and_slopes(f, positive, prior)
        assert first == pytest.approx(plus(f)) and second == pytest.approx(rest(f))
        assert (second < 0) == (shift > 0)
        whole = (lambda f: plus(f) + rest(f)) if second >= 0 else (lambda f: -rest(f))
        for i in range(40):
            step = np.zeros(40)
            step[i] = 1e-5
            assert slopes[i] == pytest.approx((whole(f + step) - whole(f - step)) / 2e-5, abs=1e-7)


def test_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (7, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, Scratch(spark, "t"))
    out = toxicity.score(docs.drop("toxicity"), model).collect()
    assert len(out) == 10 and all(0 <= r["toxicity"] <= 1 for r in out)
    same = {r["toxicity"] for r in out if r["doc_id"] in (5, 6)}
    assert len(same) == 1
    for a, b in ((empty(spark), labels), (docs, labels.limit(0)), (empty(spark), labels.limit(0))):
        nothing = toxicity.learn(a, b, Scratch(spark, "t"))
        assert nothing.score("text") == 0.0
    assert toxicity.score(empty(spark).drop("toxicity"), model).count() == 0


def test_query_on_the_small_table(spark):
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01")
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in out.collect() if r["doc_id"] in labels]
    bad, good = [s for s, t in rows if t == 1], [s for s, t in rows if t == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
