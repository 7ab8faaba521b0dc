"""The risk of the quality classifier and its gradient against plain loops; scores against a plain evaluation."""
import math
import random

import numpy as np
import pytest

from labelforge.llm import quality


def plain_parts(w, p, u, prior):
    def z(x):
        return sum(a * b for a, b in zip(w[:-1], x)) + w[-1]
    pos = prior * sum(math.log1p(math.exp(-z(x))) for x in p) / len(p)
    neg = sum(math.log1p(math.exp(z(x))) for x in u) / len(u) - prior * sum(math.log1p(math.exp(z(x))) for x in p) / len(p)
    return pos, neg


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.95])
def test_risk_and_gradient(prior):
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    climbed = 0
    for k in range(12):
        w = rng.normal(0, 1 + k / 4, 5)
        pos, neg = plain_parts(w, p, u, prior)
        assert np.allclose(quality.risk(w, p, u, prior), (pos, neg))
        climbed += neg < 0

        def value(v):
            a, b = plain_parts(v, p, u, prior)
            return -b if neg < 0 else a + b + quality.DECAY / 2 * sum(x * x for x in v[:-1])
        eye = np.eye(5) * 1e-5
        slope = [(value(w + e) - value(w - e)) / 2e-5 for e in eye]
        assert np.allclose(quality.risk_gradient(w, p, u, prior), slope, atol=1e-6)
    assert prior < 0.9 or climbed


def test_prior_over_all_rows(spark):
    """The tails are those of all rows, whatever the sample; the score is the plain evaluation of the model."""
    random.seed(1)
    good = [f"The house number {i} stands near the old river and the people of the town like it, they say." for i in range(60)]
    bad = ["$$$ ### !!! " * (2 + i % 5) for i in range(140)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(7, good[7])] * 50 + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    model = quality.learn(d, labels, max_unlabelled=60)
    x = np.array([quality.features(t) for t in good + bad + [good[7]] * 50 + [None]])
    seen = {}

    def keep(m, w, cuts):
        seen["plain"] = np.array([(m.basis(x) @ w >= c).mean() for c in cuts])
        seen["spark"] = quality.tails(d, m, w, cuts)
        return seen["spark"]
    quality.fit(x[:40], x[40:100], keep)
    assert np.allclose(seen["plain"], seen["spark"], atol=1 / 251)
    assert 0.3 < model.prior < 0.6
    got = dict(map(tuple, quality.score(d, model).collect()))
    for i in (0, 70, 199):
        t = (good + bad)[i]
        z = model.bias
        for k in range(quality.KNOTS):
            for j, v in enumerate(quality.features(t)):
                z += max(0.0, v - model.knots[k][j]) / model.scale[k * quality.WIDTH + j] * model.weights[k * quality.WIDTH + j]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9
