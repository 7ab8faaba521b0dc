"""Mixtures of languages against expectation-maximisation over dictionaries."""
import math
import random
from collections import Counter

import numpy as np

from labelforge.llm import language


def plain_em(grams, p, allowed):
    share = {m: 1 / len(allowed) for m in allowed}
    total = sum(grams.values())
    for _ in range(language.STEPS):
        new = dict.fromkeys(allowed, 0.0)
        for g, n in grams.items():
            s = sum(p[g][m] * share[m] for m in allowed)
            for m in allowed:
                new[m] += n * p[g][m] * share[m] / s
        share = {m: v / total for m, v in new.items()}
    return share, sum(n * math.log(sum(p[g][m] * share[m] for m in allowed)) for g, n in grams.items())


def plain_mixture(text, model):
    grams = Counter(language.trigrams([text])[1].tolist())
    if not grams:
        return None
    total, width = sum(grams.values()), len(model.languages)
    p = {g: np.exp(model.log_p[g]) for g in grams}
    full, _ = plain_em(grams, p, range(width))
    order = sorted(range(width), key=lambda m: -full[m])
    single = [sum(n * math.log(p[g][m]) for g, n in grams.items()) for m in range(width)]
    top = max(range(width), key=lambda m: single[m])
    best, value = {top: 1.0}, single[top]
    for size in range(2, width + 1):
        if full[order[size - 1]] < language.LEAST_SHARE:
            break
        share, ll = plain_em(grams, p, order[:size])
        ll -= language.PENALTY * (size - 1) * math.log(total + 1)
        if ll <= value:
            break
        best, value = share, ll
    return {model.languages[m]: (v * total + 1 / width) / (total + 1) for m, v in best.items() if v > 0}


def test_mixtures_equal_a_plain_search(spark):
    random.seed(6)
    words = {"en": "the of and to in is that it was for house garden", "de": "der die und das nicht ist ein haus garten mit auf", "fr": "le la les et est une dans que pour maison jardin", "es": "el los y es una en que por casa como"}
    words = {m: w.split() for m, w in words.items()}

    def text(*langs, n=40):
        return " ".join(" ".join(random.choice(words[m]) for _ in range(n)) for m in langs)
    train = [(text(m), m) for m in words for _ in range(30)]
    model = language.learn(spark.createDataFrame(train, "text string, lang string"))
    texts = [text(m) for m in words] + [text("en", "de"), text("fr", "es", n=80), text("en", "de", "fr", n=120), "the", "der", "x", "12 3", "", text("es", n=3), "été Straße"]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    sizes = set()
    for i, t in enumerate(texts):
        want = plain_mixture(t, model)
        if want is None:
            assert got[i]["lang_pred"] == "und" and not got[i]["mixture"]
            continue
        sizes.add(len(want))
        assert got[i]["mixture"].keys() == want.keys() and all(abs(got[i]["mixture"][m] - v) < 1e-6 for m, v in want.items())
        assert abs(got[i]["score"] - max(want.values())) < 1e-6
    assert {1, 2} <= sizes


def test_counts_equal_plain_counts(spark):
    train = [("abc abd", "a"), ("abc", "b"), (None, "a"), ("abd", None), ("abd abd abd", "b")]
    model = language.learn(spark.createDataFrame(train, "text string, lang string").repartition(3))
    n = {m: Counter(g for t, k in train if k == m and t for g in language.trigrams([t])[1].tolist()) for m in "ab"}
    for m in "ab":
        for g in set(n["a"]) | set(n["b"]):
            want = math.log((n[m][g] + language.SMOOTHING) / (sum(n[m].values()) + language.SMOOTHING * language.BUCKETS))
            assert abs(model.log_p[g, "ab".index(m)] - want) < 1e-9
