"""Kernels against direct brute force."""
import random

import numpy as np

from labelforge.functions import similarity as S


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def words(n, seed, letters="ABCLRNMVW?1"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(3, 14))) for _ in range(n)]


def test_lcs_and_ratio():
    a, b = words(150, 1), words(150, 2)
    (ca, la), (cb, _) = S.encode(a), S.encode(b)
    i = np.arange(150)
    assert list(S.lcs_pairs(S.letter_masks(ca), la, i, cb, i)) == [lcs(x, y) for x, y in zip(a, b)]
    assert all(abs(S.indel_ratio_one(x, y) - 200 * lcs(x, y) / (len(x) + len(y))) < 1e-9 for x, y in zip(a, b))


def test_costs():
    s = dict(zip(["q", "i", "m", "w"], S.explain_pairs(["ACUA", "GLYCERN", "RNILK", "GRATISS?IE"], ["AQUA", "GLYCERIN", "MILK", "GRATISSIME"])))
    assert abs(s["q"][0] - 0.9) < 1e-9 and s["q"][1] == ["C→Q (look-alike glyphs)"] and s["q"][2] == 0
    assert abs(s["i"][0] - (1 - 0.6 / 8)) < 1e-9 and s["i"][1] == ["'I' missing"]
    assert abs(s["m"][0] - (1 - 0.4 / 5)) < 1e-9
    assert s["w"][2] >= 1 or s["w"][0] > 0.8
    short = S.explain_pairs(["HELIANTHUSANNUUSSEED"], ["HELIANTHUSANNUUSSEEDOIL"])[0]
    assert short[1] == ["'Oil' not visible"] and abs(short[0] - (1 - 0.3 / 20)) < 1e-9


def test_plain_score_equals_explained():
    a, b = words(200, 5), words(200, 6)
    assert np.allclose(S.similarity_scores(a, b), [e[0] for e in S.explain_pairs(a, b)])
