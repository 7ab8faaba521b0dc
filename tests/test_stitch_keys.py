"""Similarity of two keys: the bounds that spare the edit distance never change it."""
import random

from labelforge.operators import stitch


def plain(a, b, least=stitch.MATCH_SIM):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    got = 1 - row[-1] / max(len(a), len(b), 1)
    return got if (a or b) and got >= least else None


def test_similarity_is_the_edit_distance_where_it_counts():
    rng, alike = random.Random(2), 0
    for _ in range(4000):
        a = "".join(rng.choices("ABCÀ19\u0081", k=rng.randint(0, 12) * rng.choice((1, 1, 7))))
        b = "".join(c if rng.random() < 0.8 else rng.choice("ABCÀ19\u0081") for c in a)[:rng.choice((99, max(0, len(a) - 1)))]
        want = plain(a, b)
        assert stitch.similarity(a, b) == want, (a, b)
        if len(a) <= 64:
            assert (stitch._letters(a) & stitch._letters(b)).bit_count() >= sum(min(a.count(c), b.count(c)) for c in set(a))
        alike += want is not None
    assert alike > 1000
