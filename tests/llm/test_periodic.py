"""Runs on the Re-Pair grammar against a plain search."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from labelforge.llm import periodic, queries

DOCS = "doc_id long, text string, id string, runs string, n_words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def plain(w):
    """All runs (start, length, period), period by period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_collapse(w):
    gone = {i for s, n, q in plain(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(docs_of_words):
    _, off, s, e, q = periodic._texts_runs([" ".join(w).encode() for w in docs_of_words])
    return [[(int(a), int(z - a), int(p)) for a, z, p in zip(s[i:j], e[i:j], q[i:j])] for i, j in zip(off[:-1], off[1:])]


word = st.sampled_from("abc")
piece = st.tuples(st.lists(word, max_size=9), st.integers(1, 7))


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(piece, max_size=8), min_size=1, max_size=4))
def test_any_text(texts):
    words = [[x for part, times in t for x in part * times] for t in texts]
    assert found(words) == [plain(w) for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_random_alphabets(seed):
    random.seed(seed)
    for _ in range(40):
        words = []
        for _ in range(random.randint(1, 4)):
            w = [str(random.randrange(random.choice([1, 2, 3, 40]))) for _ in range(random.randint(0, 250))]
            a = random.randrange(len(w) + 1)
            p = random.randint(1, 60)
            words.append(w[:a] + w[a:a + p] * random.randint(1, 6) + w[a + p:])
        assert found(words) == [plain(w) for w in words]


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 5)
    monkeypatch.setattr(periodic, "NEAREST", 2)
    for w in (list("ab" * 40 + "c" + "aab" * 30), list("a" * 90), list("abaababaabaababaababaabaababaabaab" * 2)):
        assert found([w]) == [plain(w)]


def test_grammar_derives_its_words():
    random.seed(5)
    w = np.array([random.randrange(3) for _ in range(400)] * 2 + [1] * 50, np.int64)
    own = np.repeat([0, 1, 2], [300, 300, 250])
    g = periodic.Grammar(w, own)

    def words(sym):
        return [sym] if sym < g.base else words(g.left[sym - g.base]) + words(g.right[sym - g.base])
    assert [words(r) for r in g.roots] == [w[own == k].tolist() for k in range(3)]
    assert all(w[a:a + g.size[g.base + k]].tolist() == words(g.base + k) for k, a in enumerate(g.at.tolist()))
    assert len(g.left) < 600  # the copy of 400 words costs few rules of its own


def test_long_texts_end():
    assert found([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    base = [str(random.randrange(10**6)) for _ in range(30_000)]
    assert found([base + base + base[:7]]) == [[(0, 60_007, 30_000)]]


def test_operator(spark):
    texts = [None, "", " \t\n", "a b c d e f g h i j k", "one two " * 6, "one two " * 6, "ONE two " * 5, "é ü x " * 9 + "tail", "a " * 40000, "b" * 30000, "x " * 11, "x " * 12,
             "p q r s t u v w x y " * 2, "\x0b".join("abcabcabcabc")]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        assert got[i]["n_words"] == len(w)
        if len(w) < 1000:
            assert [tuple(r) for r in got[i]["runs"]] == plain(w) and got[i]["collapsed"] == plain_collapse(w)
    assert got[8]["collapsed"] == "a" and [tuple(r) for r in got[8]["runs"]] == [(0, 40000, 1)]
    assert periodic.periodic_runs(docs(spark, ["a"]).limit(0)).count() == 0


def test_repeated_tails(spark):
    random.seed(1)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 60))) for _ in range(80)] + [None, "", "  "]
    want = []
    for i, t in enumerate(texts):
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        want.append(w)
    got = {r["doc_id"]: r["text"] for r in queries.repeat_tails(docs(spark, texts)).collect()}
    assert [(got[i] or "").split() for i in range(len(texts))] == want
