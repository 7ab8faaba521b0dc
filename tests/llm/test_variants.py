"""Spelling variants in the trie of letter-group counts against a plain search."""
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from labelforge.llm import queries, variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, ratio=10):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(close), form, words[form] if form is not None else None)
    return out


def root(w, out):
    while out[w][2] is not None:
        w = out[w][2]
    return w


def vocabulary(seed, n=400, parts=("the", "an", "er", "io", "é", "ß", "ÿa", "b")):
    random.seed(seed)
    words = {"".join(random.choice(parts) for _ in range(random.randint(2, 6))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        i = random.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + random.choice("aeio") + w[i:], w[:i] + random.choice("xyz") + w[i + 1:]}
    return {w: int(10 ** random.uniform(0, 4)) for w in words if w}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("shard", [variants.SHARD, 30, 3])
def test_against_plain(spark, shard):
    words = vocabulary(shard) | {"a" * 300: 5, "a" * 301: 70, "a" * 299 + "b": 1, "a" * 300 + "b": 2, "z": 3, "zz": 40}
    want = plain(words)
    got = {r["word"]: r for r in variants.spelling_variants(table(spark, words).repartition(3), shard=shard).collect()}
    assert {w: (r["n"], r["n_near"], r["form"], r["form_n"]) for w, r in got.items()} == want
    assert {w: r["root"] for w, r in got.items()} == {w: root(w, want) for w in words}


def test_one_path_beyond_a_shard(spark):
    """Anagrams share a path down to the leaf, which is dealt by hash."""
    random.seed(2)
    words = {"".join(random.sample("abcdefgh", 8)): 1 for _ in range(400)} | {"abcdefg": 3, "abcdefghh": 9}
    got = {r["word"]: r["n_near"] for r in variants.near_words(table(spark, words), 25).collect()}
    assert got == {w: v[1] for w, v in plain(words).items() if v[1]}


def test_long_chains(spark):
    words = {"a" * (8 + i): 10 ** (2 * i) for i in range(8)}
    got = {r["word"]: r["root"] for r in variants.spelling_variants(table(spark, words)).collect()}
    assert set(got.values()) == {"a" * 15}


@settings(max_examples=120, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=5), min_size=1, max_size=60))
def test_trie_finds_every_pair(words):
    lat = sorted(w.encode("latin-1") for w in words)
    for size in {len(w) for w in lat}:
        trie = variants.Trie([w for w in lat if len(w) == size])
        for asked in (size, size - 1):
            some = [w for w in lat if len(w) == asked]
            if some:
                q, k = variants.near_pairs(trie, some)
                got = [frozenset((some[a], trie.words[b])) for a, b in zip(q, k)]
                assert len(got) == len(set(got))
                assert set(got) == {frozenset((a, b)) for a in some for b in trie.words if near(a, b)}


def test_reach_covers_the_trie():
    """A question is sent to the shard of every near word on its side, however the trie is cut."""
    words = [w.encode("latin-1") for w in vocabulary(9, 150)]
    path = {w: variants._node(len(w), variants.paths([w])[0]) for w in words}
    cuts = Counter(path[w][:4 + d] for w in words for d in range(variants.TOP, 17))
    heavy = {k: n for k, n in cuts.items() if n > 4}
    for w in words:
        sent = {longer: set(variants.reach(len(w), variants.paths([w]), heavy, longer)[1]) for longer in (False, True)}
        for v in words:
            if near(w, v) and (len(v) > len(w) or len(v) == len(w) and path[w] <= path[v]):
                d = 4 + variants.TOP
                while d < len(path[v]) and path[v][:d] in heavy:
                    d += 1
                assert path[v][:d] in sent[len(v) > len(w)]


def test_words_and_slips(spark):
    texts = ["Hello WORLDWIDE worldwide ÉTÉétés été", None, "", "  \t", "œuvre×naïve÷Straße 漢字letters\U0001F600letters d'accord", "WorldWide " * 3000, "x" * 40000 + " " + "x" * 40000, "plain words"]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)] + [(None, "worldwide", 2, "w")], "doc_id long, text string, n int, word string")
    want, slipped = Counter(), Counter()
    for i, t in [*enumerate(texts), ("", "worldwide")]:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w] += 1
            k = h % len(w)
            slipped[w[:k] + w[k + 1:] if h % 31 == 0 else w] += 1
    assert dict(map(tuple, variants.count_words(docs.repartition(3)).collect())) == {w: n for w, n in want.items() if len(w) >= 7}
    assert dict(map(tuple, variants.count_words(docs, slip=queries.slip).collect())) == {w: n for w, n in slipped.items() if len(w) >= 7}
    empty = variants.count_words(docs.limit(0))
    assert empty.count() == 0 and variants.spelling_variants(empty).count() == 0
