"""Phrase search by segments against every window and every phrase."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from labelforge.operators.phrases import find_phrases, segments


def plain_text(t):
    return re.sub(r"[^a-z0-9%]+", " ", re.sub("[’'`]", "", (t or "").lower())).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(texts, phrases):
    out = {}
    for d, t in texts:
        ws = [w for w in plain_text(t).split(" ") if w]
        for p in set(phrases):
            pw = plain_text(p)
            key = re.sub("[% ]", "", pw)
            if len(key) < 5:
                continue
            budget, nw = (0 if len(key) < 10 else 1 if len(key) < 16 else 2), len(pw.split(" "))
            for n in range(max(1, nw - 1), nw + 2):
                for i in range(len(ws) - n + 1):
                    j = re.sub("%", "", "".join(ws[i:i + n]))
                    if j[:1] == key[0] and abs(len(j) - len(key)) <= budget and (e := edits(j, key)) <= budget:
                        out.setdefault((d, p), (n, i, " ".join(ws[i:i + n]), e))
    return {k: v[2:] for k, v in out.items()}


def test_segments_cover_a_key():
    for n in range(5, 60):
        at = sorted((a, z) for _, a, z in segments(n))
        assert at[0][0] == 0 and at[-1][1] == n and all(x[1] == y[0] for x, y in zip(at, at[1:])) and len(at) == 1 + (n >= 10) + (n >= 16)


@pytest.mark.parametrize("rows", [1 << 21, 40])
def test_against_brute_force(spark, rows):
    random.seed(rows)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(40)] + ["50%", "%", "x%y"]
    phrases = [" ".join(random.choice(words) for _ in range(random.randint(1, 4))) for _ in range(60)] + ["Free-From Parabens", "ab", None, ""]

    def hurt(p):
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(p) + 1)
            p = random.choice([p[:i] + random.choice("abcd ") + p[i:], p[:i] + p[i + 1:], p[:i] + random.choice("abcd") + p[i + 1:]])
        return p
    texts = [(i, " ".join(hurt(random.choice(phrases[:60])) if random.random() < 0.6 else random.choice(words) for _ in range(random.randint(0, 12)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "%%"), (63, "freefrom PARABENS!"), (64, "free from parabans"), (None, "free from parabens")]
    t = spark.createDataFrame(texts, "doc_id long, text string")
    p = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    got = {(r["doc_id"], r["phrase"]): (r["matched"], r["edits"]) for r in find_phrases(t, p, index_rows=rows).collect()}
    assert got == brute(texts, [x for x in phrases if x])
    assert find_phrases(t, p.limit(0)).count() == 0 and find_phrases(t.limit(0), p).count() == 0


def test_longest_spans_against_a_walk(spark):
    from labelforge.operators.curate import longest_span_names
    random.seed(7)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(25)]
    names = sorted({" ".join(random.choice(words) for _ in range(random.randint(1, 3))).upper() for _ in range(40)})
    texts = [" ".join(random.choice(words + ["-", "x9", "é"]) for _ in range(random.randint(0, 25))) for _ in range(80)] + ["", None, names[0], f"{names[1]}, zz; {names[2].lower()}"]

    def fold(x):
        return re.sub("[^A-Z0-9?]", "", x.upper())
    by_key = {}
    for n in names:
        by_key[fold(n)] = max(n, by_key.get(fold(n), n))

    def plain(t):
        if fold(t) in by_key:
            return [by_key[fold(t)]]
        out = [by_key[fold(p)] for p in re.split("[;,]", t) if fold(p) in by_key]
        ks = [k for k in map(fold, t.split()) if k]
        i = 0
        while i < len(ks):
            j = next((j for j in range(len(ks), i, -1) if "".join(ks[i:j]) in by_key), None)
            if j:
                out.append(by_key["".join(ks[i:j])])
            i = j or i + 1
        return list(dict.fromkeys(out))
    d = spark.createDataFrame(list(enumerate(texts)), "id long, cell string")
    got = dict(map(tuple, longest_span_names(d, spark.createDataFrame([(n,) for n in names], "name string")).collect()))
    assert got == {i: plain(t) for i, t in enumerate(texts) if t and plain(t)}


def test_names_in_slices_and_of_one_hash(spark, monkeypatch):
    """A dictionary read in several slices gives what one slice gives, also where all keys of a length share a hash."""
    from labelforge.operators import phrases as P
    random.seed(11)
    words = ["".join(random.choice("AB") for _ in range(random.randint(1, 3))) for _ in range(8)]
    names = sorted({"".join(random.choice(words) for _ in range(random.randint(1, 3))) for _ in range(30)})
    texts = [" ".join(random.choice(words + ["C,", ";"]) for _ in range(random.randint(0, 30))) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    n = spark.createDataFrame([(x, f"N {x}") for x in names], "key string, name string")
    one = dict(map(tuple, P.name_spans(t, n).collect()))
    assert one and dict(map(tuple, P.name_spans(t, n, index_rows=7).collect())) == one
    raw = [x.encode() for x in texts]
    keys = pa.array(names), pa.array([f"N {x}" for x in names])
    want = sorted(map(tuple, P._settled(P._named(raw, P.Names(*keys), None)).T.tolist()))
    monkeypatch.setattr(P.Letters, "piece", lambda self, a, z, tag: np.asarray(z - a, np.int64))
    index = P.Names(*keys)
    assert index.alike > 1
    names_of = lambda x: [(d, index.names[e].as_py()) for d, e in x]
    assert sorted(names_of(P._settled(P._named(raw, index, None)).T.tolist())) == sorted((d, x) for d, xs in one.items() for x in xs) and len(want) == sum(map(len, one.values()))


def test_long_text_is_settled_without_a_shuffle(spark):
    from labelforge.operators.curate import longest_span_names
    d = spark.createDataFrame([(1, "red ring, blue " * 20000)], "id long, cell string")
    r = longest_span_names(d, spark.createDataFrame([("red ring",), ("blue",)], "name string"))
    assert r.first()["names"] == ["RED RING", "BLUE"]
    assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()


def test_texts_made_plain_as_columns_are(spark):
    from labelforge.functions import text as X
    from labelforge.operators.phrases import _plain
    from pyspark.sql import functions as F
    texts = ["Free-From’s `x` 50%", "ＦＲＥＥ ﬁne Å̊① ½ KK İ", "a\n\nb\r\n'c'", "", None, "ß·é­ x�\U0001f600y", "%%  %a"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(X.claim_text(F.col("t")).alias("t")).collect()
    got = bytes(_plain(texts)).decode().split("\n")[:-1]
    assert [" ".join(x.split()) for x in got] == [r["t"] or "" for r in t]


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    """A row group is never split, so one task would search all the texts."""
    from labelforge.plans.catalog import QUERIES
    from labelforge.runtime import dealt
    spark.range(5000).selectExpr("id AS doc_id", "concat('green lamp oil ', id) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "green lamp")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [n for n in dealt(docs, "doc_id").rdd.glom().map(len).collect() if n]
    cores = spark.sparkContext.defaultParallelism
    assert sum(rows) == 5000 and (cores == 1 or max(rows) * cores <= 2 * 5000)
    even = docs.repartition(4 * cores)
    assert dealt(even, "doc_id") is even
    for name in ("m5_find_phrases", "c1_extract_claims"):
        q = QUERIES[name](spark, str(tmp_path))
        assert q.count() == 5000 and (cores == 1 or "REPARTITION_BY_NUM" in q._jdf.queryExecution().executedPlan().toString())
