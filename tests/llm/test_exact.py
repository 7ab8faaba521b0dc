"""Exact duplicates and their cuckoo index against plain versions."""
import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labelforge.llm import exact

DOCS = "doc_id long, text string, digest string, n long, row long, kept string"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 7, 8, "y") for i, t in pairs], DOCS)


def key(i: int) -> bytes:
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=300))
def test_index_follows_a_dict(ops):
    index, plain = exact.CuckooIndex(1), {}
    for at, (i, add) in enumerate(ops):
        k = key(i)
        assert (index.find(k) >= 0) == (k in plain)
        if k in plain:
            assert index.delete(k) == plain.pop(k)
        if add:
            index.insert(k, at)
            plain[k] = at
    assert dict(index.items()) == plain and len(index) == len(plain)


def test_index_grows_and_shrinks():
    index = exact.CuckooIndex(2)
    for i in range(20_000):
        index.insert(key(i), i)
    assert index.mask + 1 >= 20_000 // exact.SLOTS and all(index.values[index.find(key(i))] == i for i in range(20_000))
    for i in range(0, 20_000, 2):
        index.delete(key(i))
    assert len(index) == 10_000 and all((index.find(key(i)) >= 0) == (i % 2 == 1) for i in range(20_000))


def test_fingerprint_hits_are_verified():
    """Digests that agree in fingerprint and bucket are different entries."""
    same = [b"\1\2" + b"\0" * 8 + bytes([i]) * 22 for i in range(8)]
    index = exact.CuckooIndex(1)
    for i, k in enumerate(same):
        index.insert(k, i)
    assert [index.values[index.find(k)] for k in same] == list(range(8))
    index.delete(same[3])
    assert index.find(same[3]) < 0 and index.find(same[4]) >= 0


def plain(pairs):
    sizes, best = {}, {}
    for i, t in pairs:
        t = t or ""
        sizes[t] = sizes.get(t, 0) + 1
        if t not in best or (i is not None and (best[t] is None or i > best[t])):
            best[t] = i
    return sorted(((i, best[t or ""], sizes[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs), key=repr)


def check(df, pairs):
    got = df.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got), key=repr) == plain(pairs)
    stay = [r for r in got if r["kept"]]
    assert len(stay) == len({t or "" for _, t in pairs}) and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_against_plain(spark):
    pairs = [(i, f"text {i % 37}" if i % 3 else "hot") for i in range(900)] + [(-5, None), (900, ""), (901, "é" * 40000), (902, "é" * 40000), (903, "text 1 "), (None, "text 1"), (None, "nowhere"), (None, "nowhere")]
    pairs += [(904, "twice"), (904, "twice"), (2, "other"), (2, "third")]
    check(exact.exact_duplicates(docs(spark, pairs).repartition(7)), pairs)
    assert exact.exact_duplicates(docs(spark, []).repartition(2)).count() == 0


def test_small_shards_and_no_hot_digest(spark, monkeypatch):
    pairs = [(i, f"t{i % 400}") for i in range(1600)]
    for shard, hot in ((1 << 20, 1), (1 << 20, 10**6), (150, 1024)):
        monkeypatch.setattr(exact, "SHARD", shard)
        monkeypatch.setattr(exact, "HOT", hot)
        check(exact.exact_duplicates(docs(spark, pairs).repartition(5)), pairs)


def test_survivors_keep_their_columns(spark):
    pairs = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")]
    out = exact.deduplicate(docs(spark, pairs))
    assert out.columns == docs(spark, pairs).columns
    assert {tuple(r) for r in out.collect()} == {(2, "a", "x", 7, 8, "y"), (3, "b", "x", 7, 8, "y"), (5, "", "x", 7, 8, "y")}


def test_ids_of_other_types(spark):
    d = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "name string, text string")
    assert {(r["name"], r["keep_id"], r["kept"]) for r in exact.exact_duplicates(d, "name").select("name", "keep_id", "kept").collect()} == {("b", "b", True), ("a", "b", False), (None, "b", False)}
    assert exact.exact_duplicates(d, "name").agg(F.max("group_size")).first()[0] == 3
