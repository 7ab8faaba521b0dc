"""The fuzzy pool against all pairs."""
import random

import numpy as np

from labelforge.functions import similarity as S
from labelforge.operators import matching as M

STEMS = "sodium potassium cetyl stearyl glyceryl methyl propyl butyl ethyl hexyl lauryl myristyl oleyl zinc iron mica amino silica cera coco palm rosa".split()
ENDS = "chloride oxide sulfate benzoate sorbate stearate palmitate oleate acid alcohol extract oil water butter gum glycol ester amide phosphate citrate".split()


def catalogue(n, seed):
    """Names of two to four words, made like real ones: many share words, so floors and bounds have work to do."""
    r, out = random.Random(seed), set()
    while len(out) < n:
        out.add("".join([r.choice(STEMS) for _ in range(r.randint(1, 3))] + [r.choice(ENDS)]).upper() + r.choice(["", "", "2", "40"]))
    return sorted(out)


def noisy(names, n, seed):
    r, out = random.Random(seed), set()
    while len(out) < n:
        k = list(r.choice(names))
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(k))
            k[i:i + 1] = r.choice([[], [r.choice("AEIOQ?7")], [k[i], r.choice("LMN")]]) or ["X"]
        out.add("".join(k)[:60])
    return sorted(out)


def brute(names, keys, cutoff, limit):
    names = np.array(sorted(names), dtype=object)
    codes, lens = S.encode(list(names))
    out = set()
    for k in keys:
        if len(k) < S.LANE:
            c, n = S.encode([k])
            r = 200.0 * S.lcs_pairs(S.letter_masks(c), n, np.zeros(len(names), int), codes, np.arange(len(names))) / (n[0] + lens)
        else:
            r = np.array([S.indel_ratio_one(k, x) for x in names])
        best = np.lexsort((np.arange(len(names)), -r))[:limit]
        out |= {(k, names[i], pos) for pos, i in enumerate(best) if r[i] >= cutoff}
    return out


def pool(spark, keys, names, **how):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    return [tuple(r) for r in M.name_pool(one(keys), one(names), **how).collect()]


def test_pool_equals_all_pairs(spark):
    names = catalogue(6_000, 1)
    keys = noisy(names, 60, 2) + ["QQQQQQ", "A" * 9, "AB", "?"]
    got = pool(spark, keys, names, block=700)
    assert len(got) == len(set(got)) and set(got) == brute(names, keys, 45.0, 40)


def test_pool_without_floors(spark):
    names = catalogue(300, 3)
    keys = noisy(names, 40, 4)
    for cutoff, limit, block in ((45.0, 40, 4_096), (75.0, 40, 50)):
        assert set(pool(spark, keys, names, cutoff=cutoff, limit=limit, block=block)) == brute(names, keys, cutoff, limit)


def test_long_and_foreign_strings(spark):
    long = "ABCLRNMV" * 12
    names = [long[:-1], long + "W", "W" * 90, "ÀÉÎ OIL", "ABC", "A" * 20]
    keys = [long, "ÀÉÎ OILS", "A" * 18, "x-y", "W" * 300]
    assert set(pool(spark, keys, names, limit=5)) == brute([n for n in names if n.isascii()], [long, "A" * 18, "W" * 300], 45.0, 5) | {("ÀÉÎ OILS", "ÀÉÎ OIL", 0)}


def test_nulls_repeats_and_empty_tables(spark):
    assert pool(spark, [None, "", "ABC", "ABC"], ["ABC", None, "", "ABC"]) == [("ABC", "ABC", 0)]
    assert pool(spark, ["ABC"], []) == [] and pool(spark, [], ["ABC"]) == []


def test_letter_profile_bounds_the_common_subsequence(spark):
    a, b = noisy(catalogue(200, 5), 80, 6), catalogue(80, 7)
    rows = spark.createDataFrame([(x, y) for x, y in zip(a + ["E" * 30], b + ["E" * 25 + "9" * 12])], "a string, b string")
    p, q = M.letter_profile(rows["a"]), M.letter_profile(rows["b"])
    shared = sum((M.F.bit_count(p[m].bitwiseAND(q[m])) for m in range(3)), M.F.least(p[3], q[3]))
    for r in rows.select("a", "b", shared.alias("s")).collect():
        assert r.s >= S.indel_ratio_one(r.a, r.b) * (len(r.a) + len(r.b)) / 200 - 1e-9


def test_near_names_settle_numbered_names(spark):
    """Names that share all letters but their number are met by what is left of them; the pool equals all pairs."""
    r = random.Random(9)
    names = sorted({f"SUPPLIER{r.randrange(3000):09d}" for _ in range(700)} | {f"S{n}" for n in range(40)})
    keys = noisy(names, 50, 10) + ["ZQ17WVXY", "S1", "SUPPLIER0000012347", "Q"]
    for limit, cutoff in ((5, 75.0), (3, 90.0)):
        assert set(pool(spark, keys, names, cutoff=cutoff, limit=limit, near=3)) == brute(names, keys, cutoff, limit)
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    done, open_ = M.near_names(one(names[:1] + [n + "7" for n in names[-50:]]), one(names), 75.0, 5, 3)
    assert open_.count() <= 2 and done.count() >= 5 * 49
    assert M.reaching(one(["ZQ17WVXY", "SUPPLIER0000012347"]), one(names[-50:]), 75.0).collect() == [("SUPPLIER0000012347",)]


def test_words_of_a_file_of_one_row_group_are_read_by_many_tasks(spark):
    from labelforge.plans.catalog import QUERIES
    q = QUERIES["j3_fuzzy_pool_documents"](spark, "/root/testdata/sf0.001")
    assert spark.sparkContext.defaultParallelism == 1 or "hashpartitioning(doc_id" in q._jdf.queryExecution().executedPlan().toString()
