"""Folding photos of one list: hand-worked cases, and alignments against every possible one."""
import itertools
import random

from labelforge.operators import stitch as S


def test_alignment_is_best():
    random.seed(2)

    def total(steps, sim):
        return sum(S.ALONE if i is None or j is None else S.UNLIKE if sim[i][j] is None else S.MATCH * sim[i][j] for i, j in steps)

    def every(n, m):
        """All alignments with free ends, as their aligned middle parts."""
        def walk(i, j):
            yield [], i, j
            if i < n and j < m:
                for rest, a, b in walk(i + 1, j + 1):
                    yield [(i, j), *rest], a, b
            if i < n:
                for rest, a, b in walk(i + 1, j):
                    yield [(i, None), *rest], a, b
            if j < m:
                for rest, a, b in walk(i, j + 1):
                    yield [(None, j), *rest], a, b
        for i, j in itertools.product(range(n + 1), range(m + 1)):
            if i == 0 or j == 0:
                for steps, a, b in walk(i, j):
                    if a == n or b == m:
                        yield steps
    for _ in range(60):
        n, m = random.randint(0, 4), random.randint(0, 4)
        sim = [[random.choice([None, None, 0.8, 1.0]) for _ in range(m)] for _ in range(n)]
        steps = S.align(n, m, lambda i, j: sim[i][j])
        assert [i for i, _ in steps if i is not None] == list(range(n)) and [j for _, j in steps if j is not None] == list(range(m))
        best = max(total(x, sim) for x in every(n, m))

        def free(part):
            return all(i is None for i, _ in part) or all(j is None for _, j in part)
        assert abs(best - max(total(steps[a:z], sim) for a in range(len(steps) + 1) for z in range(a, len(steps) + 1) if free(steps[:a]) and free(steps[z:]))) < 1e-9


def rows(spark, photos):
    return spark.createDataFrame([(1, p, i, [(w, c) for w in t.split()]) for p, photo in enumerate(photos) for i, (t, c) in enumerate(photo)],
                                 "product_id int, photo_id int, idx int, words array<struct<text:string,confidence:double>>")


def test_three_photos(spark):
    a = [("AQUA", 90.0), ("GLYCERIN", 60.0), ("CETYL ALCOHOL", 80.0)]
    b = [("GLYCER1N", 80.0), ("CETYL ALC0HOL", 70.0), ("PARFUM", 50.0)]
    c = [("PARFUM", 90.0), ("LIMONENE", 90.0)]
    r = S.merge_photos(rows(spark, [a, b, c])).first()
    assert [x["text"] for x in r["items"]] == ["AQUA", "GLYCER1N", "CETYL ALCOHOL", "PARFUM", "PARFUM", "LIMONENE"] and r["overlaps"] == [True, False] and r["matched"] == 3
    assert [x["conflict"] for x in r["items"]] == [False, True, True, False, False, False] and r["items"][1]["photos"] == [0, 1]
    c = [("CETYL ALCOHOL", 10.0), ("MICA", 90.0), ("PARFUM", 90.0), ("LIMONENE", 90.0)]
    r = S.merge_photos(rows(spark, [a, b, c])).first()
    assert r["overlaps"] == [True, False]  # no two matches in a row
    c = [("CETYL ALCOHOL", 10.0), ("PARFUM", 90.0), ("LIMONENE", 90.0)]
    r = S.merge_photos(rows(spark, [a, b, c])).first()
    assert [x["text"] for x in r["items"]] == ["AQUA", "GLYCER1N", "CETYL ALCOHOL", "PARFUM", "LIMONENE"] and r["overlaps"] == [True, True] and r["items"][3]["photos"] == [1, 2]


def test_words_of_two_readings_are_mixed(spark):
    a = [("S0DIUM CHLORIDE", 40.0), ("ZINC OXIDE", 80.0)]
    b = [("SODIUM CHL0RIDE", 60.0), ("ZINC OXIDE", 80.0)]
    d = spark.createDataFrame([(1, 0, 0, [("SODIUM", 90.0), ("CHL0RIDE", 20.0)]), (1, 0, 1, [("ZINC", 80.0)]), (1, 1, 0, [("S0DIUM", 30.0), ("CHLORIDE", 95.0)]), (1, 1, 1, [("ZINC", 70.0)]), (2, 5, 0, [("MICA", 1.0)])],
                              "product_id int, photo_id int, idx int, words array<struct<text:string,confidence:double>>")
    got = {r["product_id"]: r for r in S.merge_photos(d).collect()}
    assert [x["text"] for x in got[1]["items"]] == ["SODIUM CHLORIDE", "ZINC"] and got[1]["items"][0]["conf"] == 92.5
    assert got[2]["overlaps"] == [] and got[2]["matched"] == 0
    r = S.merge_photos(rows(spark, [a, b])).first()
    assert r["overlaps"] == [True] and len(r["items"]) == 2
    assert S.merge_photos(d.limit(0)).count() == 0
