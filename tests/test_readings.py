"""Hand-worked cases of the reading operators that have no SQL oracle."""
import random

from labelforge.operators import evaluate as E, ocr as O


def test_word_recall(spark):
    p = spark.createDataFrame([(1, "SODIUM BENZOATE aqua SODIUM", "sodlum xx BENZOATE"), (2, "aqua", "zzzz")], "photo_id int, truth string, ocr string")
    got = {r.photo_id: (r.words, r.found) for r in E.word_recall(p).collect()}
    assert got == {1: (4, 3), 2: (1, 0)}


def test_trim_junk_prefix(spark):
    w = lambda *xs: [(t, float(c)) for t, c in xs]
    s = spark.createDataFrame([("junk", w(("zxqv", 20), ("CETYL", 90), ("ALCOHOL", 90))), ("sure", w(("zxqv", 90), ("CETYL", 90), ("ALCOHOL", 90))), ("clean", w(("CETYL", 40), ("ALCOHOL", 40)))],
                              "seg_id string, words array<struct<text:string,confidence:double>>")
    names = spark.createDataFrame([("CETYL ALCOHOL",)], "inci_name string")
    got = {r.seg_id: (r.dropped, r.text) for r in O.trim_junk_prefix(s, names).collect()}
    assert got["junk"] == (1, "CETYL ALCOHOL") and got["sure"] == (0, "zxqv CETYL ALCOHOL")
    assert got["clean"] == (0, "CETYL ALCOHOL")


def test_consensus_keeps_better_reading(spark):
    rows = [(1, "a", 0, "AQUA", 80.0, "AQUA", 1.0), (1, "a", 1, "GLYCRN", 60.0, "GLYCERIN", 0.75), (1, "b", 0, "AQUA", 70.0, "AQUA", 1.0), (1, "b", 1, "GLYCERIN", 70.0, "GLYCERIN", 1.0),
            (1, "a", 2, "qzx wvy", 30.0, None, 0.0), (1, "a", 3, "PARFUM", 70.0, "PARFUM", 1.0)]
    r = spark.createDataFrame(rows, "photo_id int, pass_id string, idx int, text string, conf double, name string, sim double")
    got = {x.name: (x.text, x.from_, x.votes) for x in O.consensus(r).collect()}
    assert got == {"AQUA": ("AQUA", "base", 2), "GLYCERIN": ("GLYCERIN", "better", 2), "PARFUM": ("PARFUM", "base", 1)}


def test_stitch_leaves_no_gap_and_nothing_twice(spark):
    a = spark.createDataFrame([("p", i, f"item {w}", 80.0) for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf".split())], "product_id string, i int, text string, conf double")
    b = spark.createDataFrame([("p", i, f"item {w}", 90.0) for i, w in enumerate("bravo charlie echo foxtrot golf hotel".split())], "product_id string, i int, text string, conf double")
    got = [(r.text.split()[1], r.side) for r in O.stitch_overlaps(a, b).orderBy("ord").collect()]
    assert got == [("alpha", "a"), ("bravo", "both"), ("charlie", "both"), ("delta", "a"), ("echo", "both"), ("foxtrot", "both"), ("golf", "both"), ("hotel", "b")]


def test_only_a_kept_reading_drops_another(spark):
    p = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("g", 1, 2)], "photo_id string, better int, worse int")
    assert sorted(map(tuple, O.greedy_keep(p, ["photo_id"]).select("photo_id", "worse", "better").collect())) == [("f", 2, 1), ("g", 2, 1)]


def test_word_recall_of_empty_photos(spark):
    p = spark.createDataFrame([("a", "glycerin aqua", None), ("b", "of to", "glycerin"), ("c", "glycerin", "glycerine")], "photo_id string, truth string, ocr string")
    assert {r.photo_id: r.recall for r in E.word_recall(p).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_stitching_in_a_task_equals_joins(spark):
    """Lists that a task joins and lists that go by joins give the same rows."""
    r = random.Random(5)
    words = ["Aqua", "Glycerin", "Glycer1n", "Panthenol", "Cetyl Alcohol", "Cetyl Alc0hol", "Mica", "", "Talc"]
    mk = lambda seed: [(p, i, r.choice(words), float(r.choice([40, 60, 80])) if r.random() < 0.9 else None) for p in range(60) for i in range(r.randint(0, 6))]
    s = "product_id int, i int, text string, conf double"
    a, b = spark.createDataFrame(mk(1), s), spark.createDataFrame(mk(2), s)
    rows = lambda d: sorted(map(repr, d.collect()))
    got = rows(O.stitch_overlaps(a, b))
    assert got == rows(O.stitch_overlaps(a, b, most=0)) and "overlap=True" in "".join(got)


def test_word_recall_in_a_row_equals_joins(spark):
    """Photos compared in their row and photos left to joins give the same counts, also where a photo has several rows."""
    r = random.Random(3)
    words = ["glycerin", "glycerln", "aqua", "panthenol", "panthen0l", "panthnol", "mica", "cetyl", "cety", "of"]
    some = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 7)))
    p = spark.createDataFrame([(r.choice([None, *range(25)]), some(), r.choice([None, some(), some()])) for _ in range(60)], "photo_id int, truth string, ocr string")
    rows = lambda **how: sorted(map(repr, E.word_recall(p, **how).collect()))
    assert rows() == rows(most=0) == rows(most=6) and len(set(rows())) > 10
