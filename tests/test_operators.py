"""Edge cases and joins against brute force."""
import random

from pyspark.sql import functions as F

from labelforge.functions import pack as P, text as X
from labelforge.operators import curate, matching as M, ocr, segment as S
from labelforge.operators.dictionary import build_dictionary
from labelforge.streaming import jobs


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def strings(spark, xs, name="s"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} string")


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_split_clamps_and_blends(spark):
    got = one(strings(spark, ["a), b", "A (x, y [z, w]), B; C", "open (a, b"]), S.split_top_level(F.col("s")))
    assert got == [["a)", " b"], ["A (x, y [z, w])", " B", " C"], ["open (a, b"]]
    lab = spark.createDataFrame([("l", 0, "A (and) B (and) C - 1.0%**, May contain: D")], "label_id string, source_index int, raw string")
    rows = S.segment_labels(lab).orderBy("position").collect()
    assert [(r.raw, r.optional, r.tags) for r in rows] == [("A", False, []), ("B", False, []), ("C", False, ["label_percent=1.0"]), ("D", True, [])]


def test_nfkc_keys(spark):
    assert one(strings(spark, ["ﬁne ｍica", "Crème", "a²"]), X.match_key(F.col("s"))) == ["FINEMICA", "CRME", "A2"]


def test_dates(spark):
    got = one(strings(spark, ["EXP 13/25", "use before 04/29 (partially occluded)", "exp 05/13/26", "Mfg. Date 01/26", "no label 01/26"]), P.date_in_line(F.col("s"), F.lit(False), F.lit(False)))
    assert got[0] is None and got[4] is None
    assert (got[1].month, got[1].year, got[1].confidence, got[1].needs_confirm) == (4, 2029, "low", True)
    assert (got[2].day, got[2].month, got[2].order_unclear) == (13, 5, True) and got[3].kind == "mfg"
    d = spark.sql("SELECT DATE'2025-01-31' AS d").select(P.add_months_overflow(F.col("d"), F.lit(1))).first()[0]
    assert str(d) == "2025-03-03"


def test_price(spark):
    p = one(strings(spark, ["MRP Rs. 789.00 (Rs.6.69/ml), 100 ml", "nothing"]), P.parse_price(F.col("s")))
    assert (p[0].mrp, p[0].volume_ml, p[0].per_unit_printed) == (789.0, 100.0, 6.69) and p[1].mrp is None


def test_similar_pairs_is_exact(spark):
    r = random.Random(1)
    a = {"".join(r.choice("ABC") for _ in range(r.randint(1, 11))) for _ in range(120)}
    b = {"".join(r.choice("ABC") for _ in range(r.randint(1, 11))) for _ in range(120)}
    for s in (0.75, 0.6):
        got = {(x.left_key, x.right_key) for x in M.similar_pairs(strings(spark, a, "k"), strings(spark, b, "k"), s).collect()}
        assert got == {(x, y) for x in a for y in b if 1 - lev(x, y) / max(len(x), len(y)) >= s - 1e-12}


def test_one_edit(spark):
    got = {tuple(x) for x in M.one_edit_neighbours(strings(spark, ["wrold", "wold", "worlds", "word", "xyz"], "word"), strings(spark, ["world"], "v")).collect()}
    assert got == {("wrold", "world"), ("worlds", "world"), ("word", "world"), ("wold", "world")}


def test_blocks_equal_one_dictionary(spark):
    r = random.Random(2)
    names = {"".join(r.choice("ABCDE") for _ in range(r.randint(4, 9))) for _ in range(60)}
    k = strings(spark, {"".join(r.choice("ABCDE") for _ in range(6)) for _ in range(15)}, "key")
    n = strings(spark, names, "key")
    a = sorted(map(tuple, M.name_pool(k, n, limit=6).collect()))
    assert a == sorted(map(tuple, M.name_pool(k, n, limit=6, block=20).collect()))


def test_longest_spans(spark):
    t = spark.createDataFrame([(1, "Sodium Chloride - Zinc Oxide"), (2, "zinc oxide"), (3, "zinc, sodium chloride water")], "id int, cell string")
    got = dict(map(tuple, curate.longest_span_names(t, strings(spark, ["SODIUM CHLORIDE", "ZINC", "ZINC OXIDE", "CHLORIDE"], "name")).collect()))
    assert got == {1: ["SODIUM CHLORIDE", "ZINC OXIDE"], 2: ["ZINC OXIDE"], 3: ["ZINC", "SODIUM CHLORIDE"]}


def test_alias_override(spark):
    names = spark.createDataFrame([("AQUA", 0), ("WATER", 1)], "inci_name string, ord int")
    al = spark.createDataFrame([("AQUA", "WATER", "common_name", 0)], "inci_name string, alias string, kind string, ord int")
    got = {r.key: r.inci_name for r in build_dictionary(names, al, {}).lookup.collect()}
    assert got == {"AQUA": "AQUA", "WATER": "AQUA"}


def test_stitch_and_negative_control(spark):
    mk = lambda p, xs: [(p, i, x, 80.0) for i, x in enumerate(xs)]
    s = "product_id int, i int, text string, conf double"
    a = spark.createDataFrame(mk(1, ["Aqua", "Glycerin", "Panthenol", "Niacinamide"]) + mk(2, ["Aqua", "Dimethicone", "Cetyl Alcohol", "Citric Acid"]), s)
    b = spark.createDataFrame(mk(1, ["Panthenol", "Niacinamidc", "Citric Acid"]) + mk(2, ["Talc", "Dimethicone", "Mica", "Parfum", "Citric Acid"]), s)
    rows = ocr.stitch_overlaps(a, b).orderBy("product_id", "ord").collect()
    assert [r.text for r in rows if r.product_id == 1] == ["Aqua", "Glycerin", "Panthenol", "Niacinamide", "Citric Acid"]
    assert not any(r.overlap for r in rows if r.product_id == 2) and sum(r.product_id == 2 for r in rows) == 9


def test_photo_prompts(spark):
    q = spark.createDataFrame([(26.0, 0.0, 120, 900, 20), (180.0, 0.27, 200, 900, 20), (180.0, 0.66, 255, 900, 20), (180.0, 0.0, 120, 900, 6)], "b double, g double, m int, l int, t int")
    assert one(q, ocr.photo_prompts(*[F.col(c) for c in "bgmlt"])) == [["blur"], ["glare"], [], ["small"]]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 10, "A"), (1, 11, "A"), (2, 10, "A")], "user_id int, product_id int, key string").write.parquet(src)
    s = spark.readStream.schema("user_id int, product_id int, key string").parquet(src)
    out = jobs.run_to_table(jobs.reaction_alerts(s), str(tmp_path / "out"), str(tmp_path / "cp")).drop("batch").collect()
    assert [tuple(r) for r in out] == [(1, "A", 10, 11)]
