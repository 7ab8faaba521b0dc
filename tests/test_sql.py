"""Registered SQL functions against the column functions."""
import random

from labelforge.functions import similarity as S, text as X
from labelforge.operators import segment
from labelforge.sql import register

TEXTS = ["Ingredients: Aqua, Glycerin (and) Parfum 2.5%*, CI 77891 (nano). May contain: Mica; Talc***", "INCI: a (b, c [d; e]), f)g,h", "MRP: Rs. 5. Batch x, Water.  Next One", "", None, " . ,; ",
         "so-\n dium chlo\r\nride • zinc· oxide、x", "ﬁne ½ – 3 %", "+/- mica, ± talc", "é, Ñ x y , 　z"]


def test_segment_label(spark):
    register(spark)
    random.seed(3)
    parts = ["Aqua", ", ", "; ", "(", ")", "[", "]", " (and) ", ". ", "May contain: ", " 5%", "***", " (nano)", "EXP 01/27", "+/-", "-\n", "\n", "  ", "X"]
    texts = TEXTS + ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "label_id int, raw string")
    want = segment.segment_labels(d.selectExpr("label_id", "0 AS source_index", "raw"), one_source=True)
    got = spark.sql("SELECT d.label_id, s.position, s.raw, s.optional, s.tags FROM {d} d, LATERAL segment_label(d.raw) s", d=d)
    names = ["label_id", "position", "raw", "optional", "tags"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_scalar_functions(spark):
    register(spark)
    register(spark)
    d = spark.createDataFrame([(t,) for t in TEXTS if t is not None] + [("butylene-glycol (x)/y\tz",), (None,)], "s string")
    got = spark.sql("SELECT s, match_key(s), title_case(s) FROM {d}", d=d).collect()
    want = d.select("s", X.match_key(d["s"]), X.title_case(d["s"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    r = spark.sql("SELECT indel_ratio('GLYCERIN', 'GLYCERINE') AS a, confusion_score('G1YCERIN', 'GLYCERIN') AS b").first()
    assert abs(r["a"] - S.indel_ratio_one("GLYCERIN", "GLYCERINE")) < 1e-9 and 0.9 < r["b"] < 1
