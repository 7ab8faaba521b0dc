"""Cleaning and cutting of label texts: the cheap searches decide as the stated patterns do, and a text is cleaned once per use."""
import random
import re

from pyspark.sql import functions as F

from labelforge.functions import text as X
from labelforge.operators import segment as S


def test_blanks_and_dots_as_the_patterns_say(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(" .\t\na-é\x0b(", k=rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", X.strip(F.col("s")).alias("a"), S._trim_dots(F.col("s")).alias("b")).collect()
    blank = "[ \t\n\x0b\f\r]"
    for s, a, b in rows:
        assert a == re.sub(rf"^{blank}+|{blank}+\Z", "", s)
        head = re.sub(rf"^{blank}*\.*{blank}*", "", s)
        assert b == re.sub(rf"{blank}*\.*{blank}*\Z", "", head, count=1), s


def test_a_label_is_not_cleaned_three_times(spark):
    labels = spark.range(3).select(F.col("id").alias("label_id"), F.lit(0).alias("source_index"), F.concat(F.lit("INCI: a, b (c, d) "), F.col("id").cast("string")).alias("raw"))
    segs = S.segment_labels(labels, True)
    plan = segs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ingredientes") <= 2
    assert [r["raw"] for r in segs.where("label_id = 1").orderBy("position").collect()] == ["a", "b (c, d) 1"]


def test_a_documents_windows_are_counted_where_it_is(spark, tmp_path):
    """One shuffle of the texts and one of the grams' counts, none of a row per gram and document; rows that share an id are one document."""
    from labelforge.operators import segment as S
    from labelforge.plans.catalog import QUERIES
    from pyspark.sql import functions as F
    rows = [(1, "a b c a b"), (1, "a b"), (2, " a  b\n"), (3, "x"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    q = QUERIES["g8_word_windows"](spark, str(tmp_path))
    assert {tuple(r) for r in q.collect()} == {("a b", 4, 2), ("b c", 1, 1), ("c a", 1, 1), ("a b c", 1, 1), ("b c a", 1, 1), ("c a b", 1, 1)}
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    ws = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c", "d"],), (None,)], "w array<string>")
    for lo, hi in ((1, 1), (2, 3), (1, 4)):
        got = ws.select(S.window_texts(F.col("w"), lo, hi).alias("t"), F.transform(S.word_windows(F.col("w"), lo, hi), lambda x: x["text"]).alias("u")).collect()
        assert all((r["t"] or []) == (r["u"] or []) for r in got)


def test_a_line_is_searched_once_for_each_form_of_a_date(spark):
    from labelforge.functions.pack import date_in_line
    from pyspark.sql import functions as F
    t = spark.createDataFrame([("EXP 04/29 use before 05/30",), ("Mfg. 31-12-24?",), ("bb 5.13.2026",), ("best before Sept. 2027",), ("use by 7",), (None,)], "s string")
    q = t.select(date_in_line(F.col("s"), F.lit(False), F.lit(False)).alias("d"))
    assert q._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 5  # the label, three forms and a year
    got = [r["d"] and tuple(r["d"])[:6] + (r["d"]["needs_confirm"],) for r in q.collect()]
    assert got == [("expiry", "04/29", None, 4, 2029, "MM/YY", False), ("mfg", "31-12-24", 31, 12, 2024, "DD/MM/YY", True), ("expiry", "5.13.2026", 13, 5, 2026, "DD/MM/YY", True),
                   ("expiry", "Sept. 2027", None, 9, 2027, "MON YYYY", False), None, None]
