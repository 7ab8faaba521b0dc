"""Top-level splitting in one pass against a plain walk."""
import random
import time

from labelforge.operators import segment as S


def walk(text, opens, closes):
    depth, out = 0, [""]
    for c in text:
        if c in opens:
            depth += 1
        elif c in closes:
            depth = max(0, depth - 1)
        if c in ",;" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def test_against_a_walk(spark):
    random.seed(4)
    texts = ["".join(random.choice("ab,;()[]é\U0001F600 ") for _ in range(random.randint(0, 40))) for _ in range(400)] + ["", ",", "(", ")", "a)b,(c", None]
    for square, opens, closes in ((True, "([", ")]"), (False, "(", ")")):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
        got = {r["i"]: r["p"] for r in df.select("i", S.split_top_level(df["s"], square).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [None if t is None else walk(t, opens, closes) for t in texts]


def test_long_text_is_one_pass():
    text = ", ".join(f"word {i} (a, [b; c])" for i in range(10_000))
    start = time.time()
    assert S._mark(text, "([", ")]").count("\u0001") == 9_999
    assert time.time() - start < 0.5
