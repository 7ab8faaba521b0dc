"""The pipeline's stages on given tables and on a hand-made one."""
import re

import corpus_pipeline as pipe
from pyspark.sql import functions as F

from .test_operators import plain_components, plain_print

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, tmp_path):
    a = "One line stands here\nand the second one too\nwith a third line below"
    benchmark = " ".join(f"q{i}" for i in range(20))
    clean = ["the quick brown fox jumps over the lazy dog near the river bank", "a small house with many windows stands on the green hill"]
    data = [(1, a), (2, a + "\nand its own end"), (3, None), (4, "123"), (5, clean[0]), (6, clean[0]), (7, clean[1] + " " + benchmark), (8, clean[1]), (9, a)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(pipe.COLUMNS)
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left["language_id"]) == {1, 2, 5, 6, 7, 8, 9}
    assert left["line_dedup"] == {1: a, 2: "and its own end", 5: clean[0], 6: clean[0], 7: data[6][1], 8: clean[1]}
    assert set(left["near_dedup"]) == {1, 2, 5, 7, 8}
    assert set(left["decontamination"]) == {1, 2, 5, 8}
    out = pipe.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 5, 8} and all(r["n_tokens"] > 0 for r in out)


def test_run_against_plain_version(spark):
    """Line windows, components and contamination by plain loops over what language ID lets through."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    seen, kept = set(), {}
    for i, t in texts.items():
        ls, hit = t.split("\n"), set()
        for s in range(len(ls) - 2):
            w = tuple(ls[s:s + 3])
            if "".join(w).strip(" ") == "":
                continue
            if w in seen:
                hit |= {s, s + 1, s + 2}
            seen.add(w)
        rest = "\n".join(x for k, x in enumerate(ls) if k not in hit)
        if not hit or rest.strip(" \n\r\t"):
            kept[i] = rest
    label = plain_components({i: plain_print(t) for i, t in kept.items()}, 4)
    kept = {i: t for i, t in kept.items() if label[i] == i}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[s:s + 13]) for s in range(len(w) - 12)}
    clean = set()
    for i, t in kept.items():
        w, hit = words(t), set()
        for s in range(len(w) - 12):
            if tuple(w[s:s + 13]) in windows:
                hit |= set(range(s, s + 13))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert {r["doc_id"] for r in pipe.run(spark, SF).select(F.col("doc_id")).collect()} == clean
