"""The registered queries and their oracle SQL belong together."""
import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_phrases_of_whole_benchmark_texts(spark, tmp_path):
    spark.createDataFrame([(1, "red ring blue gear green")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a blue gear green b"), (2, "x gear y"), (3, "red ring")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    assert dict(map(tuple, q["s7_longest_span_names"](spark, str(tmp_path)).collect())) == {1: "BLUE GEAR GREEN", 2: "GEAR", 3: "RED RING"}
    got = {(r.doc_id, r.phrase) for r in q["m5_find_phrases"](spark, str(tmp_path)).collect()}
    assert (1, "blue gear green") in got and (1, "gear green") in got
    assert {r.doc_id for r in q["c1_extract_claims"](spark, str(tmp_path)).collect()} == {1, 3}


def test_words_and_grams_without_limits(spark, tmp_path):
    spark.createDataFrame([(1, "hound ring aßb cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "hound rings assb cat")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    got = {tuple(r) for r in q["m3_similar_pairs"](spark, str(tmp_path)).select("left_key", "right_key", "sim").collect()}
    assert got == {("rings", "ring", 0.8), ("cat", "cat", 1.0), ("hound", "hound", 1.0)}
    assert q["g8_word_windows"](spark, str(tmp_path)).count() == 5
    assert ("assb", "aßb") in {(r.text, r.name) for r in q["j9_nearest_name_documents"](spark, str(tmp_path)).collect()}
