"""Readers and stores on small files."""
import json

import pytest
from pyspark.sql import functions as F

from labelforge.operators.dictionary import quality_gate
from labelforge.sources import store, tables


def test_seed_and_catalogue(spark, tmp_path):
    p = tmp_path / "seed.csv"
    p.write_text("# comment\ninci_name|category|aliases\nAQUA||WATER:common_name;A:B:trade_name\nPARFUM|fragrance|\n")
    rows, al = tables.read_seed_names(spark, str(p))
    assert {(r.inci_name, r.category) for r in rows.collect()} == {("AQUA", None), ("PARFUM", "fragrance")}
    assert {(r.alias, r.kind) for r in al.collect()} == {("WATER", "common_name"), ("A:B", "trade_name")}
    c = tmp_path / "cat.csv"
    c.write_text("INCI name;CAS No;Extra\nAqua;7732-18-5;x\n;1;y\n")
    assert [tuple(r) for r in tables.read_catalogue_csv(spark, str(c)).collect()] == [("Aqua", "7732-18-5")]
    c.write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="Headers found"):
        tables.read_catalogue_csv(spark, str(c))


def test_truth_and_claims(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text(json.dumps({"id": "x", "raw_ingredients": "A, B", "other_fields": {"mrp": "MRP Rs. 5"}, "expected": [{"raw": "A", "inci": "AQUA"}], "expected_removed": [{"raw": "MRP", "reason": "price"}]}, indent=1))
    labels, truth, removed = tables.read_truth(spark, str(f))
    assert [tuple(r) for r in labels.orderBy("source_index").collect()] == [("x", 0, "A, B"), ("x", 1, "MRP Rs. 5")]
    assert truth.count() == 1 and removed.count() == 1
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"free_from": [{"id": "f", "label": "F", "logic": "family", "family": "fam", "phrases": ["a", "b"]}], "ingredient_claims": [{"id": "i", "label": "I", "terms": ["t"], "inci": ["N"], "inci_patterns": []}], "unverifiable": [{"id": "u", "label": "U", "phrases": ["p"]}]}))
    ph, rules = tables.read_claims(spark, str(c))
    assert ph.count() == 4 and {r.claim_id for r in rules.collect()} == {"f", "i"}


def test_bucket_tables(spark, tmp_path):
    path = str(tmp_path / "products")
    rows = lambda xs: spark.createDataFrame(xs, "user_id long, product_id long, v long")
    store.write_buckets(spark, store.with_bucket(rows([(1, 1, 1), (2, 1, 1), (3, 1, 1)])), path)
    store.upsert_table(spark, path, rows([(1, 1, 5), (2, 2, 1)]), ["user_id", "product_id"], "v")
    read = lambda: sorted((r.user_id, r.product_id, r.v) for r in spark.read.parquet(path).collect())
    assert read() == [(1, 1, 5), (2, 1, 1), (2, 2, 1), (3, 1, 1)]
    store.forget_in_table(spark, path, rows([(2, 0, 0)]).select("user_id"))
    assert read() == [(1, 1, 5), (3, 1, 1)]


def test_quality_gate(spark):
    n = spark.createDataFrame([("A",)], "inci_name string")
    assert quality_gate(n, allow_small=True).first().ok
    with pytest.raises(Exception, match="too small"):
        quality_gate(n).collect()
