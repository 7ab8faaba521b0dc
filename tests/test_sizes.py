"""What must not depend on how small the input looks before a run."""
import random

from pyspark.sql import functions as F

from labelforge.operators import evaluate as E, matching as M, ocr as O, products as P
from labelforge.plans import catalog
from labelforge.plans.ocr_queries import stream


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reference_lookup_broadcasts_no_products(spark):
    p = spark.createDataFrame([(f"{c:04d}", n, "b", None) for c, n in enumerate(["red ring", "old ring", "hot bolt"] * 9)], "code string, name string, brands string, ingredients_text string")
    q = spark.createDataFrame([("n", "", "Ring"), ("c", "0003", "")], "query_id string, barcode string, q string")
    r = P.reference_lookup(q, p)
    assert "Broadcast" not in plan(r)
    assert [(x.query_id, x.rank, x.code) for x in r.orderBy("query_id", "rank").collect()] == [("c", 1, "0003")] + [("n", k + 1, c) for k, c in enumerate(["0000", "0001", "0003", "0004", "0006", "0007"])]


def test_readings_meet_without_broadcast_and_by_every_path(spark):
    keys = [(photo, "".join(random.choice("AB") for _ in range(random.randint(1, 9)))) for photo in (1, 1, 1, 2) for _ in range(12)]
    d = spark.createDataFrame(sorted(set(keys)), "photo_id int, k string")
    want = {(p, a, b, round(1 - near(a, b) / max(len(a), len(b)), 6)) for p, a in keys for o, b in keys if p == o and 1 - near(a, b) / max(len(a), len(b)) >= 0.7}
    for most in (0, 150, 1 << 14):  # by segments, by both, pair by pair
        r = M.similar_pairs(d, d, 0.7, ["photo_id"], most)
        assert "Broadcast" not in plan(r)
        assert {(x.photo_id, x.left_key, x.right_key, round(x.sim, 6)) for x in r.collect()} == want
    pairs = r.where("left_key < right_key").select("photo_id", F.col("left_key").alias("better"), F.col("right_key").alias("worse"))
    kept = [sorted(map(tuple, O.greedy_keep(pairs, ["photo_id"], most).select("photo_id", "worse", "better").collect())) for most in (0, 40, 1 << 17)]
    assert kept[0] == kept[1] == kept[2] and kept[0]
    assert {(p, w) for p, w, _ in kept[0]}.isdisjoint({(p, b) for p, _, b in kept[0]})


def test_settling_readings_takes_one_pass(spark):
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(30)], "photo_id int, better int, worse int")
    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = sorted(map(tuple, O.greedy_keep(chain, ["photo_id"]).collect()))
    n = jobs()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(1, i + 1, i) for i in range(0, 30, 2)] and n < 15


def test_noisy_distance_broadcasts_no_names(spark):
    assert "Broadcast" not in plan(catalog.QUERIES["e4_noisy_distance"](spark, "/root/testdata/sf0.001"))


def test_labels_are_judged_alike_by_every_path(spark, monkeypatch):
    word = lambda: "".join(random.choice("AB") for _ in range(random.randint(5, 9)))
    t = spark.createDataFrame([(label, i, word()) for label in (1, 2) for i in range(12)] + [(3, 0, None)], "label_id int, ord int, raw string")
    i = spark.createDataFrame([(label, i, word()) for label in (1, 2) for i in range(9 * label)], "label_id int, idx int, raw string")
    a, b = (d.select("label_id", F.col("raw").alias(c)).where("raw IS NOT NULL").distinct() for d, c in ((t, "n"), (i, "e")))
    pairs = M.block_pairs
    got = []
    for most in (0, 120, 1 << 14):
        monkeypatch.setattr(E, "block_pairs", lambda l, r, by, most=most: pairs(l, r, by, most))
        r, h = E.match_truth(t, i), E.holding(a, b, "label_id", [1, 2, 3, 4]).unionByName(E.holding(a, b, "label_id", [6]))
        assert "Broadcast" not in plan(r) + plan(h)
        got.append((sorted(map(str, r.collect())), sorted(map(str, h.collect()))))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 25 and got[0][1]


def test_a_table_streams_from_one_file_or_a_folder(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/d/conversations.parquet")
    for n, d in enumerate(("/root/testdata/sf0.001", f"{tmp_path}/d")):
        seen = []
        stream(spark, d, "conversations").writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/state{n}").trigger(availableNow=True).start().awaitTermination()
        assert sum(seen) == whole.count()


def test_claims_meet_a_labels_items_by_the_label_alone(spark, tmp_path):
    """Claims with all that is known of their label are not shuffled again by family and by claim."""
    from labelforge.operators.claims import check_claims
    items = spark.createDataFrame([(1, 0, "red ring", "resolved", "RED RING", None, False, "resolved"), (1, 1, "oil", "resolved", "OIL", None, False, "resolved"), (1, 2, "x", "not_found", None, None, False, "none"),
                                   (2, 0, "oil", "resolved", "OIL", None, False, "resolved")], "label_id int, idx int, raw string, status string, inci string, category string, optional boolean, via string")
    hits = spark.createDataFrame([("RED RING", "metal"), ("RED RING", "metal"), ("OIL", "fat")], "inci string, family_id string")
    rules = spark.createDataFrame([("m", "family", "metal", None, None), ("n", "family", None, None, None), ("o", "ingredient", None, ["Oil"], ["^red"])], "claim_id string, logic string, family_id string, inci array<string>, patterns array<string>")
    det = spark.createDataFrame([(1, "m", "free_from"), (1, "n", "free_from"), (1, "o", "ingredient"), (2, "m", "free_from"), (2, "o", "ingredient"), (3, "o", "ingredient"), (2, "zz", "ingredient")], "label_id int, claim_id string, kind string")
    q = check_claims(det, items, hits, rules)
    got = {(r["label_id"], r["claim_id"]): (r["outcome"], r["items"], r["names"]) for r in q.collect()}
    assert got == {(1, "m"): ("family.member", [0], "Red Ring"), (1, "n"): ("family.none", [], ""), (1, "o"): ("ingredient.named", [0, 1], "Red Ring, Oil"),
                   (2, "m"): ("family.none", [], ""), (2, "o"): ("ingredient.named", [0], "Oil"), (3, "o"): ("ingredient.missing", [], ""), (2, "zz"): ("ingredient.missing", [], "")}
    assert not [x for x in plan(q).split("hashpartitioning(")[1:] if x.startswith("label_id") and ("claim_id" in x.split(")")[0] or "family_id" in x.split(")")[0])]


def test_trimmed_segments_are_made_once(spark):
    s = spark.createDataFrame([("a", [("zxqv", 20.0), ("red", 50.0), ("ring", 50.0)]), ("b", [("red", 50.0), ("ring", 50.0)]), ("c", [])], "seg_id string, words array<struct<text:string,confidence:double>>")
    q = O.trim_junk_prefix(s, spark.createDataFrame([("RED RING",), ("RED",)], "inci_name string"))
    assert {tuple(r) for r in q.where("seg_id <> 'a'").collect()} == {("b", 0, "red ring"), ("c", 0, "")} and q.count() == 3
    assert "posexplode" not in plan(q)


def test_reaction_products_meet_once_by_ingredient(spark):
    """Rows of no pattern are not made distinct and joined back by the pattern's label."""
    rng = random.Random(4)
    names = ["Red Ring", "red ring", "Oil", "Hot-Bolt", "bolt", "--", None]
    p = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)]), rng.choice(["P1", "P2", None]), rng.choices(names, k=rng.randint(0, 4))) for _ in range(90)], "user_id int, product_id int, name string, ingredients array<string>")
    r = spark.createDataFrame([(u, i) for u in (None, 1, 2) for i in (None, 1, 2, 4, 4, 77)] + [(3, 1)], "user_id int, product_id int")
    m = spark.createDataFrame([("metal", "RED RING", []), ("metal", "bolt", []), ("fat", "OIL", []), (None, "OIL", []), ("fat", "hot bolt", ["Oil"])], "family_id string, inci string, aliases array<string>")
    q = P.reaction_pattern_products(p, r, m)
    found = P.reaction_patterns(p, r, m).select("user_id", "kind", "label")
    x = p.join(r.distinct().withColumn("reacted", F.lit(True)), ["user_id", "product_id"], "left").na.fill(False, ["reacted"]).select("*", F.explode("ingredients").alias("inci")).withColumn("key", F.regexp_replace(F.upper("inci"), "[^A-Z0-9]", ""))
    of = spark.createDataFrame([("REDRING", "metal"), ("BOLT", "metal"), ("OIL", "fat"), ("HOTBOLT", "fat")], "key string, family_id string")
    title = F.initcap(F.replace(F.lower("inci"), F.lit("-"), F.lit("- ")))
    rows = (x.withColumn("label", F.replace(title, F.lit("- "), F.lit("-"))).select("user_id", F.lit("ingredient").alias("kind"), "label", "product_id", "name", "reacted")
            .union(x.join(of, "key").select("user_id", F.lit("family").alias("kind"), "family_id", "product_id", "name", "reacted")))
    want = sorted(map(str, rows.distinct().join(found, ["user_id", "kind", "label"], "left_semi").collect()))
    assert sorted(map(str, q.collect())) == want and {k for k in ("ingredient", "family") if any(k in w for w in want)} == {"ingredient", "family"}
    assert "hashpartitioning(user_id" in plan(q) and not [e for e in plan(q).split("hashpartitioning(")[1:] if "label" in e.split(")")[0]]
