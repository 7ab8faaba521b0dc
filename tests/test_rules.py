"""Hand-worked cases of rules, review and products where a cut or a wrong drop would show."""
import random

from pyspark.sql import functions as F

from labelforge.operators import matching as M, products as P, review, rules


def test_avoid_cap_and_role_notes(spark):
    ids = spark.createDataFrame([("l", "u", 0, "BENZYL ALCOHOL")], "label_id string, user_id string, idx int, inci string")
    hits = spark.createDataFrame([("BENZYL ALCOHOL", "allergens", "BENZYL ALCOHOL", "name"), ("BENZYL ALCOHOL", "solvents", "BENZYL ALCOHOL", "name")], "inci string, family_id string, member string, via string")
    members = spark.createDataFrame([("allergens", "BENZYL ALCOHOL", None, "caution", "allergen note"), ("solvents", "BENZYL ALCOHOL", None, "note", "solvent note")],
                                    "family_id string, inci string, aliases array<string>, cap_tier string, role_note string")
    avoid = spark.createDataFrame([("u", "own", "ingredient", None, ["BENZYLALCOHOL"], [], "doctor"), ("u", "fam", "family", "solvents", [], [], "doctor"), ("u", "said", "family", "solvents", [], ["BENZYLALCOHOL"], "doctor")],
                                  "user_id string, entry_id string, kind string, family_id string, keys array<string>, specific_keys array<string>, strength string")
    found = rules.avoid_matches(ids, hits, avoid, members)
    got = {r.entry_id: (r.tier, r.capped, r.carried) for r in found.collect()}
    assert got == {"own": ("caution", True, "allergen note"), "fam": ("note", True, "solvent note"), "said": ("avoid", False, None)}
    only = found.where("entry_id = 'fam'")
    assert [r.note for r in rules.role_notes(ids, hits, members, only).collect()] == ["allergen note"]
    assert sorted(r.note for r in rules.role_notes(ids, hits, members, found.where("entry_id = 'said'")).collect()) == ["allergen note", "solvent note"]


def test_review_queue_keeps_ai_suggestions(spark):
    c = lambda *xs: [(n, s) for n, s in xs]
    items = spark.createDataFrame([
        ("l", 0, "a", "suggested", c(("D1", "dictionary"), ("D2", "dictionary"), ("D3", "dictionary"), ("A1", "ai_agent"), ("A2", "ai_agent")), False, "none", True),
        ("l", 1, "b", "suggested", c(("D1", "dictionary"), ("D2", "dictionary"), ("D3", "dictionary"), ("D4", "dictionary")), False, "none", True)],
        "label_id string, idx int, raw string, status string, candidates array<struct<inci_name:string,source:string>>, optional boolean, via string, high_confidence boolean")
    q = review.review_queue(items)
    got = {r.idx: ([x["inci_name"] for x in r.candidates], r.bulk) for r in q.collect()}
    assert got == {0: (["D1", "A1", "A2"], False), 1: (["D1", "D2", "D3"], True)}
    assert [(r.key, r.value) for r in review.bulk_accept(q).collect()] == [("B", "D1")]


def test_more_than_three_proposals_void_the_answer(spark):
    p = spark.createDataFrame([("s", i, f"NAME {i}", ["t"], "r") for i in range(4)] + [("k", 0, "NAME 0", ["t"], "r")], "session_id string, ord int, inci_name string, evidence_ids array<string>, rationale string")
    e = spark.createDataFrame([(s, "t", f"NAME{i}", f"NAME {i}", "dictionary", None) for s in ("s", "k") for i in range(4)], "session_id string, tool_call_id string, key string, display string, source string, source_id string")
    assert [(r.session_id, r.inci_name) for r in review.supported_proposals(p, e).collect()] == [("k", "NAME 0")]


def test_routines_of_any_size(spark):
    p = spark.createDataFrame([("u", i, f"P{i}", "cream", "am", ["RETINOL"], []) for i in range(9)] + [("v", 1, "P", "cream", "am", ["RETINOL"], [])],
                              "user_id string, product_id int, name string, type string, when string, ingredients array<string>, unresolved array<string>")
    a = P.product_actives(P.routine_gate(p, ["user_id"]), spark.createDataFrame([("retinoid", "Retinol")], "class_id string, member string"), ["user_id"])
    assert [(r.user_id, r.n_products) for r in P.duplicate_actives(a, ["user_id"])[0].collect()] == [("u", 9)]


def test_lookup_inside_names_and_long_names(spark):
    products = spark.createDataFrame([("1", "Face Cream", "b", None), ("2", "Body Lotion", "b", None)], "code string, name string, brands string, ingredients_text string")
    q = spark.createDataFrame([("x", "", "crea"), ("y", "", "O"), ("z", "", "zz")], "query_id string, barcode string, q string")
    assert sorted((r.query_id, r.code) for r in P.reference_lookup(q, products).collect()) == [("x", "1"), ("y", "2")]
    long = "POLYGLYCERYL-3 METHYLGLUCOSE DISTEARATE CROSSPOLYMER OF SOMETHING RATHER LONG"
    snap = spark.createDataFrame([(1, long + "S", None)], "cid long, name string, cas string")
    got = M.compound_lookup(spark.createDataFrame([(long,)], "text string"), snap).select("status", F.get("names", F.lit(0)).alias("n")).first()
    assert tuple(got) == ("ambiguous", long + "S")


def test_alternatives_among_all_products_of_a_user(spark):
    r = random.Random(3)
    held = [(u, 100 * u + i, [f"I{x}" for x in r.sample(range(12), r.randint(0, 8))]) for u, n in ((1, 15), (2, 6), (3, 1)) for i in range(n)]
    bad = {i for _, i, _ in held if i % 4 == 0}
    p = spark.createDataFrame(held, "user_id int, product_id int, ingredients array<string>")
    ranked, stats = P.saved_alternatives(p, spark.createDataFrame([(i,) for i in bad], "cand_id int"))
    best, counts = set(), {}
    for u, i, a in held:
        others = [(j, set(a) & set(b), set(a) | set(b)) for v, j, b in held if v == u and j != i]
        good = sorted((-len(x) / len(y), j, len(x)) for j, x, y in others if j not in bad and len(x) >= 3)
        best |= {(i, k, j, n) for k, (_, j, n) in enumerate(good[:5], 1)}
        if others:
            counts[i] = (sum(j in bad for j, *_ in others), sum(j not in bad and len(x) < 3 for j, x, _ in others))
    assert {(x.base_id, x.rank, x.cand_id, x.n_shared) for x in ranked.collect()} == best
    assert {x.base_id: (x.excluded, x.too_few) for x in stats.collect()} == counts


def test_products_behind_a_reaction_pattern(spark):
    p = spark.createDataFrame([(1, 1, "a", ["PARFUM", "AQUA"]), (1, 2, "b", ["Parfum", "MICA"]), (1, 3, "c", ["PARFUM", "PARFUM"]), (1, 4, "d", ["MICA"]), (2, 5, "e", ["PARFUM"])],
                              "user_id int, product_id int, name string, ingredients array<string>")
    r = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "user_id int, product_id int")
    got = sorted(tuple(x) for x in P.reaction_pattern_products(p, r).select("user_id", "kind", "label", "name", "reacted").collect())
    assert got == [(1, "ingredient", "Parfum", "a", True), (1, "ingredient", "Parfum", "b", True), (1, "ingredient", "Parfum", "c", False)]
