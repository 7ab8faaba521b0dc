"""Hand-worked cases: failure causes from truth, grouped reports, alerts with a horizon."""
import datetime as dt

from labelforge.operators import evaluate as E
from labelforge.streaming import jobs


def test_causes_come_from_the_labels_truth(spark):
    truth = spark.createDataFrame([(1, 0, "Cetearyl Alcohol", "CETEARYL ALCOHOL", None), (1, 1, "Alcohol", "ALCOHOL", None), (1, 2, "Glycerin + Panthenol", "GLYCERIN", None),
                                   (1, 3, "Silk", None, "trade name"), (2, 0, "Sodium Chloride", "SODIUM CHLORIDE", None)], "label_id int, ord int, raw string, inci string, category string")
    removed = spark.createDataFrame([(1, "Shake"), (1, "--"), (2, None)], "label_id int, raw string")
    tokens = ["CETEARYL ALCOHOL", "CETEARYL ALCOHOL PANTHENOL", "Panthenol", "SILK", "GLYCERINE", "well shake it", "qqqq", "Sodium Chloride"]
    t = spark.createDataFrame([(1, x) for x in tokens] + [(1, "qqqq"), (2, "Sodium Chlorlde"), (3, "unknown label"), (1, None)], "label_id int, token string")
    got = {(r.label_id, r.token): r.causes for r in E.token_causes(t, truth, removed).collect()}
    assert len(got) == 11
    assert got[1, "CETEARYL ALCOHOL"] == ["5_unknown"]                     # 'ALCOHOL' lies in the longer name: one name, read exactly
    assert got[1, "CETEARYL ALCOHOL PANTHENOL"] == ["2_broken_merged"]      # two names
    assert got[1, "Panthenol"] == ["2_broken_merged"]                       # part of a joined entry
    assert got[1, "SILK"] == ["3_wrong_tool"] and got[1, "GLYCERINE"] == ["1_ocr_noise"]
    assert got[1, "well shake it"] == ["4_leakage"] and got[1, "qqqq"] == ["5_unknown"] and got[1, None] == ["5_unknown"]
    assert got[1, "Sodium Chloride"] == ["5_unknown"]                       # another label's name
    assert got[2, "Sodium Chlorlde"] == ["1_ocr_noise"] and got[3, "unknown label"] == ["5_unknown"]
    assert E.token_causes(t.limit(0), truth, removed).count() == 0


def test_grouped_report_levels(spark):
    o = spark.createDataFrame([("a", "inci_exact", "resolved_ok", "resolved", False), ("a", "fuzzy", "sugg_top1_ok", "suggested", True), ("b", "fuzzy", "sugg_top1_wrong", "suggested", True),
                               ("b", None, "missing", None, False)], "grp string, layer string, outcome string, status string, high_confidence boolean")
    got = {(r.level, r.name): (r.n, r.n_correct, r.false_accepts, r.missing, r.high_right, r.high_wrong) for r in E.grouped_report(o).collect()}
    assert got == {("total", None): (4, 2, 1, 1, 1, 1), ("group", "a"): (2, 2, 0, 0, 1, 0), ("group", "b"): (2, 0, 1, 1, 0, 1),
                   ("layer", "inci_exact"): (1, 1, 0, 0, 0, 0), ("layer", "fuzzy"): (2, 1, 1, 0, 1, 1)}


def test_change_report(spark):
    df = lambda rows: spark.createDataFrame(rows, "label_id int, raw string")
    labels = spark.createDataFrame([(1, "clean"), (2, "golden"), (3, "clean")], "label_id int, grp string")
    items = spark.createDataFrame([(1, True, False), (1, False, True), (1, False, True), (2, False, True)], "label_id int, merged boolean, split boolean")
    removed = df([(1, "Shake well before use"), (1, "abc"), (2, "Net wt"), (3, None)])
    expected = df([(1, "shake well"), (1, "abc"), (2, "Net Wt 50 ml"), (2, "Made in"), (3, "x")])
    missing = df([(1, "use"), (2, "Net")])
    got = {r.grp: tuple(r)[1:] for r in E.change_report(labels, items, removed, expected, missing).collect()}
    # 'abc' is too short a removed text to count; 'Net' lies in 'NETWT', which has five characters
    assert got == {"clean": (2, 3, 1, 1, 1, 1), "golden": (1, 2, 1, 1, 0, 0), None: (3, 5, 2, 2, 1, 1)}


def test_alerts_once_per_spell_over_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "user_id long, product_id long, key string, ts timestamp"
    batches = [[(1, 10, "A", day(0)), (1, 10, "A", day(1)), (2, 7, "A", day(0))],
               [(1, 11, "A", day(3)), (1, 12, "A", day(4)), (2, None, "A", day(1))],     # one alert, told once
               [(3, 1, "B", day(60))],                                                   # moves the watermark: older state goes
               [(1, 13, "A", day(70)), (2, 8, "A", day(71)), (3, 2, "B", day(72))],       # new spells of 1 and 2; 3 is alerted
               [(1, 14, "A", day(73))]]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(schema).parquet(src)
        out = jobs.run_to_table(jobs.reaction_alerts_once(s, "20 days", late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), mode="append")
    want = {(1, "A", 10, 11), (3, "B", 1, 2), (1, "A", 13, 14)}
    rows = [(r.user_id, r.key, r.first_product, r.second_product) for r in out.collect()]
    assert len(rows) == 3 and set(rows) == want
    # all rows at once give the same
    s = spark.readStream.schema(schema).parquet(src)
    once = jobs.run_to_table(jobs.reaction_alerts_once(s, "20 days", late="1 day"), str(tmp_path / "out2"), str(tmp_path / "cp2"), mode="append")
    assert {(r.user_id, r.key, r.first_product, r.second_product) for r in once.collect()} == want


def test_a_labels_tokens_meet_its_truth_in_one_row(spark):
    """One shuffle of what is known of the labels, whatever is asked; labels of many rows are judged by joins, alike."""
    import random
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randint(3, 8)))
    text = lambda: rng.choice([None, "", "--", f"glycer{rng.choice('IN')}n", " ".join(word() for _ in range(rng.randint(1, 3))), word() + "  " + word() + rng.choice(["", " MRP 5", "- x", " butter", " (nano)", " a/b/water"])])
    label = lambda: rng.choice([None, *range(9)])
    entry = lambda: rng.choice([None, word(), f"{word()} {word()}", f"{word()} + {word()} {word()}"])
    t = spark.createDataFrame([(label(), text()) for _ in range(150)], "label_id int, token string")
    u = spark.createDataFrame([(label(), rng.choice([None, i]), entry(), rng.choice([None, text()]), rng.choice([None, "", "trade"])) for i in range(80)], "label_id int, ord int, raw string, inci string, category string")
    g = spark.createDataFrame([(label(), text()) for _ in range(9)], "label_id int, raw string")
    q = E.token_causes(t, u, g)
    got = [sorted((str(r.label_id), str(r.token), r.causes) for r in x.collect()) for x in (q, E.token_causes(t, u, g, most=600), E.token_causes_by_joins(t, u, g))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(set((a, b) for a, b, _ in got[0])) == t.distinct().count()
    assert {c for _, _, cs in got[0] for c in cs} == {"4_leakage", "2_broken_merged", "3_wrong_tool", "1_ocr_noise", "5_unknown"}
    assert q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(label_id") <= 2  # the tokens without a label are made distinct apart


def test_a_labels_truth_meets_its_items_in_one_row(spark):
    """Outcomes are kept, so nothing of the items is worked out again; labels of many pairs are judged by joins, alike."""
    import random
    rng = random.Random(7)
    word = lambda: rng.choice([None, "", "abcdef", "abcdefg", "xabcdef", "zz", "+/- zz", "may contain: abcdef", "qwerty uiop", "Qwerty + uiop"])
    label = lambda: rng.choice([None, *range(8)])
    cand = lambda: [(w,) for w in rng.sample(["ABCDEF", "ZZ", "QWERTY UIOP"], rng.randint(0, 3))]
    truth = spark.createDataFrame([(label(), i, word(), word(), rng.choice([None, "trade name", "Botanical"]), rng.choice([None, ["zz"], ["abcdef", "zz"]])) for i in range(60)],
                                  "label_id int, ord int, raw string, inci string, category string, suggested_any_of array<string>")
    items = spark.createDataFrame([(label(), i, word(), rng.choice(["resolved", "suggested", "not_found", "lookup_unavailable"]), rng.choice(["inci_exact", "fuzzy"]), rng.choice([True, False, None]), word(), rng.choice([None, "botanical"]), cand()) for i in range(70)],
                                  "label_id int, idx int, raw string, status string, layer string, high_confidence boolean, inci_name string, category string, candidates array<struct<inci_name:string>>")
    q = E.truth_outcomes(truth, items)
    got = [sorted(map(str, x.collect())) for x in (q, E.truth_outcomes(truth, items, most=60), E.truth_outcomes_by_joins(truth, items))]
    assert got[0] == got[1] == got[2] and len(got[0]) == truth.where("label_id IS NOT NULL").count()
    assert len({r["outcome"] for r in q.collect()}) >= 6
    assert "Join" not in q._jdf.queryExecution().optimizedPlan().toString()
