"""Measuring the pipeline against truth tables."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.similarity import indel_ratio, indel_ratio_one
from ..runtime import durable, shuffled
from .matching import DENSE_PAIRS, block_pairs, edit_similarity, similar_pairs

OUTCOMES = ["resolved_ok", "resolved_wrong", "category_ok", "category_wrong", "sugg_top1_ok", "sugg_top3_only", "sugg_top1_wrong", "unresolved_ok", "not_found", "unavailable", "missing"]
CORRECT = ["resolved_ok", "category_ok", "sugg_top1_ok", "unresolved_ok"]


def truth_key(raw: Column) -> Column:
    """Matching key of a truth row, without its mark of an optional entry."""
    return X.match_key(F.replace(F.regexp_replace(raw, r"(?i)^(?:may contain\s*:?|\+/-)\s*", ""), F.lit(" + "), F.lit("")))


def length_rate(want: Column, key: Column) -> Column:
    return F.least(F.length(want), F.length(key)) / F.greatest(F.length(want), F.length(key))


def truth_rank(want: Column, key: Column) -> Column:
    """0 for equal keys, 1 for one that lies in the other at 80% of the length (both five characters or more), else null."""
    within = (F.least(F.length(want), F.length(key)) >= 5) & (length_rate(want, key) >= 0.8) & (F.contains(want, key) | F.contains(key, want))
    return F.when(want == key, 0).when(within, 1)


def match_truth(truth: DataFrame, items: DataFrame, by: str = "label_id") -> DataFrame:
    """truth(by, ord, raw), items(by, idx, raw) -> (by, ord, idx): the first item with the truth's key, else the first that
    contains it or lies in it at 80% of the length (both five characters or more).

    The rows of a label are compared pair by pair.  In a label of very many rows a contained pair of that length ratio shares a five-character
    start of the shorter one, so what is not equal meets on five-character windows instead of all against all.
    """
    t = truth.select(by, "ord", truth_key(F.col("raw")).alias("want"))
    it = items.select(by, "idx", X.match_key(F.col("raw")).alias("key"))
    a, b = t.where("want IS NOT NULL").select(by, F.struct("ord", "want").alias("a")), it.where("key IS NOT NULL").select(by, F.struct("idx", "key").alias("b"))
    dense, t_far, it_far = block_pairs(a, b, [by])
    want, key = F.col("a.want"), F.col("b.key")
    few = dense.withColumn("rank", truth_rank(want, key)).where("rank IS NOT NULL").groupBy(by, F.col("a.ord").alias("ord")).agg(F.min(F.struct("rank", "b.idx")).alias("m")).select(by, "ord", "m.idx")
    # labels of very many rows meet by content
    tf, itf = t_far.select(by, "a.*"), it_far.select(by, "b.*")
    exact = tf.join(shuffled(itf.withColumnRenamed("key", "want")), [by, "want"]).groupBy(by, "ord").agg(F.min("idx").alias("idx"))
    left = tf.join(shuffled(exact), [by, "ord"], "left_anti").where(F.length("want") >= 5)
    open_items = itf.where(F.length("key") >= 5)
    win = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 4), lambda i: F.substr(c, i, F.lit(5))))
    x = left.withColumn("g", F.substring("want", 1, 5)).join(shuffled(open_items.withColumn("g", F.explode(win(F.col("key"))))), [by, "g"]).where(F.contains("key", F.col("want")))
    y = left.withColumn("g", F.explode(win(F.col("want")))).join(shuffled(open_items.withColumn("g", F.substring("key", 1, 5))), [by, "g"]).where(F.contains("want", F.col("key")))
    near = x.select(by, "ord", "idx", "want", "key").unionByName(y.select(by, "ord", "idx", "want", "key"))
    near = near.where(length_rate(F.col("want"), F.col("key")) >= 0.8).groupBy(by, "ord").agg(F.min("idx").alias("idx"))
    return t.select(by, "ord").join(shuffled(few.unionByName(exact).unionByName(near)), [by, "ord"], "left")


def resolution_outcome(found: Column, status: Column, layer: Column, inci: Column, item_category: Column, candidates: Column,
                       want: Column, any_of: Column, category: Column) -> Column:
    """One of the eleven outcomes of a truth row.  ``want``/``inci``/``candidates``/``any_of`` are matching keys."""
    top = F.get(candidates, F.lit(0))
    cat = F.lower(F.coalesce(category, F.lit("")))
    head = F.split_part(cat, F.lit(" "), F.lit(1))
    named = (F.when(status == "resolved", F.when(inci == want, "resolved_ok").otherwise("resolved_wrong"))
             .when(status == "suggested", F.when(top == want, "sugg_top1_ok").when(F.array_contains(candidates, want), "sugg_top3_only").otherwise("sugg_top1_wrong"))
             .when(status == "lookup_unavailable", "unavailable").otherwise("not_found"))
    either = (F.when((status == "suggested") & F.array_contains(any_of, top) & (F.size(F.array_except(any_of, candidates)) == 0), "sugg_top1_ok")
              .when(status == "suggested", "sugg_top1_wrong").otherwise("not_found"))
    plain = cat.startswith("trade") | cat.startswith("common")
    classed = (F.when((status == "resolved") & layer.isin("inci_exact", "inci_alias"), "category_ok")
               .when(plain, F.when(status.isin("not_found", "lookup_unavailable"), "unresolved_ok").when(status == "resolved", "resolved_wrong").otherwise("sugg_top1_wrong"))
               .when((status == "resolved") & F.lower(F.coalesce(item_category, F.lit(""))).startswith(head), "category_ok")
               .when(status == "resolved", "category_wrong").when(status == "lookup_unavailable", "unavailable").otherwise("not_found"))
    return F.when(~found, "missing").when(want.isNotNull(), named).when(F.size(any_of) > 0, either).otherwise(classed)


def truth_outcomes(truth: DataFrame, items: DataFrame, most: int = DENSE_PAIRS) -> DataFrame:
    """truth(label_id, ord, raw, inci, category, suggested_any_of), resolved items -> (label_id, ord, outcome, layer, status, high_confidence).

    A label's truth meets its items in one row, so that the items are worked out and shuffled once; a truth row takes the item that
    ``match_truth`` gives it.  What is kept is the outcomes.  Labels of more than ``most`` pairs are left to the joins of ``match_truth``.
    """
    i = items.select("label_id", F.struct("idx", X.match_key(F.col("raw")).alias("key"), *item_facts(), "status", "layer", "high_confidence").alias("i"))
    t = truth.where("ord IS NOT NULL").select("label_id", F.struct("ord", truth_key(F.col("raw")).alias("name"), *truth_facts()).alias("t"))
    w = Window.partitionBy("label_id")
    both = t.unionByName(i, allowMissingColumns=True).where("label_id IS NOT NULL").repartition("label_id").withColumn("large", F.count("t").over(w) * F.count("i").over(w) > most)
    some = lambda c: F.collect_list(F.when(~F.col("large"), F.col(c))).alias(c)
    rows = both.groupBy("label_id").agg(F.max("large").alias("large"), some("t"), some("i"))

    def met(x):
        rated = F.transform("i", lambda y: F.struct(truth_rank(x["name"], y["key"]).alias("rank"), y["idx"].alias("idx"), y.alias("i")))
        return F.struct(x.alias("t"), F.array_min(F.filter(rated, lambda r: r["rank"].isNotNull()))["i"].alias("i"))
    pairs = rows.select("label_id", "large", F.explode(F.when(F.col("large"), F.transform(F.array(F.lit(None).cast(rows.schema["t"].dataType.elementType)), met)).otherwise(F.transform("t", met))).alias("p")).select("label_id", "large", "p.*")
    o = resolution_outcome(F.col("i").isNotNull(), *[F.col(f"i.{c}") for c in ("status", "layer", "inci_key", "item_category", "cand_keys")], *[F.col(f"t.{c}") for c in ("want", "any_of", "category")])
    out = durable(pairs.select("label_id", "t.ord", o.alias("outcome"), "i.layer", "i.status", F.coalesce("i.high_confidence", F.lit(False)).alias("high_confidence"), "large"))
    large = out.where("large").select("label_id").distinct()
    full = out.where("NOT large").drop("large")
    if large.isEmpty():
        return full
    large = shuffled(large)
    return full.unionByName(truth_outcomes_by_joins(truth.join(large, "label_id", "left_semi"), items.join(large, "label_id", "left_semi")))


def item_facts() -> list[Column]:
    return [X.match_key(F.col("inci_name")).alias("inci_key"), F.col("category").alias("item_category"), F.transform("candidates", lambda c: X.fold_key(c["inci_name"])).alias("cand_keys")]


def truth_facts() -> list[Column]:
    return [X.match_key(F.col("inci")).alias("want"), F.transform(F.coalesce("suggested_any_of", F.array().cast("array<string>")), lambda x: X.fold_key(x)).alias("any_of"), F.col("category")]


def truth_outcomes_by_joins(truth: DataFrame, items: DataFrame) -> DataFrame:
    """``truth_outcomes`` of labels of very many rows."""
    m = match_truth(truth, items)
    i = items.select("label_id", "idx", "status", "layer", "high_confidence", *item_facts())
    t = truth.select("label_id", "ord", *truth_facts())
    j = t.join(shuffled(m), ["label_id", "ord"]).join(shuffled(i), ["label_id", "idx"], "left")
    o = resolution_outcome(F.col("idx").isNotNull(), F.col("status"), F.col("layer"), F.col("inci_key"), F.col("item_category"), F.col("cand_keys"), F.col("want"), F.col("any_of"), F.col("category"))
    return j.select("label_id", "ord", o.alias("outcome"), "layer", "status", F.coalesce("high_confidence", F.lit(False)).alias("high_confidence"))


def resolution_report(outcomes: DataFrame) -> DataFrame:
    """Totals in one row: outcome counts, false accepts, high-confidence right and wrong."""
    o = F.col("outcome")
    hc = (F.col("status") == "suggested") & F.col("high_confidence")
    return outcomes.agg(F.count("*").alias("n"), *[F.count_if(o == x).alias(x) for x in OUTCOMES],
                        F.count_if(o.isin("resolved_wrong", "category_wrong", "sugg_top1_wrong")).alias("false_accepts"),
                        F.count_if(hc & (o == "sugg_top1_ok")).alias("high_right"), F.count_if(hc & (o != "sugg_top1_ok")).alias("high_wrong"))


def layer_report(outcomes: DataFrame) -> DataFrame:
    """Per resolution layer: matched items and how many were right."""
    return outcomes.where("layer IS NOT NULL").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin(*CORRECT)).alias("n_correct"))


def grouped_report(outcomes: DataFrame, group: str = "grp") -> DataFrame:
    """outcomes(group, layer, outcome, status, high_confidence) -> one table of grouping sets: ``level`` total, group or layer.

    Every level has rows, right ones, false accepts and high-confidence right and wrong, from one aggregation.  Truth rows without an item
    have no layer and are left out of that level.
    """
    o, hc = F.col("outcome"), (F.col("status") == "suggested") & F.col("high_confidence")
    g = outcomes.groupingSets([[], [group], ["layer"]], group, "layer").agg(
        F.grouping_id(group, "layer").alias("gid"), F.count("*").alias("n"), F.count_if(o.isin(*CORRECT)).alias("n_correct"),
        F.count_if(o.isin("resolved_wrong", "category_wrong", "sugg_top1_wrong")).alias("false_accepts"), F.count_if(o == "missing").alias("missing"),
        F.count_if(hc & (o == "sugg_top1_ok")).alias("high_right"), F.count_if(hc & (o != "sugg_top1_ok")).alias("high_wrong"))
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "group").otherwise("layer")
    return g.withColumn("level", level).where("level <> 'layer' OR layer IS NOT NULL").select("level", F.coalesce(group, "layer").alias("name"), *g.columns[3:])


def change_report(labels: DataFrame, items: DataFrame, removed: DataFrame, expected_removed: DataFrame, missing: DataFrame, group: str = "grp") -> DataFrame:
    """What the resolver took out, joined and cut, per group and in total (group null).

    labels(label_id, group), items(label_id, merged, split), removed / expected_removed / missing(label_id, raw) -> labels, expected_removed and
    how many were removed, wrongly_removed (missing truth rows found among the removed), merges, splits (two items each).
    A fragment is found when its key holds, or lies in, a removed key of four characters or more (five for truth rows).
    """
    key = lambda d, c: d.select("label_id", X.match_key(F.col("raw")).alias(c)).where(F.length(c) > 0)

    def found(wanted: DataFrame, least: int) -> DataFrame:
        w, x = key(wanted, "w"), key(removed, "x").where(F.length("x") >= least).distinct()
        d = w.distinct()
        a = holding(d.withColumnRenamed("w", "n"), x.withColumnRenamed("x", "e"), "label_id", [least]).select("label_id", F.col("n").alias("w"))
        b = holding(x.withColumnRenamed("x", "n"), d.withColumnRenamed("w", "e"), "label_id", [1, 2, 3, 4]).select("label_id", F.col("e").alias("w"))
        return w.join(shuffled(a.unionByName(b).distinct()), ["label_id", "w"], "left_semi")
    per = lambda d, c: d.groupBy("label_id").agg(F.count("*").alias(c))
    j = labels.select("label_id", group)
    for d, c in ((expected_removed, "expected_removed"), (found(expected_removed, 4), "removed_right"), (found(missing, 5), "wrongly_removed")):
        j = j.join(shuffled(per(d, c)), "label_id", "left")
    j = j.join(items.groupBy("label_id").agg(F.count_if("merged").alias("merges"), F.count_if("split").alias("cut")), "label_id", "left").na.fill(0, ["expected_removed", "removed_right", "wrongly_removed", "merges", "cut"])
    j = j.withColumn("splits", F.floor(F.col("cut") / 2))  # halves of a label come in pairs
    sums = ["expected_removed", "removed_right", "wrongly_removed", "merges", "splits"]
    return j.rollup(group).agg(F.count("*").alias("labels"), *[F.sum(c).alias(c) for c in sums])


# The threshold grid.
GRID = {"high_score": [0.75, 0.80, 0.85], "high_margin": [0.05, 0.08, 0.12], "max_unexplained": [1, 2], "dominant_score": [0.85, 0.90], "dominant_margin": [0.12, 0.15, 0.20, 0.25]}


def threshold_sweep(suggestions: DataFrame) -> DataFrame:
    """suggestions(score, margin, unexplained, extra, right) -> per threshold setting: high-confidence total, right, wrong.

    Each suggestion is first counted into cells (how many grid steps its score, margin and edits reach); only the cell counts,
    a few hundred rows whatever the input, meet the 144 settings.
    """
    def level(c, values):
        return sum((c >= v).cast("int") for v in values)
    s = suggestions.where("extra < 2")
    cells = s.groupBy(level(F.col("score"), GRID["high_score"]).alias("hs"), level(F.col("margin"), GRID["high_margin"]).alias("hm"),
                      F.when(F.col("unexplained") <= 1, 0).when(F.col("unexplained") <= 2, 1).otherwise(2).alias("un"),
                      level(F.col("score"), GRID["dominant_score"]).alias("ds"), level(F.col("margin"), GRID["dominant_margin"]).alias("dm")).agg(
        F.count("*").alias("n"), F.count_if("right").alias("ok"))
    steps = lambda k: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(GRID[k])]))
    g = cells
    for k in GRID:
        g = g.select("*", steps(k).alias(k))
    clear = (F.col("hs") > F.col("high_score.i")) & (F.col("hm") > F.col("high_margin.i")) & (F.col("un") <= F.col("max_unexplained.i"))
    dominant = (F.col("ds") > F.col("dominant_score.i")) & (F.col("dm") > F.col("dominant_margin.i"))
    high = clear | dominant
    out = g.groupBy(*[F.col(f"{k}.v").alias(k) for k in GRID]).agg(F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(high, F.col("ok"))), F.lit(0)).alias("right"))
    return out.withColumn("wrong", F.col("total") - F.col("right"))


def noisy_copies(truth: DataFrame, copies: int = 1, seed: int = 1) -> DataFrame:
    """truth(id, raw) -> (id, copy, raw): one or two character edits per name of six or more characters.

    The edits are drawn from a hash of (id, copy, seed), so a copy is the same whatever the partitioning.
    """
    t = truth.select("id", "raw", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    def draw(tag, n):
        return F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit(tag)), n)
    def edit(c, k):
        i = (draw(f"at{k}", F.greatest(F.length(c) - 2, F.lit(1))) + 2).cast("int")
        letter = F.char(draw(f"ch{k}", F.lit(26)) + 65)
        pre, post = F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)
        op = draw(f"op{k}", F.lit(4))
        return (F.when(op == 0, F.concat(pre, letter, post)).when(op == 1, F.concat(pre, post)).when(op == 2, F.concat(pre, letter, F.substr(c, i)))
                .otherwise(F.concat(F.substr(c, F.lit(1), i - 2), F.substr(c, i, F.lit(1)), F.substr(c, i - 1, F.lit(1)), post)))
    one = edit(F.col("raw"), 1)
    t = t.withColumn("one", one).withColumn("two", edit(F.col("one"), 2))
    return t.select("id", "copy", F.when(F.length("raw") < 6, F.col("raw")).when(draw("n", F.lit(3)) == 2, F.col("two")).otherwise(F.col("one")).alias("raw"))


def text_score(expected: DataFrame, items: DataFrame, by: str = "photo_id") -> DataFrame:
    """expected(by, key, covered), items(by, key, how auto/sugg) -> (by, n, top1, auto, false_accepts): one-to-one matching of equal names.

    The k-th expected row of a name takes the k-th item of that name: the greedy one-to-one rule as occurrence numbers.
    """
    occ = lambda d, order: d.withColumn("o", F.row_number().over(Window.partitionBy(by, "key").orderBy(order)))
    e = occ(expected.where("covered"), "ord")
    i = occ(items, "idx")
    m = e.join(i.select(by, "key", "o", "how"), [by, "key", "o"], "left").groupBy(by).agg(F.count("*").alias("n"), F.count("how").alias("top1"), F.count_if(F.col("how") == "auto").alias("auto"))
    fa = items.join(expected.select(by, "key").distinct(), [by, "key"], "left_anti").groupBy(by).agg(F.count("*").alias("fa"))
    return m.join(fa, by, "left").select(by, "n", "top1", "auto", F.coalesce("fa", F.lit(0)).alias("false_accepts"))


def character_error_rate(got: Column, truth: Column) -> Column:
    a, b = X.fold_key(got), X.fold_key(truth)
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(b))


def variant_compare(scores: DataFrame, a: str, b: str, by: str = "photo_id") -> DataFrame:
    """scores(by, variant, top1, cer) -> one row: photos where a or b is better, ties, net entries gained by b."""
    p = scores.where(F.col("variant").isin(a, b)).groupBy(by).agg(F.max(F.when(F.col("variant") == a, F.col("top1"))).alias("x"), F.max(F.when(F.col("variant") == b, F.col("top1"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return p.agg(F.count_if(F.expr("x > y")).alias("a_better"), F.count_if(F.expr("y > x")).alias("b_better"), F.count_if(F.expr("x = y")).alias("ties"), F.coalesce(F.sum(F.col("y") - F.col("x")), F.lit(0)).alias("net_gain"))


def variant_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant").agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("top1").alias("top1"))


def merge_gain(scores: DataFrame, by: str = "product_id") -> DataFrame:
    """scores(by, reading in a/b/merged, top1, n) -> recall of each reading side by side."""
    r = F.col("top1") / F.greatest(F.lit(1), F.col("n"))
    pick = lambda v: F.max(F.when(F.col("reading") == v, r)).alias(v)
    return scores.groupBy(by).agg(pick("a"), pick("b"), pick("merged"))


def consensus_gain(names: DataFrame, truth: DataFrame, groups: list[str]) -> DataFrame:
    """names(photo_id, reading, key) with readings single/consensus/other passes, truth(photo_id, groups..., key) -> per grouping set:
    truth rows, names read right by the single pass, by the consensus, by any pass, and how many names each proposed.
    """
    n = names.select("photo_id", "reading", "key").distinct()
    ok = n.join(truth.select("photo_id", "key").distinct(), ["photo_id", "key"], "left_semi")
    hits = ok.groupBy("photo_id").agg(F.count_if(F.col("reading") == "single").alias("single"), F.count_if(F.col("reading") == "consensus").alias("consensus"),
                                      F.count_distinct(F.when(F.col("reading") != "consensus", F.col("key"))).alias("any_pass"))
    given = n.groupBy("photo_id").agg(F.count_if(F.col("reading") == "single").alias("single_given"), F.count_if(F.col("reading") == "consensus").alias("consensus_given"))
    t = truth.groupBy("photo_id", *groups).agg(F.count_distinct("key").alias("truth"))
    j = t.join(hits, "photo_id", "left").join(given, "photo_id", "left").na.fill(0)
    cols = ["truth", "single", "consensus", "any_pass", "single_given", "consensus_given"]
    return j.rollup(*groups).agg(*[F.sum(c).alias(c) for c in cols])


# What a failed token looks like.
LEAK = r"(?i)\bFIL\d+|\bMRP\b|\bRS\.?\s*\d|\bB\.?NO\b|\bMFG\b|\bEXP\b|SHAKE WELL|MADE IN|NET WT|\d+\s?ML\b"
WRONG_WORDS = r"(?i)\b(?:CI\s?\d{5}|PARFUM|FRAGRANCE|AROMA|EXTRACT|LEAF JUICE|SEED GUM|BUTTER|POLYMER|CROSSPOLYMER|COPOLYMER)\b|MAY CONTAIN"
WRONG_TOOL = [  # a sign that the pattern needs, the pattern
    ("+/-", r"\+/-"), ("/", r"(?i)(?=.*/.*/).*(AQUA|WATER)"), ("(", r"(?i)\(NANO\)"), ("", r"^[A-Z][a-z]+ [A-Z][a-z]+ (\([^)]*\) )?.*(Oil|Butter)$"),
]


def failure_causes(raw: Column, best_ratio: Column, contains_two: Column, is_part: Column, removed_hit: Column, classed: Column) -> Column:
    """Ordered array of causes of an unresolved token: 4_leakage, 2_broken_merged, 3_wrong_tool, 1_ocr_noise, else 5_unknown."""
    # every pattern is searched once, and a pattern that needs a certain sign only where a plain search finds it
    needs = lambda sign, rx: F.contains(raw, F.lit(sign)) & raw.rlike(rx)
    leak = raw.rlike(LEAK) | removed_hit
    broken = needs("-", r"-\s+\S") | contains_two | is_part
    tool = classed | raw.rlike(WRONG_WORDS)
    for sign, p in WRONG_TOOL:
        tool = tool | (needs(sign, p) if sign else raw.rlike(p))
    near = (best_ratio >= 0.7) & (best_ratio < 1)

    def causes(x):
        noise = ~x["broken"] & ~x["tool"] & x["near"]
        first = F.array_compact(F.array(F.when(x["leak"], F.lit("4_leakage")), F.when(x["broken"], F.lit("2_broken_merged")), F.when(x["tool"], F.lit("3_wrong_tool")), F.when(noise, F.lit("1_ocr_noise"))))
        return X.let(first, lambda f: F.when(F.size(f) == 0, F.array(F.lit("5_unknown"))).otherwise(f))
    return X.let(F.struct(leak.alias("leak"), broken.alias("broken"), tool.alias("tool"), near.alias("near")), causes)


def best_truth_ratio(tokens: DataFrame, names: DataFrame, floor: float = 0.7, by: str = "label_id") -> DataFrame:
    """tokens(by, token), names(by, name) -> (by, token, best): best edit similarity of at least ``floor`` over the names of the same label."""
    k = lambda d, c: d.select(by, X.label_norm(F.col(c)).alias("k")).where("k <> ''").distinct()
    p = similar_pairs(k(tokens, "token"), k(names, "name"), floor, [by]).groupBy(by, F.col("left_key").alias("k")).agg(F.max("sim").alias("best"))
    return tokens.select(by, "token").distinct().withColumn("k", X.label_norm(F.col("token"))).join(shuffled(p), [by, "k"], "left").select(by, "token", F.coalesce("best", F.lit(0.0)).alias("best"))


def holding(longer: DataFrame, shorter: DataFrame, by: str, sizes: list[int]) -> DataFrame:
    """longer(by, n), shorter(by, e), both distinct -> (by, n, e) where ``n`` contains ``e`` within the same ``by``.

    A contained string brings its start along, so pairs meet on the first ``max(sizes)`` characters of ``e`` (all of it, if shorter)
    among the windows of ``n``; ``sizes`` names the lengths such starts can have.  Empty strings are contained in nothing.  Labels of few
    strings are compared pair by pair.
    """
    dense, longer, shorter = block_pairs(longer.withColumnRenamed("n", "a").where("a <> ''"), shorter.withColumnRenamed("e", "b").where("b <> ''"), [by])
    win = lambda k: F.when(F.length("a") >= k, F.transform(F.sequence(F.lit(1), F.length("a") - k + 1), lambda i: F.substr("a", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = longer.select(by, "a", F.explode(F.array_distinct(F.concat(*[win(k) for k in sizes]))).alias("g"))
    heads = shorter.select(by, "b", F.substring("b", 1, max(sizes)).alias("g"))
    met = grams.join(shuffled(heads), [by, "g"]).select(by, "a", "b")
    start = F.length(F.substring("b", 1, max(sizes))).isin(*sizes)
    return dense.where(start).unionByName(met).where(F.contains("a", F.col("b"))).select(by, F.col("a").alias("n"), F.col("b").alias("e"))


def token_causes(tokens: DataFrame, truth: DataFrame, removed: DataFrame, by: str = "label_id", most: int = DENSE_PAIRS) -> DataFrame:
    """tokens(by, token), truth(by, ord, raw, inci, category), removed(by, raw) -> (by, token, causes), a row per distinct token.

    The causes come from the label's own truth: the token holds a fragment that should have been removed (leakage), holds two names
    of which neither lies in a longer one it holds, or is one part of a 'A + B' entry (broken or merged), is an entry known by
    class only (wrong tool), or is close to a name (noise).  A token whose label has no truth is judged by its text alone.

    All that is known of a label meets its tokens in one row, by one shuffle.  Labels whose rows make more than ``most`` pairs are
    left to ``token_causes_by_joins``.
    """
    norm = lambda c: X.label_norm(F.col(c))
    sides = [tokens.select(by, "token"), truth.select(by, "ord", "raw", "inci", "category"), removed.select(by, "raw")]
    per = [d.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")) for d in sides]
    large = per[0].unionByName(per[1]).unionByName(per[2]).groupBy(by).agg(F.sum("n").alias("n")).where(F.col("n") * F.col("n") > most).select(by)
    some = not large.isEmpty()
    if some:
        large = shuffled(durable(large))
        few, many = ([d.join(large, by, how) for d in sides] for how in ("left_anti", "left_semi"))
    else:
        few = sides
    t, u, g = few
    only_class = F.col("inci").isNull() & (F.coalesce("category", F.lit("")) != "")
    joined = F.contains("raw", F.lit(" + "))
    entry = X.let(norm("raw"), lambda n: F.struct("ord", n.alias("n"), only_class.alias("c"), joined.alias("joined"), norm("inci").alias("name"),
                                                  F.when(joined, F.transform(F.split("raw", r" \+ "), X.label_norm)).when(~joined, F.array(n)).alias("parts")))
    known = F.col(by).isNotNull()
    t = t.select(by, F.struct("token", norm("token").alias("n")).alias("t"))
    both = (t.where(known)
            .unionByName(u.where(known).select(by, entry.alias("u")), allowMissingColumns=True)
            .unionByName(g.where(known).select(by, norm("raw").alias("g")), allowMissingColumns=True))
    # tokens of no label are judged by their text alone, so they need not meet
    apart = t.where(~known).distinct().select(by, F.array("t").alias("t"), *[F.array().cast(both.schema[c].dataType.simpleString().join(("array<", ">"))).alias(c) for c in ("u", "g")])
    rows = both.repartition(by).groupBy(by).agg(F.collect_set("t").alias("t"), F.collect_list("u").alias("u"), F.collect_set("g").alias("g")).where(F.size("t") > 0).unionByName(apart)
    parts = F.flatten(F.filter("u.parts", lambda p: p.isNotNull()))
    rows = rows.select(by, "t", F.filter(parts, lambda e: F.length(e) > 5).alias("named"), F.flatten(F.transform(F.filter("u", lambda x: x["joined"]), lambda x: x["parts"])).alias("joined"),
                       F.filter("g", lambda e: e != "").alias("gone"), F.transform(F.filter("u", lambda x: x["ord"].isNotNull() & x["n"].isNotNull()), lambda x: F.struct(x["ord"], x["c"], x["n"])).alias("entries"),
                       F.array_distinct(F.filter("u.name", lambda m: m != "")).alias("names"))

    def judged(x):
        n = x["n"]
        inside = lambda e: F.contains(n, e)
        hits = F.filter("named", inside)
        two = X.let(hits, lambda hs: (F.size(hs) >= 2) & (F.size(F.filter(hs, lambda e: ~F.exists(hs, lambda o: (o != e) & F.contains(o, e)))) >= 2))
        first = F.array_min(F.filter("entries", lambda u: u["n"] == n))
        return F.struct(x["token"].alias("token"), two.alias("two"), F.array_contains("joined", n).alias("part"), ((n != "") & F.exists("gone", inside)).alias("leak"),
                        first["c"].alias("classed"), F.when(n != "", F.array_max(F.transform("names", lambda m: near_ratio(n, m)))).alias("best"))
    j = rows.select(by, F.explode(F.transform("t", judged)).alias("j")).select(by, "j.*")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = j.select(by, "token", failure_causes(F.col("token"), F.coalesce("best", F.lit(0.0)), yes("two"), yes("part"), yes("leak"), yes("classed")).alias("causes"))
    return out.unionByName(token_causes_by_joins(*many, by)) if some else out


def near_ratio(a: Column, b: Column, floor: float = 0.7) -> Column:
    """Edit similarity of two texts that are not both empty, null below ``floor``."""
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.call_function("levenshtein", a, b, F.floor((1 - floor) * longest + 1e-9).cast("int"))  # -1 beyond the last number
    return F.when(edits >= 0, 1 - edits / longest)


def token_causes_by_joins(tokens: DataFrame, truth: DataFrame, removed: DataFrame, by: str = "label_id") -> DataFrame:
    """``token_causes`` where texts meet by content: labels of very many rows."""
    norm = lambda c: X.label_norm(F.col(c))
    t = tokens.select(by, "token").distinct().withColumn("n", norm("token"))
    k = t.select(by, "n").where("n IS NOT NULL").distinct()
    parts = truth.select(by, F.explode(F.split("raw", r" \+ ")).alias("part"), F.contains("raw", F.lit(" + ")).alias("joined")).select(by, norm("part").alias("e"), "joined")
    named = parts.where(F.length("e") > 5).groupBy(by, "e").agg(F.count("*").alias("times"))
    hits = holding(k, named.select(by, "e"), by, [6]).join(shuffled(named), [by, "e"])
    inner = holding(named.select(by, F.col("e").alias("n")), named.select(by, "e"), by, [6]).where("n <> e").select(by, "e", F.col("n").alias("o"))
    covered = hits.join(shuffled(inner), [by, "e"]).join(shuffled(hits.select(by, "n", F.col("e").alias("o"))), [by, "n", "o"]).select(by, "n", "e").distinct()
    two = hits.join(shuffled(covered), [by, "n", "e"], "left_anti").groupBy(by, "n").agg((F.sum("times") >= 2).alias("two"))
    part = parts.where("joined").select(by, F.col("e").alias("n")).distinct().withColumn("part", F.lit(True))
    gone = removed.select(by, norm("raw").alias("e")).where("e <> ''").distinct()
    leak = holding(k, gone, by, [1, 2, 3]).select(by, "n").distinct().withColumn("leak", F.lit(True))
    only_class = F.col("inci").isNull() & (F.coalesce("category", F.lit("")) != "")
    classed = truth.select(by, "ord", norm("raw").alias("n"), only_class.alias("c")).groupBy(by, "n").agg(F.min_by("c", "ord").alias("classed"))
    best = best_truth_ratio(tokens, truth.where("inci IS NOT NULL").select(by, F.col("inci").alias("name")), by=by)
    j = t
    for flag in (two, part, leak, classed):
        j = j.join(shuffled(flag), [by, "n"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    j = j.join(shuffled(best), [by, "token"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return j.select(by, "token", failure_causes(F.col("token"), F.col("best"), yes("two"), yes("part"), yes("leak"), yes("classed")).alias("causes"))


def cause_report(causes: DataFrame) -> DataFrame:
    """causes(cause array) -> (cause, as_primary, as_any)."""
    return causes.select(F.posexplode("causes").alias("i", "cause")).groupBy("cause").agg(F.count_if(F.col("i") == 0).alias("as_primary"), F.count("*").alias("as_any"))


def truth_coverage(truth: DataFrame, lookup: DataFrame) -> DataFrame:
    """truth(raw) -> (raw, covered, inci, category): does the dictionary or a class know the name?"""
    p = X.strip_parens(F.col("raw"))
    t = truth.select("raw", X.match_key(p).alias("key"), F.coalesce(X.classify_category(F.col("raw")), X.classify_category(p)).alias("class"))
    j = t.join(lookup.select("key", "inci_name"), "key", "left")
    return j.select("raw", (F.col("inci_name").isNotNull() | F.col("class").isNotNull()).alias("covered"),
                    F.when(F.col("inci_name").isNotNull(), F.col("inci_name")).when(F.col("class").isNull(), F.upper("raw")).alias("inci"), F.when(F.col("inci_name").isNull(), F.col("class")).alias("category"))


def function_coverage(names: DataFrame, roles: DataFrame) -> DataFrame:
    """names(label_id, inci) -> per label (and in total, label null): identified names, those with a role."""
    r = roles.select("inci").distinct().withColumn("has", F.lit(1))
    j = names.join(r, "inci", "left")
    return j.rollup("label_id").agg(F.count("*").alias("identified"), F.count("has").alias("with_role"))


def missing_roles(names: DataFrame, roles: DataFrame) -> DataFrame:
    """Names without a role, most frequent first."""
    return names.join(roles.select("inci").distinct(), "inci", "left_anti").groupBy("inci").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "inci")


def word_recall(pairs: DataFrame, by: str = "photo_id", cutoff: float = 80.0, most: int = DENSE_PAIRS) -> DataFrame:
    """pairs(by, truth, ocr) -> (by, recall): share of truth words (4+ letters) with a similar OCR word (Indel ratio >= cutoff).

    A photo's words are compared where its row is; equal words are settled by a look-up.  Photos of more than ``most`` pairs of words are
    left to ``similar_words``.  A photo without truth words or without OCR words has recall 0.
    """
    none = F.array().cast("array<string>")
    up = lambda c, n: F.coalesce(F.when(F.col(by).isNotNull(), F.regexp_extract_all(F.upper(c), F.lit(f"([A-Za-z]{{{n},}})"), 1)), none)
    p = pairs.select(by, up("truth", 4).alias("t"), F.array_distinct(up("ocr", 3)).alias("o"))
    p = p.groupBy(by).agg(F.flatten(F.collect_list("t")).alias("t"), F.array_distinct(F.flatten(F.collect_list("o"))).alias("o"))
    many = F.size("t").cast("long") * F.size("o") > most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words recur from photo to photo
        alike = lru_cache(1 << 16)(lambda a, b: 200.0 * min(len(a), len(b)) / (len(a) + len(b)) >= cutoff and indel_ratio_one(a, b) >= cutoff)
        for b in batches:
            words, found = [], []
            for t, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                read = set(o)
                words.append(len(t))
                found.append(sum(w in read or any(alike(w, x) for x in o) for w in t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(found, pa.int64())], [by, "words", "found"])
    large = p.where(many)
    some = not large.isEmpty()
    full = (p.where(~many) if some else p).mapInArrow(run, f"`{by}` {pairs.schema[by].dataType.simpleString()}, words long, found long")
    if some:
        full = full.unionByName(similar_words(durable(large), by, cutoff))
    return full.select("*", F.when(F.col("words") > 0, F.col("found") / F.col("words")).otherwise(0.0).alias("recall"))


def similar_words(photos: DataFrame, by: str, cutoff: float) -> DataFrame:
    """photos(by, t, o) -> (by, words, found) by joins.

    Equal words are settled by a semi join.  For the rest, a ratio of 80 means an edit similarity of at least .6 of the
    longer word, so candidates come from the segment join within the photo and the ratio is computed for those only.
    """
    tk = photos.select(by, F.explode("t").alias("k")).groupBy(by, "k").agg(F.count("*").alias("n"))
    o = photos.select(by, F.explode("o").alias("k"))
    hit = tk.join(o, [by, "k"], "left_semi")
    rest = tk.join(o, [by, "k"], "left_anti")
    near = similar_pairs(rest.select(by, "k"), o, 0.6, [by]).withColumn("ratio", indel_ratio("left_key", "right_key")).where(F.col("ratio") >= cutoff)
    near_hit = rest.join(near.select(by, F.col("left_key").alias("k")).distinct(), [by, "k"]).select(by, "k", "n")
    got = hit.unionByName(near_hit).groupBy(by).agg(F.sum("n").alias("found"))
    return tk.groupBy(by).agg(F.sum("n").alias("words")).join(got, by, "left").select(by, "words", F.coalesce("found", F.lit(0)).alias("found"))
