"""Review decisions, buckets, proposals and saved products."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.pack import parse_price
from ..functions.similarity import confusion_score

NEEDS_REVIEW = ["suggested", "ambiguous", "not_found", "lookup_unavailable"]


def bucket_of(status: Column, layer: Column, accepted: Column, kept: Column) -> Column:
    resolved = status.isin("resolved", "inci_exact", "pubchem_match", "compound_match")
    return (F.when(accepted, "accepted").when(kept, "kept")
            .when(resolved & (layer == "category_recognized"), "class")
            .when(resolved & (layer.isin("pubchem_match", "compound_match") | status.isin("pubchem_match", "compound_match")), "pubchem")
            .when(resolved & (layer == "inci_alias"), "synonym").when(resolved, "inci")
            .when(status == "suggested", "suggested").when(status == "ambiguous", "ambiguous")
            .when(status == "lookup_unavailable", "unavailable").otherwise("not_found"))


def needs_review(status: Column, optional: Column, identified: Column) -> Column:
    return ~optional & ~identified & status.isin(*NEEDS_REVIEW)


def explain_candidate(edits: Column) -> Column:
    """'differs by N edits (look-alike, missing, extra)'; null for an exact candidate."""
    has = lambda rx: F.exists(edits, lambda e: e.rlike(rx))
    kinds = F.array_compact(F.array(F.when(has("look-alike|unreadable"), F.lit("look-alike glyphs")), F.when(has("missing|not visible"), F.lit("missing characters")),
                                    F.when(has("^extra"), F.lit("extra characters"))))
    n = F.size(edits)
    return F.when(n > 0, F.concat(F.lit("differs by "), n.cast("string"), F.when(n > 1, " edits").otherwise(" edit"),
                                  F.when(F.size(kinds) > 0, F.concat(F.lit(" ("), F.array_join(kinds, ", "), F.lit(")"))).otherwise("")))


def identities(items: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Adds ``inci`` and ``via``: an accepted name beats a resolved one; a suggestion never counts."""
    if choices is None:
        items = items.withColumn("accepted_name", F.lit(None).cast("string"))
    else:
        acc = choices.where("action = 'accept'").groupBy("label_id", "key").agg(F.max("value").alias("accepted_name"))
        items = items.withColumn("key", X.fold_key(F.col("raw"), False)).join(acc, ["label_id", "key"], "left").drop("key")
    resolved = F.when((F.col("status") == "resolved"), F.col("inci_name"))
    return items.withColumn("inci", F.coalesce("accepted_name", resolved)).withColumn(
        "via", F.when(F.col("accepted_name").isNotNull(), "accepted").when(resolved.isNotNull(), "resolved").otherwise("none"))


def apply_choices(items: DataFrame, removed: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shown items and the removed list after review: restored fragments come back unchecked at the end, 'not an ingredient'
    goes to the removed list, kept items leave the review."""
    ck = X.fold_key(F.col("raw"), False)
    pick = lambda a: choices.where(F.col("action") == a).select("label_id", "key").distinct()
    rem = removed.withColumn("key", ck)
    back = rem.join(pick("restore"), ["label_id", "key"], "left_semi")
    base = items.select("label_id", F.col("idx").cast("long").alias("idx"), "raw", "status", "layer", "inci_name", "optional").withColumn("key", ck)
    added = back.select("label_id", (F.col("position") + F.lit(1_000_000_000)).cast("long").alias("idx"), "raw", F.lit("not_found").alias("status"), F.lit("not_found").alias("layer"),
                        F.lit(None).cast("string").alias("inci_name"), F.lit(False).alias("optional"), "key")
    marked = pick("not_ingredient")
    shown = base.unionByName(added).join(marked, ["label_id", "key"], "left_anti")
    kept = pick("keep").withColumn("k", F.lit(True))
    acc = choices.where("action = 'accept'").groupBy("label_id", "key").agg(F.max("value").alias("accepted_name"))
    shown = shown.join(kept, ["label_id", "key"], "left").join(acc, ["label_id", "key"], "left")
    shown = shown.withColumn("status", F.when(F.coalesce("k", F.lit(False)) & F.col("accepted_name").isNull(), "kept").otherwise(F.col("status"))).drop("k")
    w = Window.partitionBy("label_id").orderBy("idx")
    shown = shown.withColumn("idx", F.row_number().over(w) - 1)
    gone = (rem.join(pick("restore"), ["label_id", "key"], "left_anti").select("label_id", "raw", "reason")
            .unionByName(base.join(marked, ["label_id", "key"], "left_semi").select("label_id", "raw", F.lit("You marked this as not an ingredient").alias("reason"))))
    return shown.drop("key"), gone


def rebuild_text(items: DataFrame, removed: DataFrame | None = None, replacement: DataFrame | None = None) -> DataFrame:
    """(label_id, text): main list, then 'may contain: ...', then removed fragments; one item may be replaced."""
    it = items.select("label_id", F.col("idx").cast("long").alias("idx"), "raw", "optional")
    if replacement is not None:
        it = it.join(replacement.select("label_id", F.col("idx").cast("long").alias("idx"), F.col("text").alias("_new")), ["label_id", "idx"], "left").withColumn("raw", F.coalesce("_new", "raw")).drop("_new")
    rows = it.select("label_id", F.when(F.col("optional"), 1).otherwise(0).alias("part"), F.col("idx").alias("o"), "raw")
    if removed is not None:
        rows = rows.unionByName(removed.select("label_id", F.lit(2).alias("part"), F.col("position").cast("long").alias("o"), "raw"))
    g = rows.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("part", "o", "raw"))).alias("r"))
    take = lambda p: F.transform(F.filter("r", lambda x: x["part"] == p), lambda x: x["raw"])
    opt = F.when(F.size(take(1)) > 0, F.array(F.concat(F.lit("may contain: "), F.array_join(take(1), ", ")))).otherwise(F.array().cast("array<string>"))
    return g.select("label_id", F.array_join(F.concat(take(0), opt, take(2)), ", ").alias("text"))


def review_queue(items: DataFrame) -> DataFrame:
    """Items that need review with up to three candidates; ``bulk`` marks those a bulk accept may take.

    Up to two AI suggestions are always among the three, after the best of the others.
    """
    ai = F.slice(F.filter("candidates", lambda x: x["source"] == "ai_agent"), 1, 2)
    others = F.filter("candidates", lambda x: x["source"] != "ai_agent")
    c = F.slice(F.concat(F.slice(others, F.lit(1), F.greatest(F.lit(1), 3 - F.size(ai))), ai), 1, 3)
    return (items.where(needs_review(F.col("status"), F.col("optional"), F.col("via") != "none"))
            .select("label_id", "idx", "raw", "status", c.alias("candidates"),
                    ((F.col("status") == "suggested") & F.col("high_confidence") & ~F.exists(c, lambda x: x["source"] == "ai_agent")).alias("bulk")))


def bulk_accept(queue: DataFrame) -> DataFrame:
    """Choices rows accepting the first candidate of every bulk-acceptable item."""
    return queue.where("bulk").select("label_id", X.fold_key(F.col("raw"), False).alias("key"), F.lit("accept").alias("action"), F.get("candidates", F.lit(0))["inci_name"].alias("value"))


def status_counts(items: DataFrame) -> DataFrame:
    """Bucket counts of the non-optional items of each label and how many still need review."""
    names = ["inci", "synonym", "class", "pubchem", "accepted", "kept", "suggested", "ambiguous", "not_found", "unavailable"]
    main = items.where(~F.col("optional"))
    count = lambda *b: F.count_if(F.col("bucket").isin(*b))
    return main.groupBy("label_id").agg(*[count(n).alias(n) for n in names], F.count("*").alias("n_items"),
                                        count("suggested", "ambiguous", "not_found", "unavailable").alias("needs_review"))


def supported_proposals(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """proposals(session_id, ord, inci_name, evidence_ids, rationale) backed by evidence(session_id, tool_call_id, key, display, source, source_id).

    A name is kept only when one of its evidence ids returned that key; display and source come from the evidence; two kept
    names with one key void the whole answer, and so do more than three names; the rationale is cut to 30 words.
    """
    long = proposals.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 3").select("session_id")
    p = proposals.join(long, "session_id", "left_anti").select("session_id", "ord", X.match_key(F.col("inci_name")).alias("key"), F.array_join(F.slice(F.split(X.strip(F.col("rationale")), r"\s+"), 1, 30), " ").alias("rationale"),
                                               F.posexplode("evidence_ids").alias("e", "tool_call_id"))
    ev = evidence.groupBy("session_id", "tool_call_id", "key").agg(F.min(F.struct("display", "source", "source_id")).alias("v"))
    hit = p.join(ev, ["session_id", "tool_call_id", "key"])
    kept = hit.groupBy("session_id", "ord").agg(F.min_by("v", "e").alias("v"), F.first("rationale").alias("rationale"))
    kept = kept.withColumn("vkey", X.match_key(F.col("v.display")))
    dup = kept.groupBy("session_id", "vkey").agg(F.count("*").alias("n")).where("n > 1").select("session_id").distinct()
    return kept.join(dup, "session_id", "left_anti").select("session_id", "ord", F.col("v.display").alias("inci_name"), F.col("v.source").alias("source"), F.col("v.source_id").alias("source_id"), "rationale")


def attach_proposals(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """items + proposals(label_id, idx, ord, inci_name, source, source_id, rationale): new keys go after an open item's own candidates (5 in all).

    Only items nobody could settle are eligible; they become suggestions, never high confidence.
    """
    eligible = F.col("status").isin("not_found", "lookup_unavailable", "ambiguous") | ((F.col("status") == "suggested") & ~F.col("high_confidence"))
    p = proposals.join(items.where(eligible).select("label_id", "idx", "raw"), ["label_id", "idx"])
    score = F.round(confusion_score(X.fold_key(F.col("raw")), X.match_key(F.col("inci_name"))), 2)
    cand = F.struct(F.upper("inci_name").alias("inci_name"), score.alias("score"), F.lit("ai_agent").alias("source"), "source_id", F.array().cast("array<string>").alias("edits"),
                    F.trim(F.concat(F.lit("AI suggestion ("), "source", F.lit("): "), F.coalesce("rationale", F.lit("")))).alias("note"))
    p = p.select("label_id", "idx", "ord", cand.alias("c"), X.match_key(F.col("inci_name")).alias("k"))
    g = p.groupBy("label_id", "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "k", "c"))).alias("new"))
    j = items.join(g, ["label_id", "idx"], "left")
    have = F.transform("candidates", lambda c: X.fold_key(c["inci_name"]))
    fresh = F.transform(F.filter("new", lambda n: ~F.array_contains(have, n["k"])), lambda n: n["c"])
    got = F.col("new").isNotNull()
    note = F.lit("Includes an AI suggestion: not applied until you accept it. It only offers names that a lookup returned.")
    return (j.withColumn("candidates", F.when(got, F.slice(F.concat("candidates", fresh), 1, 5)).otherwise(F.col("candidates")))
            .withColumn("notes", F.when(got, F.concat("notes", F.array(note))).otherwise(F.col("notes")))
            .withColumn("layer", F.when(got & (F.col("status") != "suggested"), "ai_agent").otherwise(F.col("layer")))
            .withColumn("status", F.when(got, "suggested").otherwise(F.col("status")))
            .withColumn("high_confidence", F.when(got, F.lit(False)).otherwise(F.col("high_confidence"))).drop("new"))


def neighbours(items: DataFrame) -> DataFrame:
    """Previous and next identified (or printed) name as context of each item."""
    w = Window.partitionBy("label_id").orderBy("idx")
    name = F.coalesce("inci_name", "raw")
    return items.withColumn("prev_name", F.coalesce(F.lag(name).over(w), F.lit(""))).withColumn("next_name", F.coalesce(F.lead(name).over(w), F.lit("")))


def guess_roles(items: DataFrame, functions: DataFrame) -> DataFrame:
    """Role of the top candidate (a non-AI one when there is one) of unidentified items; always flagged as a guess."""
    plain = F.get(F.filter("candidates", lambda c: c["source"] != "ai_agent"), F.lit(0))["inci_name"]
    g = items.where("inci IS NULL").select("label_id", "idx", F.coalesce(plain, F.get("candidates", F.lit(0))["inci_name"]).alias("guess_name")).where("guess_name IS NOT NULL")
    f = functions.select(X.match_key(F.col("inci"), False).alias("k"), "functions")
    return g.withColumn("k", X.match_key(F.col("guess_name"), False)).join(f, "k").select("label_id", "idx", "guess_name", "functions", F.lit(True).alias("is_guess"))


def build_products(items: DataFrame, pack_text: DataFrame | None = None) -> DataFrame:
    """One product row per label: identified names and unresolved text in listing order, price hints from the pack text."""
    main = items.where(~F.col("optional"))
    row = F.struct("idx", F.when(F.col("inci").isNotNull(), X.title_case(F.col("inci"))).alias("name"), "raw")
    g = main.groupBy("label_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    out = g.select("label_id", F.transform(F.filter("r", lambda x: x["name"].isNotNull()), lambda x: x["name"]).alias("ingredients"),
                   F.transform(F.filter("r", lambda x: x["name"].isNull()), lambda x: x["raw"]).alias("unresolved"))
    if pack_text is None:
        return out
    p = pack_text.select("label_id", parse_price(F.col("text")).alias("p")).select("label_id", "p.mrp", "p.volume_ml")
    return out.join(p, "label_id", "left")
