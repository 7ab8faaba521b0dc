"""Label text to identified items: the full resolution ladder as one set of joins.

Every string that any later step may want to look up (segments, joined neighbours, split halves) is known once the
segments are.  They are pooled, de-duplicated and looked up once; merge and split decisions are then windows over the
segments of a label.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import by_rows, counted, durable
from .dictionary import NameDictionary
from .matching import compound_lookup, fuzzy_key, fuzzy_topk, static_ladder, word_swap_notes
from .segment import segment_labels


# The calibrated thresholds of the resolver.
@dataclass(frozen=True)
class Thresholds:
    """Decision thresholds; the defaults are the calibrated ones."""

    high_score: float = 0.80
    high_margin: float = 0.08
    max_unexplained: int = 1
    dominant_score: float = 0.85
    dominant_margin: float = 0.15
    suggest_floor: float = 0.55
    merge_score: float = 0.75
    merge_gain: float = 0.10
    split_min: float = 0.60
    split_gain: float = 0.10
    max_merge_tries: int | None = 40
    max_split_tries: int | None = 25
    split_whole_unexplained: int = 3
    split_part_unexplained: int = 2


@dataclass
class Resolution:
    items: DataFrame
    removed: DataFrame
    segments: int = 0  # of the labels, before merges and splits


CANDIDATE = "struct<inci_name:string,score:double,source:string,source_id:string,edits:array<string>,note:string>"


def split_non_ingredients(segs: DataFrame, static: DataFrame) -> DataFrame:
    """Segments with their static match (nulls when none) and ``kind`` of removal (null = stays)."""
    kind = F.when(F.col("layer").isNotNull(), F.lit(None)).when(X.is_long_text(F.col("raw")), "long_text").otherwise(X.non_ingredient_kind(F.col("raw")))
    return segs.join(static, "raw", "left").withColumn("kind", kind)


def greedy_pairs(df: DataFrame, by: list[str], order: str, qualifies: Column, tried: Column, max_tries: int | None) -> DataFrame:
    """Left-to-right, non-overlapping choice among neighbouring pairs.

    ``qualifies``/``tried`` describe the pair (row, next row).  Runs of qualifying pairs are islands; greedy choice takes
    every second pair of an island.  A pair right after a chosen one is not tried; choices past ``max_tries`` are undone.
    """
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_q", F.coalesce(qualifies, F.lit(False))).withColumn("_t", F.coalesce(tried, F.lit(False)))
    df = df.withColumn("_run", F.sum((~F.col("_q")).cast("int")).over(w))
    odd = F.row_number().over(Window.partitionBy(*by, "_run", "_q").orderBy(order)) % 2 == 1
    df = df.withColumn("_pick", F.col("_q") & odd)
    after = F.coalesce(F.lag("_pick").over(w), F.lit(False))
    tries = F.sum((F.col("_t") & ~after).cast("int")).over(w)
    pick = F.col("_pick") if max_tries is None else F.col("_pick") & (tries <= max_tries)
    return df.withColumn("merge_next", pick).withColumn("merged_away", F.coalesce(F.lag("merge_next").over(w), F.lit(False))).drop("_q", "_t", "_run", "_pick")


def confidence_flag(cands: Column, t: Thresholds) -> Column:
    """High confidence: clear score and margin with explained edits, or dominant; never with two or more extra characters."""
    top, second = F.get(cands, F.lit(0)), F.get(cands, F.lit(1))
    margin = top["score"] - F.coalesce(second["score"], F.lit(0.0))
    extra = F.size(F.filter(top["edits"], lambda e: e.startswith("extra")))
    clear = (top["score"] >= t.high_score) & (margin >= t.high_margin) & (top["unexplained"] <= t.max_unexplained)
    dominant = (top["score"] >= t.dominant_score) & (margin >= t.dominant_margin)
    return (clear | dominant) & (extra < 2)


def suggestion_notes(cands: Column) -> Column:
    edits = F.get(cands, F.lit(0))["edits"]
    extra = F.size(F.filter(edits, lambda e: e.startswith("extra")))
    dropped = F.transform(F.filter(edits, lambda e: e.contains("not visible")), lambda e: F.concat(e, F.lit(".")))
    warn = F.when(extra >= 2, F.array(F.lit("The text has extra characters, so a word may be cut off or merged with its neighbour: check the pack.")))
    return F.concat(F.coalesce(warn, F.array().cast("array<string>")), dropped)


def resolve_labels(labels: DataFrame, d: NameDictionary, t: Thresholds = Thresholds(), no_merge: DataFrame | None = None,
                   compounds: DataFrame | None = None, use_compounds: bool = False, one_source: bool = False) -> Resolution:
    """labels(label_id, source_index, raw[, ocr_conf]) -> items in label order and removed fragments.

    ``no_merge(label_id, raw)`` lists fragments to keep apart; ``compounds`` is a snapshot for the compound layer.
    """
    d = d.materialised()
    segs = durable(segment_labels(labels, one_source))
    first = durable(static_ladder(segs.select("raw").distinct(), d))
    tagged = durable(split_non_ingredients(segs, counted(first, first.count())))
    removed = tagged.where("kind IS NOT NULL").select("label_id", "position", "source_index", "raw", X.removal_reason(F.col("kind")).alias("reason"), "kind")

    rows = tagged.count()
    # every window below is over a label's rows, which stay where they are dealt unless a join with a large look-up moves them
    states = by_rows(tagged.where("kind IS NULL"), rows, "label_id").drop("kind").withColumn("pending", F.col("layer").isNull())
    if no_merge is None:
        states = states.withColumn("apart", F.lit(False))
    else:
        nm = no_merge.select("label_id", X.match_key(F.col("raw")).alias("_nk")).distinct().withColumn("apart", F.lit(True))
        states = states.withColumn("_nk", X.fold_key(F.col("raw"))).join(nm, ["label_id", "_nk"], "left").withColumn("apart", F.coalesce("apart", F.lit(False))).drop("_nk")
    w = Window.partitionBy("label_id").orderBy("position")
    me = F.struct("raw", "source_index", "pending", "apart")
    states = states.withColumn("n_words", X.word_count(F.col("raw"))).withColumn("nxt", F.lead(me).over(w))
    eligible = (F.col("pending") & F.col("nxt.pending") & (F.col("source_index") == F.col("nxt.source_index"))
                & ~F.col("apart") & ~F.col("nxt.apart") & (F.col("n_words") <= 3) & (X.word_count(F.col("nxt.raw")) <= 3))
    states = states.withColumn("joined", F.when(eligible, F.concat_ws(" ", "raw", "nxt.raw")))

    # ---- one look-up for every string any step needs
    words = F.split("raw", r"\s+")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array(
        F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, F.size(words)), " ")))
    open_raw = states.where("pending").select("raw", "n_words").distinct()
    halves = open_raw.where(F.col("n_words").between(2, 5)).select("raw", F.posexplode(cuts).alias("cut", "h")).select("raw", "cut", F.get("h", F.lit(0)).alias("l"), F.get("h", F.lit(1)).alias("r"))
    pool = (open_raw.select(F.col("raw").alias("text"), F.lit(False).alias("fresh"))
            .unionByName(states.where("joined IS NOT NULL").select(F.col("joined").alias("text"), F.lit(True).alias("fresh")))
            .unionByName(halves.select(F.explode(F.array("l", "r")).alias("text"), F.lit(True).alias("fresh"))))
    pool = pool.groupBy("text").agg(F.min("fresh").alias("fresh")).withColumn("key", fuzzy_key(F.col("text")))
    pool = durable(pool)
    fz = fuzzy_topk(pool.select("key").distinct(), d, 3, t.suggest_floor)
    again = static_ladder(pool.where("fresh").select(F.col("text").alias("raw")), d)
    known = F.struct("layer", "inci_name", "category", "cas", "ec", "source", "notes")
    # only texts of which something is known: most texts of a corpus that is no label are like no name
    facts = durable(pool.join(fz, "key").select("text", "cands").join(again.select(F.col("raw").alias("text"), known.alias("hit")), "text", "full_outer")
                    .select("text", F.coalesce("cands", F.array().cast("array<struct<inci_name:string,score:double,edits:array<string>,unexplained:int>>")).alias("cands"), "hit"))
    n_facts = facts.count()
    quick = facts.select("text", F.coalesce(F.get("cands", F.lit(0))["score"], F.lit(0.0)).alias("score"),
                         F.coalesce(F.get("cands", F.lit(0))["unexplained"], F.lit(99)).alias("un"), F.col("hit").isNotNull().alias("static"))

    # ---- the best place to split every open text where a comma may be lost
    q = lambda side: quick.select(F.col("text").alias(side), F.when(F.col("static"), 1.0).otherwise(F.col("score")).alias(f"{side}s"),
                                  F.when(F.col("static"), 0).otherwise(F.col("un")).alias(f"{side}u"))
    own = quick.select(F.col("text").alias("raw"), F.col("score").alias("own"), F.col("un").alias("own_un"))
    # a half of which nothing is known has score 0 and is below every floor but 0
    with_half = "inner" if t.split_min > 0 else "left"
    unknown = {"ls": 0.0, "lu": 99, "rs": 0.0, "ru": 99, "own": 0.0, "own_un": 99}
    h = halves.join(counted(q("l"), n_facts), "l", with_half).join(counted(q("r"), n_facts), "r", with_half).join(counted(own, n_facts), "raw", "left").na.fill(unknown)
    lu, ru = F.when(F.col("ls") == 1.0, 0).otherwise(F.col("lu")), F.when(F.col("rs") == 1.0, 0).otherwise(F.col("ru"))
    explained = (F.col("own_un") >= t.split_whole_unexplained) & (F.greatest(lu, ru) <= t.split_part_unexplained)
    h = h.where((F.least("ls", "rs") >= t.split_min) & (((F.col("ls") + F.col("rs")) / 2 - F.col("own") >= t.split_gain) | explained))
    best_cut = h.groupBy("raw").agg(F.min(F.struct((-(F.col("ls") + F.col("rs"))).alias("s"), "cut", "l", "r")).alias("b")).select("raw", F.array("b.l", "b.r").alias("halves"))
    alone = durable(own.drop("own_un").join(best_cut, "raw", "full_outer").withColumn("own", F.coalesce("own", F.lit(0.0))).where((F.col("own") > 0) | F.col("halves").isNotNull()))

    # ---- merge neighbouring fragments
    both = quick.select(F.col("text").alias("joined"), F.when(F.col("static"), 1.0).otherwise(F.col("score")).alias("together")).where("together > 0")
    # rows that ask nothing - resolved ones, and those without a neighbour to join - get a key of their own, so that neither nulls nor the
    # names on most labels meet in one partition
    aside = F.concat(F.lit("\u0001"), F.xxhash64("label_id", "position").cast("string"))
    states = states.withColumn("_raw", F.when(F.col("pending"), F.col("raw")).otherwise(aside)).withColumn("_joined", F.coalesce("joined", aside))
    states = states.join(counted(alone.withColumnRenamed("raw", "_raw"), alone.count()), "_raw", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    states = states.join(counted(both.withColumnRenamed("joined", "_joined"), n_facts), "_joined", "left").drop("_raw", "_joined")
    nxt_own = F.lead("own").over(w)
    states = states.withColumn("gain", F.col("together") - F.greatest(F.col("own"), nxt_own))
    states = greedy_pairs(states, ["label_id"], "position", (F.col("together") >= t.merge_score) & (F.col("gain") >= t.merge_gain),
                          F.col("joined").isNotNull(), t.max_merge_tries)
    states = states.where(~F.col("merged_away"))

    # ---- split where a comma was lost
    can_split = F.col("pending") & ~F.col("merge_next") & F.col("n_words").between(2, 5)
    states = states.withColumn("split_try", F.sum(can_split.cast("int")).over(w))
    within = F.lit(True) if t.max_split_tries is None else F.col("split_try") <= t.max_split_tries
    parts = F.when(can_split & within & F.col("halves").isNotNull(), F.col("halves"))
    text = F.when(F.col("merge_next"), F.col("joined")).otherwise(F.col("raw"))
    states = states.withColumn("is_split", parts.isNotNull()).withColumn("fragments", F.when(F.col("merge_next"), F.array("raw", "nxt.raw")))
    states = states.select("*", F.posexplode(F.coalesce(parts, F.array(text))).alias("part", "text"))

    # ---- what is still open takes the static match of its new text, else its candidates
    named = facts.select("text", F.explode("cands.inci_name").alias("inci_name"))
    swaps = word_swap_notes(named, d).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("inci_name", "note"))).alias("swap"))
    final = facts.join(swaps, "text", "left").where(F.col("hit").isNotNull() | (F.size("cands") > 0))
    states = states.join(counted(final.withColumnRenamed("hit", "new_hit"), n_facts), "text", "left")
    states = states.withColumn("cands", F.coalesce("cands", F.array().cast("array<struct<inci_name:string,score:double,edits:array<string>,unexplained:int>>")))
    old = F.struct("layer", "inci_name", "category", "cas", "ec", "source", "notes")
    states = states.withColumn("hit", F.when(F.col("pending"), F.col("new_hit")).otherwise(old))
    open_ = F.col("hit").isNull()
    if use_compounds:
        plain = X.strip_parens(X.strip_nano(F.col("text")))
        states = states.withColumn("lookup_text", F.when(open_, F.when(plain == "", F.col("text")).otherwise(plain)))
        found = compound_lookup(states.where("lookup_text IS NOT NULL").select(F.col("lookup_text").alias("text")), compounds)
        found = found.select(F.col("text").alias("_look"), F.col("status").alias("c_status"), "cid", F.col("names").alias("c_names"))
        states = states.withColumn("_look", F.coalesce("lookup_text", aside)).join(found, "_look", "left").drop("_look")
        # an unreadable glyph keeps a text out of the compound layer
        states = states.withColumn("c_status", F.when(~F.col("text").contains("?") & (F.length(X.fold_key(F.col("text"))) >= 4), F.col("c_status")))
    else:
        states = states.withColumn("c_status", F.lit(None).cast("string")).withColumn("cid", F.lit(None).cast("long")).withColumn("c_names", F.array().cast("array<string>"))
    compound = open_ & (F.col("c_status") == "match")
    ambiguous = open_ & (F.col("c_status") == "ambiguous")
    suggested = open_ & (F.size("cands") > 0)
    none = F.lit(None).cast("string")
    no_notes = F.array().cast("array<string>")
    dict_cands = F.transform("cands", lambda c: F.struct(c["inci_name"].alias("inci_name"), c["score"].alias("score"), F.lit("dictionary").alias("source"), none.alias("source_id"), c["edits"].alias("edits"),
                                                         F.get(F.map_values(F.map_filter(F.coalesce("swap", F.create_map().cast("map<string,string>")), lambda k, v: k == c["inci_name"])), F.lit(0)).alias("note")))
    comp_cands = F.transform("c_names", lambda n: F.struct(F.upper(n).alias("inci_name"), F.lit(0.0).alias("score"), F.lit("compound").alias("source"), none.alias("source_id"), no_notes.alias("edits"), F.lit("compound name suggestion").alias("note")))
    status = (F.when(~open_ | F.coalesce(compound, F.lit(False)), "resolved").when(ambiguous, "ambiguous").when(suggested, "suggested")
              .when(F.col("c_status") == "unavailable", "lookup_unavailable").otherwise("not_found"))
    layer = (F.when(~open_, F.col("hit.layer")).when(compound | ambiguous, "compound_match").when(suggested, "fuzzy").otherwise(F.col("status")))
    merged_note = F.when(F.col("merge_next"), F.array(F.lit("Merged from 2 fragments; you can split it again.")))
    split_note = F.when(F.col("is_split"), F.array(F.lit("Split from one token (a comma may have been lost); check the boundary.")))
    tail = (F.when(~open_, F.coalesce("hit.notes", no_notes)).when(compound, F.array(F.lit("Compound record match: identity only, not a safety statement.")))
            .when(suggested & F.coalesce(~ambiguous, F.lit(True)), suggestion_notes(F.col("cands"))).otherwise(no_notes))
    high = F.when(~open_ | F.coalesce(compound, F.lit(False)), F.lit(True)).when(F.col("status") == "suggested", confidence_flag(F.col("cands"), t)).otherwise(F.lit(False))
    out_w = Window.partitionBy("label_id").orderBy("position", "part")
    items = states.withColumn("status", status).select(
        "label_id", (F.row_number().over(out_w) - 1).alias("idx"), "source_index", F.col("text").alias("raw"), F.coalesce("fragments", no_notes).alias("fragments"),
        F.when(F.col("merge_next"), 2).alias("merged_from"), F.when(F.col("is_split"), F.col("raw")).alias("split_from"),
        "ocr_conf", "optional", "tags", "status", layer.alias("layer"),
        F.when(compound, F.upper("text")).otherwise(F.col("hit.inci_name")).alias("inci_name"), F.col("hit.category").alias("category"),
        F.col("hit.cas").alias("cas"), F.col("hit.ec").alias("ec"), F.when(compound, "compound").otherwise(F.col("hit.source")).alias("source"),
        F.when(compound, F.concat(F.lit("CID "), F.col("cid").cast("string"))).alias("source_id"),
        F.when(F.col("status") == "suggested", dict_cands).when(F.col("status") == "ambiguous", comp_cands).otherwise(F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"),
        high.alias("high_confidence"), F.concat(F.coalesce(merged_note, no_notes), F.coalesce(split_note, no_notes), tail).alias("notes"))
    return Resolution(items, removed, rows)


def exact_baseline(labels: DataFrame, d: NameDictionary, one_source: bool = False) -> DataFrame:
    """Comma split and exact/alias look-up only: the comparison run."""
    from .segment import split_top_level
    rows = labels.withColumn("raw", X.nfkc(F.col("raw")))
    items = F.filter(F.transform(split_top_level(X.clean_text(F.col("raw"), normalise=False)), X.strip), lambda p: p != "")
    ex = rows.select("label_id", F.posexplode(items).alias("idx", "raw"))
    keyed = ex.withColumn("key", X.fold_key(F.col("raw")))
    hit = d.lookup.select("key", "inci_name")
    return keyed.join(hit, "key", "left").select("label_id", "idx", "raw", F.when(F.col("inci_name").isNotNull(), "resolved").otherwise("not_found").alias("status"),
                                                 F.when(F.col("inci_name").isNotNull(), "inci_exact").otherwise("not_found").alias("layer"), "inci_name")
