"""Printed claims: extraction from pack text, verdicts against the ingredient list, misspelling notices."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X
from .dictionary import first_per
from .matching import find_phrases, one_edit_neighbours
from .segment import vitamin_codes

VERDICTS = ["contradiction", "needs_context", "matches", "consistent", "not_verifiable"]
MIN_CONF, MIN_NOTICE = 80, 3
KIND_ORDER = ["free_from", "unverifiable", "vitamin", "ingredient"]


def extract_claims(texts: DataFrame, phrases: DataFrame, vitamins: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, claim_id, kind, matched, edits): the first phrase hit of each claim.

    phrases(claim_id, kind, ord, phrase); vitamins(code, claim_id).  A claim found as a vitamin list and as a term keeps the
    vitamin reading, which comes first.
    """
    hits = find_phrases(texts, phrases, id_col, text_col)
    h = hits.join(phrases.select("phrase", "claim_id", "kind", "ord"), "phrase").select(id_col, "claim_id", "kind", "ord", "matched", "edits")
    if vitamins is not None:
        v = texts.select(id_col, F.posexplode(vitamin_codes(F.col(text_col))).alias("o", "v")).select(id_col, "o", "v.code", "v.pro").join(vitamins, "code")
        name = F.concat(F.when(F.col("pro"), "Pro-vitamin ").otherwise("Vitamin "), "code")
        h = h.unionByName(v.select(id_col, "claim_id", F.lit("vitamin").alias("kind"), F.col("o").cast("int").alias("ord"), name.alias("matched"), F.lit(0).alias("edits")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    best = first_per(h, [id_col, "claim_id"], rank, F.col("ord"), F.col("matched"))
    return best.select(id_col, "claim_id", F.when(F.col("kind") == "vitamin", "ingredient").otherwise(F.col("kind")).alias("kind"), "matched", "edits")


def label_evidence(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Per label, what the claim matrix asks about: the number of unreviewed items, and the (idx, name) lists of colourants and family members.

    items(label_id, idx, raw, inci, status, category, optional, via). A list holds items of one label only.
    """
    from .review import NEEDS_REVIEW
    fam = hits.groupBy("inci").agg(F.collect_set("family_id").alias("fams"))  # families of one name: a handful
    it = items.join(fam, "inci", "left").withColumn("fams", F.coalesce("fams", F.array().cast("array<string>"))).withColumn("key", X.match_key(F.coalesce("inci", F.lit("")), False))
    has = lambda f: F.array_contains("fams", f)
    benzyl = F.col("key") == "BENZYLALCOHOL"
    colour = (F.col("status") == "resolved") & (F.col("category") == "colorant")
    named = F.struct(F.col("idx"), X.title_case(F.col("inci")).alias("name"))
    printed = F.struct(F.col("idx"), F.col("raw").alias("name"))

    def those(cond, shown=named):
        return F.array_sort(F.collect_list(F.when(cond, shown)))
    return it.groupBy("label_id").agg(
        F.count_if(~F.col("optional") & (F.col("via") == "none") & F.col("status").isin(*NEEDS_REVIEW)).alias("unreviewed"),
        those(has("fragrance_mixtures")).alias("parfum"), those(has("eu_fragrance_allergens") & ~benzyl).alias("other_allergen"),
        those(has("eu_fragrance_allergens") & benzyl).alias("benzyl"), those(has("preservatives_annex_v") & ~benzyl).alias("other_preservative"),
        those(has("solvent_alcohols")).alias("solvent"), those(has("fatty_alcohols")).alias("fatty"),
        those(colour & ~F.col("optional"), printed).alias("colour"), those(colour & F.col("optional"), printed).alias("colour_optional"))


#: Verdict of each outcome; None: consistent, unless items of the label are still unreviewed.
OUTCOMES = {
    "unverifiable": "not_verifiable", "unsupported": "needs_context",
    "ingredient.named": "matches", "ingredient.open": "needs_context", "ingredient.missing": "contradiction",
    "fragrance.mixture": "contradiction", "fragrance.allergen": "needs_context", "fragrance.benzyl": "needs_context", "fragrance.preservative": None, "fragrance.none": None,
    "alcohol.solvent": "contradiction", "alcohol.none": None,
    "colorant.named": "contradiction", "colorant.optional": "needs_context", "colorant.none": None,
    "family.member": "contradiction", "family.none": None,
}
#: Wording used where the caller gives none: {names}, {label}, {reason}, {note} and {caveat} are filled in.
WORDING = {
    "unverifiable": "{reason} Ingredients cannot show whether it holds.", "unsupported": "{reason}",
    "ingredient.named": "On the list: {names}. {note}", "ingredient.open": "{label} is not among the confirmed ingredients. {caveat}", "ingredient.missing": "{label} is not on the list. {note}",
    "fragrance.mixture": "{names} on the list stands for a fragrance mixture.", "fragrance.allergen": "No fragrance mixture, but labelled fragrance allergens: {names}. {caveat}",
    "fragrance.benzyl": "{names} can preserve or scent; no other preservative is named. {caveat}", "fragrance.preservative": "{names}: with another preservative on the list, probably no scent. {caveat}",
    "fragrance.none": "No fragrance mixture and no labelled allergen among the confirmed ingredients. {caveat}",
    "alcohol.solvent": "Solvent alcohol on the list: {names}.", "alcohol.none": "No solvent alcohol is named; fatty alcohols do not count: {names}. {caveat}",
    "colorant.named": "Colourants on the list: {names}.", "colorant.optional": "Colourants only in the optional section: {names}. {caveat}", "colorant.none": "No colourant is named. {caveat}",
    "family.member": "Members of this family on the list: {names}. {note}", "family.none": "No confirmed ingredient is of this family. {note} {caveat}",
}


def check_claims(detected: DataFrame, items: DataFrame, hits: DataFrame, rules: DataFrame, wording: dict[str, str] | None = None) -> DataFrame:
    """(label_id, claim_id, kind, verdict, ord, outcome, items, names, explanation, source, confidence): each printed claim against the identified ingredients.

    detected(label_id, claim_id, kind); rules(claim_id, logic, family_id, inci array, patterns array[, label, reason, note, source, confidence]): logic is
    one of fragrance, alcohol, colorant, unsupported, family for free-from claims. ``items`` are the places of the ingredients that the
    verdict rests on and ``names`` how they read; the explanation is the outcome's wording with these filled in.
    """
    for c in ("label", "reason", "note", "source", "confidence"):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast("string"))
    kinds = "array<struct<idx:int,name:string>>"
    none = F.array().cast(kinds)
    # a label's rows meet by the label alone, so that the claims with all that is known of their label are never shuffled
    evidence = label_evidence(items.withColumn("idx", F.col("idx").cast("int")), hits)
    identified = items.where("inci IS NOT NULL").withColumn("idx", F.col("idx").cast("int"))
    members = (identified.join(hits.select("inci", "family_id").distinct(), "inci").groupBy("label_id")
               .agg(F.collect_list(F.struct("family_id", "idx", "inci")).alias("members")))
    have = identified.groupBy("label_id").agg(F.collect_list(F.struct("idx", "inci")).alias("have"))
    wanted = rules.groupBy("claim_id").agg(F.collect_list(F.struct("inci", "patterns")).alias("wanted"))
    named = lambda x: F.struct(x["idx"].alias("idx"), X.title_case(x["inci"]).alias("name"))
    d = detected.join(rules, "claim_id", "left").join(wanted, "claim_id", "left").join(evidence, "label_id", "left").join(members, "label_id", "left").join(have, "label_id", "left")
    d = d.withColumn("member", F.array_sort(F.transform(F.filter("members", lambda x: x["family_id"] == F.col("family_id")), named)))

    # ingredient claims: by key or by a pattern of the claim, on that label's identified names
    def found(rule):
        keys = F.transform(F.coalesce(rule["inci"], F.array().cast("array<string>")), lambda n: X.fold_key(n, False))
        fits = lambda x: F.array_contains(keys, X.fold_key(x["inci"], False)) | F.exists(F.coalesce(rule["patterns"], F.array().cast("array<string>")), lambda p: F.rlike(x["inci"], F.concat(F.lit("(?i)"), p)))
        return F.transform(F.filter("have", fits), named)
    d = d.withColumn("named", F.when(F.col("kind") == "ingredient", F.array_sort(F.flatten(F.transform("wanted", found))))).drop("members", "have", "wanted")
    some = lambda c: F.size(F.coalesce(c, none)) > 0
    open_ = F.coalesce("unreviewed", F.lit(0)) > 0
    logic = F.col("logic")
    fragrance = (F.when(some("parfum"), "fragrance.mixture").when(some("other_allergen"), "fragrance.allergen").when(some("benzyl") & ~some("other_preservative"), "fragrance.benzyl")
                 .when(some("benzyl"), "fragrance.preservative").otherwise("fragrance.none"))
    outcome = (F.when(F.col("kind") == "unverifiable", "unverifiable")
               .when(F.col("kind") == "ingredient", F.when(some("named"), "ingredient.named").when(open_, "ingredient.open").otherwise("ingredient.missing"))
               .when(logic == "unsupported", "unsupported").when(logic == "fragrance", fragrance)
               .when(logic == "alcohol", F.when(some("solvent"), "alcohol.solvent").otherwise("alcohol.none"))
               .when(logic == "colorant", F.when(some("colour"), "colorant.named").when(some("colour_optional"), "colorant.optional").otherwise("colorant.none"))
               .otherwise(F.when(some("member"), "family.member").otherwise("family.none")))
    d = d.withColumn("outcome", outcome)
    rests_on = {"ingredient.named": "named", "fragrance.mixture": "parfum", "fragrance.allergen": "other_allergen", "fragrance.benzyl": "benzyl", "alcohol.solvent": "solvent", "alcohol.none": "fatty",
                "colorant.named": "colour", "colorant.optional": "colour_optional", "family.member": "member"}
    shown = F.when(F.col("outcome") == "fragrance.preservative", F.concat("benzyl", "other_preservative"))
    fixed = F.when(F.lit(False), F.lit(None).cast("string"))
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for o, verdict in OUTCOMES.items():
        is_o = F.col("outcome") == o
        if o in rests_on:
            shown = shown.when(is_o, F.col(rests_on[o]))
        fixed = fixed.when(is_o, F.lit(verdict) if verdict else F.when(open_, "needs_context").otherwise("consistent"))
        text = text.when(is_o, F.lit((WORDING | (wording or {}))[o]))
    d = d.withColumn("ev", F.coalesce(shown, none)).withColumn("names", F.array_join(F.col("ev.name"), ", "))
    n = F.col("unreviewed")
    caveat = F.when(open_, F.concat(n.cast("string"), F.when(n > 1, " listed ingredients are").otherwise(" listed ingredient is"), F.lit(" not confirmed yet."))).otherwise("")
    for slot, value in (("names", F.col("names")), ("label", F.coalesce("label", "claim_id")), ("reason", F.coalesce("reason", F.lit(""))), ("note", F.coalesce("note", F.lit(""))), ("caveat", caveat)):
        text = F.replace(text, F.lit("{" + slot + "}"), value)
    d = d.select("label_id", "claim_id", "kind", fixed.alias("verdict"), "outcome", F.col("ev.idx").alias("items"), "names", F.trim(F.regexp_replace(text, " {2,}", " ")).alias("explanation"), "source", "confidence")
    w = Window.partitionBy("label_id").orderBy(F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")), "claim_id")
    return d.withColumn("ord", F.row_number().over(w) - 1)


def misspellings(words: DataFrame, dictionary: DataFrame, exclude: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, word, suggestion): clearly read words that are one edit from an ordinary word; null confidence (typed text) never counts.

    words(id, text, confidence); dictionary(word).  Words are de-duplicated before the neighbour search.
    """
    w = words.where(F.col("confidence") >= MIN_CONF).select(id_col, F.explode(F.split("text", "[^A-Za-z]+")).alias("part")).select(id_col, F.lower("part").alias("word"))
    w = w.where(F.length("word") >= 4).distinct()
    vocab = dictionary.select(F.lower(F.col(dictionary.columns[0])).alias("word")).distinct()
    unknown = w.select("word").distinct().join(vocab, "word", "left_anti")
    if exclude is not None:
        unknown = unknown.join(exclude.select(F.lower(F.col(exclude.columns[0])).alias("word")).distinct(), "word", "left_anti")
    near = one_edit_neighbours(unknown, vocab)
    best = near.groupBy("word").agg(F.min(F.struct(F.length("suggestion").alias("n"), "suggestion")).alias("b")).select("word", F.col("b.suggestion").alias("suggestion"))
    return w.join(best, "word").select(id_col, "word", "suggestion")


def misspelling_notice(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Texts with enough such words for a notice."""
    return found.groupBy(id_col).agg(F.count("*").alias("n_words")).where(F.col("n_words") >= MIN_NOTICE)
