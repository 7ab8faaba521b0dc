"""Sourced rules over identified items: families, avoid lists, profile rules, notes, regulation, summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .dictionary import first_per

TIERS = ["avoid", "caution", "note"]
# Label of each annex in a regulatory line.
ANNEX_LABEL = {
    "II_prohibited_identified": "Prohibited in cosmetic products (Annex II)",
    "III": "Restricted substance (Annex III)",
    "IV": "Permitted colourant (Annex IV)",
    "V": "Permitted preservative (Annex V)",
    "VI": "Permitted UV filter (Annex VI)",
}


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def cap_tier(tier: Column, cap: Column) -> Column:
    """No stronger than the cap; no cap leaves the tier."""
    return F.when(cap.isNotNull() & (tier_rank(tier) < tier_rank(cap)), cap).otherwise(tier)


def member_index(members: DataFrame) -> DataFrame:
    """members(family_id, inci, aliases) -> (family_id, member, key, via): one row per name a member goes by."""
    names = F.concat(F.array("inci"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (members.select("family_id", F.col("inci").alias("member"), F.posexplode(names).alias("i", "n"))
            .select("family_id", "member", X.match_key(F.col("n"), False).alias("key"), F.when(F.col("i") == 0, "name").otherwise("alias").alias("via")))


def family_hits(names: DataFrame, members: DataFrame, patterns: list[tuple[str, str, list[str]]] = ()) -> DataFrame:
    """Distinct names(inci) -> (inci, family_id, member, via).

    Members are an equi-join on the matching key.  Pattern families (family, regex, excluded names) are rules of the
    configuration, so each is one regular expression evaluated in the scan of the distinct names; a name already in the
    family by membership is not added again.
    """
    n = names.select("inci").distinct().withColumn("key", X.match_key(F.col("inci"), False))
    by_name = n.join(member_index(members), "key").select("inci", "family_id", "member", "via")
    if not patterns:
        return by_name
    fold = lambda s: "".join(ch for ch in s.upper() if ch.isascii() and ch.isalnum())
    found = F.array_compact(F.array(*[
        F.when(F.upper("inci").rlike(rx) & ~F.col("key").isin(*[fold(x) for x in ex] or [""]), F.lit(fid)) for fid, rx, ex in patterns]))
    by_rx = n.select("inci", F.explode(F.array_distinct(found)).alias("family_id"))
    by_rx = by_rx.join(by_name.select("inci", "family_id").distinct(), ["inci", "family_id"], "left_anti")
    return by_name.unionByName(by_rx.select("inci", "family_id", F.upper("inci").alias("member"), F.lit("pattern").alias("via")))


def regulatory_lines(names: DataFrame, annexes: DataFrame) -> DataFrame:
    """names(inci) -> (inci, annex, entry, text): what the annexes say; conditions over 320 characters are shortened."""
    n = names.select("inci").distinct().withColumn("key", X.match_key(F.col("inci"), False))
    a = annexes.select("annex", "entry", "conditions", F.explode("inci").alias("n")).select("annex", "entry", "conditions", X.match_key(F.col("n"), False).alias("key")).distinct()
    label = F.create_map(*[F.lit(x) for kv in ANNEX_LABEL.items() for x in kv])[F.col("annex")]
    cond = F.when(F.length("conditions") > 320, F.concat(F.substring("conditions", 1, 317), F.lit("…"))).otherwise(F.col("conditions"))
    tail = F.when(F.coalesce(F.length("conditions"), F.lit(0)) > 0, F.concat(F.lit(". "), cond)).otherwise("")
    return n.join(a, "key").select("inci", "annex", "entry", F.concat(F.coalesce(label, F.col("annex")), F.lit(": entry "), "entry", tail).alias("text"))


def active_classes(names: DataFrame, members: DataFrame) -> DataFrame:
    """names(inci) -> (inci, class_id) for the notable actives."""
    m = members.select("class_id", X.match_key(F.col("member"), False).alias("key")).distinct()
    return names.select("inci").distinct().withColumn("key", X.match_key(F.col("inci"), False)).join(m, "key").select("inci", "class_id")


def substitutions_for(names: DataFrame, subs: DataFrame) -> DataFrame:
    """names(inci) -> substitution options (sub_id, option)."""
    s = subs.select("sub_id", F.explode("from").alias("f"), "option").select("sub_id", "option", X.match_key(F.col("f"), False).alias("key")).distinct()
    return names.select("inci").distinct().withColumn("key", X.match_key(F.col("inci"), False)).join(s, "key").select("inci", "sub_id", "option")


# ---------------------------------------------------------------------------------------------------
# Findings.  ids: (label_id, user_id, idx, inci) identified items.

def avoid_matches(ids: DataFrame, hits: DataFrame, avoid: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """(label_id, user_id, idx, entry_id, tier, capped, carried); ``carried`` is the role note a capped finding tells.

    avoid(user_id, entry_id, kind, family_id, keys, specific_keys, strength).  An entry matches by one of its keys or by
    its family: two equi-joins whose union is made distinct, in place of one OR join.  A doctor-confirmed entry is 'avoid', a
    preference 'caution'; a member's cap softens it unless the user listed that very name.
    """
    k = ids.withColumn("key", X.match_key(F.col("inci"), False))
    a_key = avoid.select("user_id", "entry_id", F.explode(F.array_distinct("keys")).alias("key"))
    by_key = k.join(a_key, ["user_id", "key"]).select("label_id", "user_id", "idx", "inci", "key", "entry_id")
    a_fam = avoid.where("kind = 'family' AND family_id IS NOT NULL").select("user_id", "entry_id", "family_id")
    by_fam = k.join(hits.select("inci", "family_id").distinct(), "inci").join(a_fam, ["user_id", "family_id"]).select("label_id", "user_id", "idx", "inci", "key", "entry_id")
    m = by_key.unionByName(by_fam).distinct()
    e = avoid.select("user_id", "entry_id", "family_id", "specific_keys", "strength")
    m = m.join(e, ["user_id", "entry_id"])
    if caps is None:
        m = m.withColumn("cap_tier", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    else:
        noted = caps if "role_note" in caps.columns else caps.withColumn("role_note", F.lit(None).cast("string"))
        c = member_index(caps).join(noted.select("family_id", F.col("inci").alias("member"), "cap_tier", F.col("role_note").alias("note")), ["family_id", "member"])
        c = first_per(c, ["family_id", "key"], F.col("member")).select("family_id", "key", "cap_tier", "note")
        # an entry without a family speaks through the first family the item is in
        first = hits.groupBy("inci").agg(F.min("family_id").alias("first_family"))
        m = m.join(first, "inci", "left").withColumn("family_id", F.coalesce("family_id", "first_family")).drop("first_family").join(c, ["family_id", "key"], "left")
    raw = F.when(F.col("strength") == "doctor", "avoid").otherwise("caution")
    softened = F.col("cap_tier").isNotNull() & ~F.array_contains("specific_keys", F.col("key"))
    return m.select("label_id", "user_id", "idx", "entry_id", F.when(softened, cap_tier(raw, F.col("cap_tier"))).otherwise(raw).alias("tier"), softened.alias("capped"),
                    F.when(softened, F.col("note")).alias("carried"))


def profile_findings(ids: DataFrame, hits: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """(label_id, user_id, idx, rule_id, tier) where the profile has the rule's condition and the item the rule's family.

    profiles(user_id, conditions array); rules(rule_id, condition, family_id, tier).
    """
    p = profiles.select("user_id", F.explode(F.array_distinct("conditions")).alias("condition")).join(rules, "condition").select("user_id", "rule_id", "family_id", "tier")
    f = ids.join(hits.select("inci", "family_id").distinct(), "inci")
    return f.join(p, ["user_id", "family_id"]).select("label_id", "user_id", "idx", "rule_id", "tier").distinct()


def uncovered_conditions(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """(user_id, condition): profile conditions no rule speaks about."""
    return profiles.select("user_id", F.explode(F.array_distinct("conditions")).alias("condition")).join(rules.select("condition").distinct(), "condition", "left_anti").select("user_id", "condition")


def role_notes(ids: DataFrame, hits: DataFrame, members: DataFrame, avoid_found: DataFrame) -> DataFrame:
    """(label_id, user_id, idx, family_id, member, note): a member's role note, unless a capped avoid-list finding of the item carries that very note.

    members(family_id, inci, role_note).
    """
    m = members.where("role_note IS NOT NULL").select("family_id", F.col("inci").alias("member"), F.col("role_note").alias("note"))
    f = ids.join(hits, "inci").join(m, ["family_id", "member"])
    said = avoid_found.where("carried IS NOT NULL").select("label_id", "user_id", "idx", F.col("carried").alias("note")).distinct()
    return f.join(said, ["label_id", "user_id", "idx", "note"], "left_anti").select("label_id", "user_id", "idx", "family_id", "member", "note").distinct()


def family_notes(ids: DataFrame, hits: DataFrame, notes: DataFrame) -> DataFrame:
    """(label_id, user_id, idx, note_id): notes(note_id, family_id) shown on every item of a family."""
    return ids.join(hits.select("inci", "family_id").distinct(), "inci").join(notes, "family_id").select("label_id", "user_id", "idx", "note_id").distinct()


def candidate_notes(suggested: DataFrame, hits: DataFrame, families_with_note: DataFrame) -> DataFrame:
    """suggested(label_id, idx, candidates array<name>) -> (label_id, idx, family_id, names): >= 2 of the top three candidates share a noted family."""
    c = suggested.where(F.size("candidates") >= 2).select("label_id", "idx", F.posexplode(F.slice("candidates", 1, 3)).alias("o", "inci"))
    f = c.join(hits.select("inci", "family_id").distinct(), "inci").join(families_with_note.select("family_id").distinct(), "family_id")
    return (f.groupBy("label_id", "idx", "family_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o", "inci"))).alias("m")).where("n >= 2")
            .select("label_id", "idx", "family_id", F.array_join(F.col("m.inci"), " and ").alias("names")))


def regulatory_for_items(names: DataFrame, lines: DataFrame, hits: DataFrame, member_notes: DataFrame, family_text: DataFrame) -> DataFrame:
    """(inci, kind, family_id, text): annex lines; member notes not already said (first 20 characters); family text only without annex lines."""
    n = names.select("inci").distinct()
    annex = n.join(lines, "inci").select("inci", F.lit("annex").alias("kind"), F.lit(None).cast("string").alias("family_id"), "text")
    mn = n.join(hits, "inci").join(member_notes.select("family_id", "member", F.col("note").alias("text")), ["family_id", "member"])
    said = lines.select(F.col("inci").alias("l_inci"), F.col("text").alias("l_text"))
    mn = mn.join(said, (mn["inci"] == said["l_inci"]) & F.contains(said["l_text"], F.substring(mn["text"], 1, 20)), "left_anti")
    member = mn.select("inci", F.lit("member").alias("kind"), "family_id", "text").distinct()
    ft = (n.join(lines.select("inci").distinct(), "inci", "left_anti").join(hits.select("inci", "family_id").distinct(), "inci")
          .join(family_text, "family_id").select("inci", F.lit("family").alias("kind"), "family_id", "text"))
    return annex.unionByName(member).unionByName(ft)


def myth_notes(ids: DataFrame, hits: DataFrame, triggers: DataFrame) -> DataFrame:
    """(label_id, note_id): triggers(note_id, family_id, inci) fire on a family or on a name present among the identified items."""
    k = ids.select("label_id", "inci").distinct()
    t_name = triggers.where("inci IS NOT NULL").select("note_id", X.match_key(F.col("inci"), False).alias("key"))
    t_fam = triggers.where("family_id IS NOT NULL").select("note_id", "family_id")
    a = k.withColumn("key", X.match_key(F.col("inci"), False)).join(t_name, "key").select("label_id", "note_id")
    b = k.join(hits.select("inci", "family_id").distinct(), "inci").join(t_fam, "family_id").select("label_id", "note_id")
    return a.unionByName(b).distinct()


def expand_avoid(typed: DataFrame, members: DataFrame, families: DataFrame, patterns=()) -> DataFrame:
    """typed(user_id, entry_id, text) -> label, keys (typed name and the other names of its first member), families, families whose own name was typed.

    families(family_id, name).
    """
    t = typed.withColumn("key", X.match_key(F.col("text"), False))
    hits = family_hits(t.select(X.strip(F.col("text")).alias("inci")).where("inci <> ''"), members, patterns)
    names = members.select("family_id", F.col("inci").alias("member"), F.concat(F.array("inci"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    h = hits.join(names, ["family_id", "member"], "left")
    g = h.groupBy("inci").agg(F.array_sort(F.collect_set("family_id")).alias("families"), F.min_by(F.struct("member", "names"), F.struct("family_id", "member")).alias("m"))
    # distinct typed keys against the curated family names: equal, or contained when long enough
    fam = families.select("family_id", X.match_key(F.col("name"), False).alias("fk"))
    eq = t.where(F.length("key") >= 5).select("key").distinct()
    same = eq.join(fam, eq["key"] == fam["fk"]).select("key", "family_id")
    size8 = eq.where(F.length("key") >= 8)
    pieces = fam.select("family_id", "fk", F.explode(F.array_distinct(F.transform(
        F.when(F.length("fk") >= 8, F.sequence(F.lit(1), F.length("fk") - 7)).otherwise(F.array().cast("array<int>")), lambda i: F.substr("fk", i, F.lit(8))))).alias("p8"))
    inside = size8.withColumn("p8", F.substring("key", 1, 8)).join(pieces, "p8").where(F.contains("fk", F.col("key"))).select("key", "family_id")
    by_name = same.unionByName(inside).distinct().groupBy("key").agg(F.array_sort(F.collect_set("family_id")).alias("name_families"))
    out = t.withColumn("inci", X.strip(F.col("text"))).join(g, "inci", "left").join(by_name, "key", "left")
    none = F.array().cast("array<string>")
    fold_all = F.transform(F.coalesce("m.names", F.array("inci")), lambda n: X.fold_key(n, False))
    return out.select("user_id", "entry_id", "text", F.coalesce(X.title_case(F.col("m.member")), F.col("inci")).alias("label"),
                      F.array_distinct(F.filter(F.concat(fold_all, F.array("key")), lambda k: k != "")).alias("keys"),
                      F.coalesce("families", none).alias("families"), F.coalesce("name_families", none).alias("name_families"))


def evaluate_findings(*parts: DataFrame) -> DataFrame:
    """Union of finding frames (label_id, user_id, idx, kind, rule_id, tier), strongest tier first within an item."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("label_id", "user_id", "idx").orderBy(tier_rank(F.col("tier")), "kind", "rule_id")
    return out.withColumn("ord", F.row_number().over(w) - 1)


# ---------------------------------------------------------------------------------------------------
# Per-label texts

def banner(items: DataFrame, avoid_found: DataFrame, has_list: DataFrame) -> DataFrame:
    """(label_id, user_id, avoid_matches, needs_review, identified, text).

    items(label_id, user_id, idx, inci, raw, status, optional, via); has_list(user_id) lists users with an avoid list.
    """
    from .review import NEEDS_REVIEW
    hit = avoid_found.select("label_id", "user_id", "idx").distinct().withColumn("hit", F.lit(True))
    it = items.join(hit, ["label_id", "user_id", "idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    identified = (F.col("via") != "none") | (F.col("status") == "resolved")
    name = X.title_case(X.strip_parens(F.coalesce("inci", "raw")))
    g = it.groupBy("label_id", "user_id").agg(
        F.count_if("hit").alias("avoid_matches"),
        F.count_if(~F.col("optional") & ~identified & F.col("status").isin(*NEEDS_REVIEW)).alias("needs_review"),
        F.count_if(~F.col("optional") & identified).alias("identified"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("idx", name.alias("name"))))).alias("names"))
    g = g.join(has_list.select("user_id").distinct().withColumn("has", F.lit(True)), "user_id", "left")
    n, r = F.col("avoid_matches"), F.col("needs_review")
    plural = lambda c: F.when(c > 1, "s").otherwise("")
    head = (F.when(F.col("has").isNull(), "You have not set an avoid list yet. Add one in your profile to check ingredients against it.")
            .when(n > 0, F.concat(F.lit("Contains "), n.cast("string"), F.lit(" ingredient"), plural(n), F.lit(" you avoid: "), F.array_join(F.col("names.name"), ", "), F.lit(".")))
            .otherwise("Nothing on your avoid list was found among the identified ingredients."))
    tail = F.when(r > 0, F.concat(F.lit(" "), r.cast("string"), F.lit(" item"), plural(r), F.lit(" still need review."))).otherwise("")
    return g.select("label_id", "user_id", "avoid_matches", "needs_review", "identified", F.concat(head, tail).alias("text"))


def label_summary(items: DataFrame, hits: DataFrame, named_families: list[str]) -> DataFrame:
    """Counts, the first three printed items, the water-first flag and the names per listed family of each label.

    Only the first three items and the family members of a label are gathered, never the whole list.
    """
    main = items.where(~F.col("optional"))
    w = Window.partitionBy("label_id").orderBy("idx")
    main = main.withColumn("rn", F.row_number().over(w))
    shown = F.when(F.col("inci").isNotNull(), X.title_case(F.col("inci"))).otherwise(F.concat(F.lit("“"), F.col("raw"), F.lit("”")))
    g = main.groupBy("label_id").agg(
        F.count("*").alias("listed"), F.count_if(F.col("inci").isNotNull()).alias("identified"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", shown.alias("n"))))).alias("f3"),
        F.coalesce(F.max(F.when(F.col("rn") == 1, X.match_key(F.col("inci"), False) == "AQUA")), F.lit(False)).alias("water_first"))
    out = g.select("label_id", "listed", "identified", F.array_join(F.col("f3.n"), ", ").alias("first_three"), "water_first")
    if named_families:
        fam = (main.where("inci IS NOT NULL").join(hits.select("inci", "family_id").distinct(), "inci").where(F.col("family_id").isin(*named_families))
               .groupBy("label_id").pivot("family_id", named_families).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", X.title_case(F.col("inci")).alias("n"))))["n"], ", ")))
        out = out.join(fam, "label_id", "left")
    return out


def summary_text(summary: DataFrame) -> DataFrame:
    """One sentence group per label built from ``label_summary``."""
    n, m = F.col("listed"), F.col("identified")
    head = F.concat(n.cast("string"), F.lit(" ingredient"), F.when(n > 1, "s").otherwise(""), F.lit(" listed; "), m.cast("string"), F.lit(" identified."))
    water = F.when(F.col("water_first"), " Water is listed first, so it is a water-based product.").otherwise("")
    first = F.concat(F.lit(" The first printed items are "), "first_three", F.lit(". Listing order shows relative amount only for ingredients above 1%; it is not a concentration."))
    return summary.select("label_id", F.concat(head, water, first).alias("summary"))


def roles_of(names: DataFrame, functions: DataFrame) -> DataFrame:
    """names(inci) -> (inci, functions, families by priority, lead family) for names with listed functions."""
    f = functions.where((F.size("functions") > 0) & (F.col("kind") != "unverified") & (F.coalesce("url", F.lit("")) != "")).select(X.match_key(F.col("inci"), False).alias("key"), "functions")
    f = first_per(f, ["key"], F.desc(F.size("functions")), F.array_join("functions", ","))
    n = names.select("inci").distinct().withColumn("key", X.match_key(F.col("inci"), False)).join(f, "key")
    fams = F.array_sort(F.array_distinct(F.transform("functions", X.role_family)), lambda a, b: (X.role_rank(a) - X.role_rank(b)).cast("int"))
    return n.select("inci", "functions", fams.alias("families"), F.get(fams, F.lit(0)).alias("lead"))


def role_overview(items: DataFrame, roles: DataFrame) -> DataFrame:
    """(label_id, family, ord, n, names): items grouped by their leading role in a fixed order, then 'none', then 'to confirm'.

    items(label_id, idx, inci, raw, status in identified/to_confirm).
    """
    order = F.array(*[F.lit(f) for f in list(X.ROLE_BLURB) + ["none", "to_confirm"]])
    it = items.join(roles.select("inci", "lead"), "inci", "left")
    fam = F.when(F.col("status") == "to_confirm", "to_confirm").otherwise(F.coalesce("lead", F.lit("none")))
    g = it.withColumn("family", fam).groupBy("label_id", "family").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", F.coalesce("inci", "raw").alias("n")))).alias("m"))
    return g.select("label_id", "family", (F.array_position(order, F.col("family")) - 1).cast("int").alias("ord"), "n", F.array_join(F.col("m.n"), ", ").alias("names"))


def plain_function(terms: DataFrame, glossary: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """terms(function) -> plain wording: glossary by full term, then by its last ' - ' part, else the family's line, from lines(family, line) if given."""
    g = glossary.select(F.upper("function").alias("gk"), F.col("en")).groupBy("gk").agg(F.max("en").alias("en"))
    t = terms.select("function").distinct().withColumn("u", F.upper("function")).withColumn("last", F.element_at(F.split("u", " - "), -1)).withColumn("family", X.role_family(F.col("function")))
    a = g.select(F.col("gk").alias("u"), F.col("en").alias("full_en"))
    b = g.select(F.col("gk").alias("last"), F.col("en").alias("last_en"))
    t = t.join(a, "u", "left").join(b, "last", "left")
    line = X.role_blurb(F.col("family"))
    if lines is not None:
        t = t.join(lines.groupBy("family").agg(F.max("line").alias("line")), "family", "left")
        line = F.coalesce("line", line)
    return t.select("function", X.pretty_function(F.col("function")).alias("pretty"), "family", F.coalesce("full_en", "last_en", line).alias("plain"))
