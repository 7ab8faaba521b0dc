"""Saved products: comparison, alternatives, routine checks, reaction patterns, reports.

products(user_id, product_id, name, type, when, ingredients array, unresolved array); ``when`` is am, pm, both or ''.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import shuffled
from .dictionary import first_per

MIN_PRODUCTS, MIN_SHARED, LOW_SHARE = 2, 3, 0.25


def fold_all(names: Column) -> Column:
    return F.transform(names, lambda n: X.fold_key(n, False))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Shared, only-left, only-right distinct names and their Jaccard similarity, by matching key (the last spelling of a key is shown)."""
    def work(s):
        ka, kb = F.array_distinct(s["ka"]), F.array_distinct(s["kb"])
        show = lambda names, keys, pick: F.transform(pick, lambda k: F.get(names, (F.size(keys) - F.array_position(F.reverse(keys), k)).cast("int")))
        shared = F.array_intersect(ka, kb)
        n = F.size(F.array_union(ka, kb))
        return F.struct(show(s["a"], s["ka"], shared).alias("shared"), show(s["a"], s["ka"], F.array_except(ka, kb)).alias("only_a"), show(s["b"], s["kb"], F.array_except(kb, ka)).alias("only_b"),
                        F.size(shared).alias("n_shared"), F.when(n > 0, F.size(shared) / n).otherwise(0.0).alias("similarity"))
    o = X.let(F.struct(a.alias("a"), b.alias("b"), fold_all(a).alias("ka"), fold_all(b).alias("kb")), work)
    return {k: o[k] for k in ("shared", "only_a", "only_b", "n_shared", "similarity")}


def compare_products(pairs: DataFrame) -> DataFrame:
    """pairs(a_id, b_id, a_ingredients, b_ingredients, a_unresolved, b_unresolved counts) -> overlap, similarity, reliability."""
    o = overlap(F.col("a_ingredients"), F.col("b_ingredients"))
    open_ = F.col("a_unresolved") + F.col("b_unresolved")
    total = F.greatest(F.lit(1), F.size("a_ingredients") + F.size("b_ingredients") + open_)
    return pairs.select("a_id", "b_id", *[c.alias(k) for k, c in o.items()], F.when(open_ / total > LOW_SHARE, "low").otherwise("ok").alias("reliability"))


def rank_alternatives(pairs: DataFrame, avoid_hits: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Best alternatives of each base product and, per base, how many were excluded or shared too little.

    pairs(base_id, cand_id, base_ingredients, cand_ingredients) is the look-up result of each base (its catalogue matches);
    avoid_hits(cand_id) lists candidates holding something on the avoid list.
    """
    bad = avoid_hits.select("cand_id").distinct().withColumn("bad", F.lit(True))
    p = pairs.join(bad, "cand_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    o = overlap(F.col("base_ingredients"), F.col("cand_ingredients"))
    p = p.select("base_id", "cand_id", "bad", o["n_shared"].alias("n_shared"), o["similarity"].alias("similarity"))
    usable = p.where(~F.col("bad") & (F.col("n_shared") >= MIN_SHARED))
    w = Window.partitionBy("base_id").orderBy(F.desc("similarity"), "cand_id")
    ranked = usable.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("base_id", "rank", "cand_id", "n_shared", "similarity")
    stats = p.groupBy("base_id").agg(F.count_if("bad").alias("excluded"), F.count_if(~F.col("bad") & (F.col("n_shared") < MIN_SHARED)).alias("too_few"))
    return ranked, stats


def saved_alternatives(products: DataFrame, avoid_hits: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """As ``rank_alternatives``, with every other product of the same user as a candidate.

    products(user_id, product_id, ingredients). Two products that share MIN_SHARED keys share one among all but the MIN_SHARED - 1
    most common ones of each: only those rarest keys are joined, and the row of the first shared one is kept, so a pair is
    produced once. The counts need no pairs of too few: they are what is left of the user's products.
    """
    bad = avoid_hits.select(F.col("cand_id").alias("product_id")).distinct().withColumn("bad", F.lit(True))
    p = products.select("user_id", "product_id", "ingredients").join(bad, "product_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    k = p.select("user_id", "product_id", "bad", F.explode(F.array_distinct(fold_all(F.col("ingredients")))).alias("key"))
    df = k.groupBy("user_id", "key").agg(F.count("*").alias("df"))
    keys = k.join(df, ["user_id", "key"]).groupBy("user_id", "product_id", "bad").agg(F.array_sort(F.collect_list(F.struct("df", "key")))["key"].alias("ks")).where(F.size("ks") >= MIN_SHARED)
    rare = keys.select("user_id", "product_id", "bad", F.slice("ks", F.lit(1), F.size("ks") - (MIN_SHARED - 1)).alias("ks")).select("*", F.explode("ks").alias("key"))
    a = rare.select("user_id", "key", F.col("product_id").alias("base_id"), F.col("ks").alias("a"))
    b = rare.where(~F.col("bad")).select("user_id", "key", F.col("product_id").alias("cand_id"), F.col("ks").alias("b"))
    met = a.join(b, ["user_id", "key"]).where((F.col("base_id") != F.col("cand_id")) & (F.element_at(F.array_intersect("a", "b"), 1) == F.col("key"))).select("base_id", "cand_id")
    of = lambda side: p.select(F.col("product_id").alias(f"{side}_id"), F.col("ingredients").alias(f"{side}_ingredients"))
    pairs = met.join(of("base"), "base_id").join(of("cand"), "cand_id")
    ranked = rank_alternatives(pairs, avoid_hits, top)[0]
    n = overlap(F.col("base_ingredients"), F.col("cand_ingredients"))["n_shared"]
    usable = pairs.where(n >= MIN_SHARED).groupBy("base_id").agg(F.count("*").alias("usable"))
    users = p.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).where("n > 1")
    own = F.col("bad").cast("int")
    stats = p.join(users, "user_id").withColumnRenamed("product_id", "base_id").join(usable, "base_id", "left")
    stats = stats.select("base_id", (F.col("n_bad") - own).alias("excluded"), (F.col("n") - F.col("n_bad") - 1 + own - F.coalesce("usable", F.lit(0))).alias("too_few"))
    return ranked, stats


def routine_gate(products: DataFrame, by: list[str]) -> DataFrame:
    """Products of routines with two or more products; of any size, since what a user may select at once is the caller's matter.

    Counting per routine is a partial aggregate; the products are joined back, so no routine is gathered anywhere.
    """
    n = products.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_PRODUCTS).drop("_n")
    return products.join(n, by, "left_semi")


def product_actives(products: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by..., product_id, name, when, inci, class_id): the notable actives of every product."""
    x = products.select(*by, "product_id", "name", "when", F.explode("ingredients").alias("inci")).withColumn("key", X.fold_key(F.col("inci"), False))
    m = members.select("class_id", X.match_key(F.col("member"), False).alias("key")).distinct()
    return x.join(m, "key").select(*by, "product_id", "name", "when", "inci", "key", "class_id")


def stacking_conflicts(actives: DataFrame, stacking: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule_id, a_id, b_id, overlap, tier): two actives of a rule in different products of one routine.

    The pairs are the result: a routine has one per rule and pair of its products that hold the two actives.
    """
    p = actives.select(*by, "product_id", "name", "when", "class_id").distinct()
    a = p.join(stacking.select("rule_id", F.col("a").alias("class_id"), F.col("b").alias("b_class"), "tier"), "class_id")
    a = a.select(*by, "rule_id", "tier", F.col("b_class").alias("class_id"), F.col("product_id").alias("a_id"), F.col("when").alias("a_when"))
    b = p.select(*by, "class_id", F.col("product_id").alias("b_id"), F.col("when").alias("b_when"))
    j = a.join(b, [*by, "class_id"]).where("a_id <> b_id")
    am, pm = (lambda c: c.isin("am", "both")), (lambda c: c.isin("pm", "both"))
    x, y = F.col("a_when"), F.col("b_when")
    meet = (x == "") | (y == "") | (am(x) & am(y)) | (pm(x) & pm(y))
    return j.select(*by, "rule_id", "a_id", "b_id", meet.alias("overlap"), F.when(meet, F.col("tier")).otherwise("note").alias("tier"))


def duplicate_actives(actives: DataFrame, by: list[str], families: tuple[str, ...] = ("retinoid", "aha")) -> tuple[DataFrame, DataFrame]:
    """Actives named by more than one product; families with several members spread over several products."""
    one = actives.groupBy(*by, "key").agg(F.countDistinct("name").alias("n_products"), F.min("inci").alias("inci")).where("n_products > 1")
    fam = (actives.where(F.col("class_id").isin(*families)).groupBy(*by, "class_id")
           .agg(F.countDistinct("product_id").alias("n_products"), F.countDistinct("key").alias("n_members")).where("n_products > 1 AND n_members > 1"))
    return one, fam


def sunscreen_check(products: DataFrame, actives: DataFrame, sensitising: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sunscreen_check, tier): is a sunscreen set for the morning, and does an active make that matter (tier else null)?"""
    p = products.groupBy(*by).agg(F.bool_or(F.col("type") != "").alias("marked"), F.bool_or((F.col("type") == "sunscreen") & F.col("when").isin("am", "both")).alias("am_sun"))
    s = actives.join(sensitising.select("class_id").distinct(), "class_id", "left_semi").select(*by).distinct().withColumn("sens", F.lit(True))
    check = F.when(~F.col("marked"), "types_not_marked").when(F.col("am_sun"), "present").otherwise("missing")
    return p.join(s, by, "left").select(*by, check.alias("sunscreen_check"), F.when(F.col("sens"), F.when(check == "missing", "caution").otherwise("note")).alias("tier"))


def timing_notes(actives: DataFrame, by: list[str], class_id: str = "retinoid") -> DataFrame:
    """Products with a retinoid that the user set for the morning."""
    return actives.where((F.col("class_id") == class_id) & (F.col("when") == "am")).select(*by, "product_id", "name").distinct()


def check_routine(products: DataFrame, members: DataFrame, classes: DataFrame, stacking: DataFrame, by: list[str], gate: bool = True) -> DataFrame:
    """All notes of every routine: (by..., kind, tier, title), one row per title and kind: the first, by rule and then by product pair.

    members(class_id, member), classes(class_id, name, sun_sensitising), stacking(rule_id, a, b, tier).
    """
    p = routine_gate(products, by) if gate else products
    act = product_actives(p, members, by)
    names = p.select(*by, "product_id", F.col("name").alias("pname")).distinct()
    st = stacking_conflicts(act, stacking, by)
    cls = stacking.join(classes.select(F.col("class_id").alias("a"), F.col("name").alias("an")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("name").alias("bn")), "b").select("rule_id", "an", "bn")
    st = (st.join(cls, "rule_id").join(names.select(*by, F.col("product_id").alias("a_id"), F.col("pname").alias("ap")), [*by, "a_id"])
          .join(names.select(*by, F.col("product_id").alias("b_id"), F.col("pname").alias("bp")), [*by, "b_id"]))
    st = st.select(*by, F.lit("stacking").alias("kind"), "tier", F.struct("rule_id", "a_id", "b_id").alias("rule"), F.concat(F.col("an"), F.lit(" with "), F.col("bn"), F.lit(": "), F.col("ap"), F.lit(" and "), F.col("bp")).alias("title"))
    one, fam = duplicate_actives(act, by)
    d1 = one.select(*by, F.lit("duplicate").alias("kind"), F.lit("note").alias("tier"), F.concat("inci", F.lit(" appears in "), F.col("n_products").cast("string"), F.lit(" products")).alias("title"))
    d2 = fam.join(classes.select("class_id", F.col("name").alias("cn")), "class_id").select(*by, F.lit("duplicate").alias("kind"), F.lit("note").alias("tier"), F.concat(F.lit("More than one "), F.lower("cn"), F.lit(" product")).alias("title"))
    sun = sunscreen_check(p, act, classes.where("sun_sensitising"), by).where("tier IS NOT NULL")
    title = F.when(F.col("sunscreen_check") == "missing", "No sunscreen marked in your morning routine").when(F.col("sunscreen_check") == "present", "A sunscreen is marked for the morning").otherwise("Mark your product types to check sunscreen")
    s = sun.select(*by, F.lit("sunscreen").alias("kind"), "tier", title.alias("title"))
    t = timing_notes(act, by).select(*by, F.lit("timing").alias("kind"), F.lit("note").alias("tier"), F.concat("name", F.lit(": you set it for the morning")).alias("title"))
    cov = p.where(F.size("unresolved") > 0).select(*by).distinct().select(*by, F.lit("coverage").alias("kind"), F.lit("note").alias("tier"), F.lit("Some ingredients are not confirmed").alias("title"))
    every = st.unionByName(d1.unionByName(d2).unionByName(s).unionByName(t).unionByName(cov), allowMissingColumns=True)
    return first_per(every, [*by, "title", "kind"], F.struct("rule", "tier")).drop("rule")


def routine_slots(products: DataFrame, by: list[str], gate: bool = True) -> DataFrame:
    """Morning, evening and unplaced product names of every routine (its own list)."""
    p = routine_gate(products, by) if gate else products
    pick = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("name")))), ", ")
    return p.groupBy(*by).agg(pick(F.col("when").isin("am", "both")).alias("am"), pick(F.col("when").isin("pm", "both")).alias("pm"), pick(F.col("when") == "").alias("unplaced"))


def reaction_patterns(products: DataFrame, reactions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(user_id, kind, label, reacted, unreacted, ord): what two or more reacted products of a user share.

    Counting per (user, ingredient) is a two-step aggregate (product level first), so a user or an ingredient that holds a
    large share of the rows is pre-aggregated before every shuffle.  A family counts when two or more different members
    of it occur in two or more reacted products.  Fewest unreacted products first, then most reacted.
    """
    hit = reactions.select("user_id", "product_id").distinct().withColumn("r", F.lit(True))
    p = products.join(hit, ["user_id", "product_id"], "left").withColumn("r", F.coalesce("r", F.lit(False)))
    able = p.where("r").groupBy("user_id").agg(F.countDistinct("product_id").alias("n")).where("n >= 2").select("user_id")
    x = p.select("user_id", "product_id", "r", F.explode("ingredients").alias("inci")).withColumn("key", X.fold_key(F.col("inci"), False))
    x = x.groupBy("user_id", "product_id", "r", "key").agg(F.min("inci").alias("inci")).join(able, "user_id", "left_semi")
    ing = (x.groupBy("user_id", "key").agg(F.min("inci").alias("inci"), F.count_if("r").alias("reacted"), F.count_if(~F.col("r")).alias("unreacted")).where("reacted >= 2")
           .select("user_id", F.lit("ingredient").alias("kind"), X.title_case(F.col("inci")).alias("label"), "reacted", "unreacted"))
    out = ing
    if members is not None:
        from .rules import member_index
        f = x.join(member_index(members).select("key", "family_id").distinct(), "key")
        per = f.groupBy("user_id", "family_id", "product_id", "r").agg(F.count("*").alias("m"))
        prods = per.groupBy("user_id", "family_id").agg(F.count_if("r").alias("reacted"), F.count_if(~F.col("r")).alias("unreacted")).where("reacted >= 2")
        spread = f.where("r").select("user_id", "family_id", "key").distinct().groupBy("user_id", "family_id").agg(F.count("*").alias("members")).where("members >= 2")
        fam = prods.join(spread, ["user_id", "family_id"]).select("user_id", F.lit("family").alias("kind"), F.col("family_id").alias("label"), "reacted", "unreacted")
        out = out.unionByName(fam)
    w = Window.partitionBy("user_id").orderBy("unreacted", F.desc("reacted"), "kind", "label")
    return out.withColumn("ord", F.row_number().over(w) - 1)


def reaction_pattern_products(products: DataFrame, reactions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The products behind every pattern of ``reaction_patterns``: (user_id, kind, label, product_id, name, reacted), a row per product.

    Rows instead of lists keep a pattern that runs through very many products out of any single row.  The rows of a user's ingredient (or
    family) meet once, where they are counted, and those of no pattern go no further: no pattern is joined back to the products.
    """
    hit = reactions.select("user_id", "product_id").distinct().withColumn("reacted", F.lit(True))
    p = products.select("user_id", "product_id", "name", "ingredients").join(hit, ["user_id", "product_id"], "left").withColumn("reacted", F.coalesce("reacted", F.lit(False)))
    able = hit.join(products.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2").select("user_id")
    x = p.join(able, "user_id", "left_semi").select("user_id", "product_id", "name", "reacted", F.explode("ingredients").alias("inci")).withColumn("key", X.fold_key(F.col("inci"), False)).where("key IS NOT NULL")
    of = ["user_id", "key"]
    every, x = x, x.repartition(*of).groupBy(*of, "product_id", "reacted").agg(F.min("inci").alias("inci"), F.collect_set(F.struct("name")).alias("names"))
    w = Window.partitionBy(*of)
    rows = x.withColumn("n", F.count_if("reacted").over(w)).withColumn("label", F.min("inci").over(w)).where("n >= 2")
    rows = rows.select("user_id", F.lit("ingredient").alias("kind"), X.title_case(F.col("label")).alias("label"), "product_id", F.explode("names.name").alias("name"), "reacted")
    if members is not None:
        from .rules import member_index
        m = member_index(members).where("family_id IS NOT NULL").select("key", "family_id").distinct()
        # a product's members of a family are put together where the product is; two different ones are a least and a greatest that differ
        f = every.join(m, "key").groupBy("user_id", "product_id", "family_id", "reacted", "name").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        f, w = f.repartition("user_id", "family_id"), Window.partitionBy("user_id", "family_id")
        two = lambda lo, hi: F.min(F.when(F.col("reacted"), F.col(lo))).over(w) != F.max(F.when(F.col("reacted"), F.col(hi))).over(w)
        f = f.withColumn("shared", two("product_id", "product_id") & two("lo", "hi")).where("shared")
        rows = rows.unionByName(f.select("user_id", F.lit("family").alias("kind"), F.col("family_id").alias("label"), "product_id", "name", "reacted"))
    return rows


def reference_compare(pack: DataFrame, reference: DataFrame, by: str = "label_id") -> DataFrame:
    """pack(by, idx, name), reference(by, idx, name) -> shared / only_on_pack / only_in_reference names in order, and counts; nothing de-duplicated."""
    pk = pack.withColumn("key", X.fold_key(F.col("name"), False))
    rk = reference.withColumn("key", X.fold_key(F.col("name"), False))
    keys = lambda d: d.select(by, "key").distinct()
    rows = (pk.join(keys(rk), [by, "key"], "left_semi").select(by, F.lit("shared").alias("side"), "idx", "name")
            .unionByName(pk.join(keys(rk), [by, "key"], "left_anti").select(by, F.lit("pack").alias("side"), "idx", "name"))
            .unionByName(rk.join(keys(pk), [by, "key"], "left_anti").select(by, F.lit("ref").alias("side"), "idx", "name")))
    pick = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "name")))), lambda x: x["name"]), ", ")
    text = rows.groupBy(by).agg(pick("shared").alias("shared"), pick("pack").alias("only_on_pack"), pick("ref").alias("only_in_reference"))
    n = pk.select(by, F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(rk.select(by, F.lit(0).alias("p"), F.lit(1).alias("r"))).groupBy(by).agg(F.sum("p").alias("pack_count"), F.sum("r").alias("ref_count"))
    return n.join(text, by, "left")


def reference_lookup(queries: DataFrame, products: DataFrame, limit: int = 6) -> DataFrame:
    """queries(query_id, barcode, q) -> up to ``limit`` reference products (1..24): by digits of the barcode, else names that contain the search text.

    Names are indexed by their distinct trigrams (bigrams and letters for shorter texts); a query probes with its rarest gram, so a
    word that most names hold is no join key unless all of the query is that common, then the whole text is checked.
    """
    limit = max(1, min(24, limit))
    p = products.select("code", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "brands", "ingredients_text")])
    digits = F.regexp_replace(F.coalesce("barcode", F.lit("")), r"\D", "")
    q = queries.select("query_id", digits.alias("d"), F.lower(F.substring(X.strip(F.coalesce("q", F.lit(""))), 1, 80)).alias("q"))
    by_code = q.where("d <> ''").join(shuffled(p.withColumn("d", F.regexp_replace("code", r"\D", ""))), "d").select("query_id", "code", "name", "brands", "ingredients_text")
    def grams(c):
        of = lambda size: F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        return of
    # of the products of one name only the first ``limit`` codes can be listed, so the text side works on distinct names
    named = p.select("*", F.lower("name").alias("ln"))
    named = named.withColumn("o", F.row_number().over(Window.partitionBy("ln").orderBy("code"))).where(F.col("o") <= limit).drop("o")
    low = grams(F.col("ln"))
    posts = p.select(F.lower("name").alias("ln")).distinct().select("ln", F.explode(F.array_distinct(F.concat(low(1), low(2), low(3)))).alias("g"))
    freq = posts.groupBy("g").agg(F.count("*").alias("df"))
    asked = grams(F.col("q"))
    probe = F.when(F.length("q") >= 3, asked(3)).when(F.length("q") == 2, asked(2)).otherwise(asked(1))
    texts = q.where("d = '' AND q <> ''").select("q").distinct()
    rare = texts.select("q", F.explode(F.array_distinct(probe)).alias("g")).join(shuffled(freq), "g", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r")).select("q", F.col("r.g").alias("g"))
    hits = rare.join(shuffled(posts), "g").where(F.contains("ln", "q")).select("q", "ln")
    found = hits.join(shuffled(named), "ln")
    best = found.withColumn("o", F.row_number().over(Window.partitionBy("q").orderBy("code"))).where(F.col("o") <= limit)
    by_name = q.where("d = '' AND q <> ''").join(shuffled(best), "q").select("query_id", "code", "name", "brands", "ingredients_text")
    w = Window.partitionBy("query_id").orderBy("code")
    return by_code.unionByName(by_name).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def user_report(users: DataFrame, products: DataFrame, notes: DataFrame, avoid: DataFrame, reactions: DataFrame) -> DataFrame:
    """One row per user with chosen products: product lines, routine notes, avoid list, and - with consent - the reaction log.

    users(user_id, consent); products(user_id, product_id, name, when, ...); notes(user_id, title); avoid(user_id, label, strength);
    reactions(user_id, product_id, date, note).  A reaction to a product no longer saved is labelled '(removed product)'.
    A report is one user's own document; its lists are that user's records.
    """
    when = F.when(F.col("when") == "am", "Morning").when(F.col("when") == "pm", "Evening").when(F.col("when") == "both", "Morning and evening").otherwise("Time not set")
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "; ")
    p = products.groupBy("user_id").agg(F.count("*").alias("n_products"), lines(F.concat("name", F.lit(" - "), when)).alias("products"))
    n = notes.groupBy("user_id").agg(lines(F.col("title")).alias("notes"))
    a = avoid.groupBy("user_id").agg(lines(F.concat("label", F.lit(" · "), F.when(F.col("strength") == "doctor", "doctor-confirmed").otherwise("personal preference"))).alias("avoid_list"))
    r = reactions.join(users.where("consent").select("user_id"), "user_id", "left_semi").join(products.select("user_id", "product_id", "name"), ["user_id", "product_id"], "left")
    line = F.concat(F.coalesce("name", F.lit("(removed product)")), F.coalesce(F.concat(F.lit(", "), F.date_format("date", "yyyy-MM-dd")), F.lit("")), F.coalesce(F.concat(F.lit(": "), "note"), F.lit("")))
    r = r.groupBy("user_id").agg(lines(line).alias("reactions"))
    out = users.join(p, "user_id").join(n, "user_id", "left").join(a, "user_id", "left").join(r, "user_id", "left")
    return out.select("user_id", "n_products", "products", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("notes", "avoid_list", "reactions")])
