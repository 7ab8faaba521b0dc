"""Queries for review, rules and claims.  Orders are labels, customers users, part names identified ingredients, p_type families."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import claims, review, rules
from ..operators.segment import split_ingredients
from .match_queries import PHRASE_SQL, PHRASE_SQL, benchmark_phrases
from ..runtime import dealt
from .registry import LI, lines, part_names, query, sql_key, table
from .text_queries import WORDS_SQL, document_words, sql_case, term_col, TERM, ROLE

MEMBERS = "mem AS (SELECT DISTINCT p_type AS family_id, upper(p_name) AS inci FROM part WHERE p_size < 5)"
HITS = f"{MEMBERS}, hits AS (SELECT inci, family_id FROM mem UNION SELECT DISTINCT upper(p_name), 'round' FROM part WHERE regexp_matches(upper(p_name), '(RING|GEAR)$') AND upper(p_name) <> 'RED RING')"
IDS = "ids AS (SELECT l_orderkey AS label_id, o_custkey AS user_id, idx, upper(p_name) AS inci FROM li JOIN orders ON l_orderkey = o_orderkey)"


def members(spark, d):
    return table(spark, d, "part").where("p_size < 5").select(F.col("p_type").alias("family_id"), F.upper("p_name").alias("inci")).distinct().withColumn("aliases", F.array().cast("array<string>"))


def hits(spark, d):
    return rules.family_hits(part_names(spark, d).select(F.col("inci_name").alias("inci")), members(spark, d), [("round", "(RING|GEAR)$", ["red ring"])])


def ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return lines(spark, d).join(o, "l_orderkey").select(F.col("l_orderkey").alias("label_id"), "user_id", "idx", F.upper("p_name").alias("inci"))


def avoid(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    n = F.element_at(F.array(*[F.lit(x) for x in ("BLUEBOLT", "REDRING", "OLDGEAR", "HOTROD")]), (k % 4 + 1).cast("int"))
    fam = F.element_at(F.array(*[F.lit(x) for x in ("PROMO", "SMALL", "round")]), (k % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    strength = F.when(k % 2 == 0, "doctor").otherwise("preference")
    a = c.where("c_custkey % 5 <> 0").select(k.alias("user_id"), F.lit("i").alias("entry_id"), F.lit("ingredient").alias("kind"), F.lit(None).cast("string").alias("family_id"), F.array(n).alias("keys"), F.array(n).alias("specific_keys"), strength.alias("strength"))
    b = c.where("c_custkey % 7 = 0").select(k.alias("user_id"), F.lit("f").alias("entry_id"), F.lit("family").alias("kind"), fam.alias("family_id"), none.alias("keys"), none.alias("specific_keys"), strength.alias("strength"))
    return a.unionByName(b)


AVOID = f"""av AS (SELECT DISTINCT i.label_id, i.user_id, i.idx, e.entry_id, CASE WHEN i.user_id % 2 = 0 THEN 'avoid' ELSE 'caution' END AS raw, i.inci FROM ids i JOIN
 (SELECT c_custkey AS u, 'i' AS entry_id, ['BLUEBOLT', 'REDRING', 'OLDGEAR', 'HOTROD'][c_custkey % 4 + 1] AS k, NULL AS f FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, 'f', NULL, ['PROMO', 'SMALL', 'round'][c_custkey % 3 + 1] FROM customer WHERE c_custkey % 7 = 0) e
 ON i.user_id = e.u AND (replace(i.inci, ' ', '') = e.k OR EXISTS (SELECT 1 FROM hits h WHERE h.inci = i.inci AND h.family_id = e.f)))"""


@query("j6_family_hits", f"WITH {HITS} SELECT inci, family_id FROM hits")
def _(spark, d):
    return hits(spark, d).select("inci", "family_id")


def annexes(spark, d):
    p = table(spark, d, "part")
    cond = F.when(F.col("p_partkey") % 3 == 0, F.repeat("p_type", 60)).when(F.col("p_partkey") % 3 == 1, "max 1%")
    return p.where("p_name < 'n'").select(F.when(F.col("p_partkey") % 16 == 0, "III").otherwise("V").alias("annex"), F.col("p_partkey").cast("string").alias("entry"), F.array("p_name").alias("inci"), cond.alias("conditions"))


LINES = """reg AS (SELECT DISTINCT upper(p_name) AS inci, CASE WHEN p_partkey % 16 = 0 THEN 'III' ELSE 'V' END AS annex, CAST(p_partkey AS VARCHAR) AS entry,
 CASE WHEN p_partkey % 16 = 0 THEN 'Restricted substance (Annex III)' ELSE 'Permitted preservative (Annex V)' END || ': entry ' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '. ' || CASE WHEN length(p_type) * 60 > 320 THEN substr(repeat(p_type, 60), 1, 317) || '…' ELSE repeat(p_type, 60) END WHEN 1 THEN '. max 1%' ELSE '' END AS text FROM part WHERE p_name < 'n')"""


@query("j7_regulatory_lines", f"WITH {LINES} SELECT * FROM reg")
def _(spark, d):
    return rules.regulatory_lines(part_names(spark, d).select(F.col("inci_name").alias("inci")), annexes(spark, d))


@query("j8_active_classes", "SELECT DISTINCT l_orderkey AS label_id, p_type AS class_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_name = part.p_name AND q.p_size = 1 AND q.p_type = part.p_type)")
def _(spark, d):
    p = table(spark, d, "part")
    c = rules.active_classes(part_names(spark, d).select(F.col("inci_name").alias("inci")), p.where("p_size = 1").select(F.col("p_type").alias("class_id"), F.col("p_name").alias("member")))
    li = lines(spark, d).select(F.col("l_orderkey").alias("label_id"), F.upper("p_name").alias("inci"), F.col("p_type").alias("class_id"))
    return li.join(c, ["inci", "class_id"], "left_semi").select("label_id", "class_id").distinct()


@query("j8_substitutions", "SELECT DISTINCT upper(a.p_name) AS inci, a.p_type AS sub_id, upper(b.p_name) AS option FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_size = 50 WHERE a.p_size = 2")
def _(spark, d):
    p = table(spark, d, "part")
    f = p.where("p_size = 2").groupBy(F.col("p_type").alias("sub_id")).agg(F.collect_set("p_name").alias("from"))  # at most one entry per distinct name
    s = f.join(p.where("p_size = 50").select(F.col("p_type").alias("sub_id"), F.upper("p_name").alias("option")).distinct(), "sub_id")
    return rules.substitutions_for(part_names(spark, d).select(F.col("inci_name").alias("inci")), s)


@query("j10_avoid_matches", f"""WITH {LI}, {IDS}, {HITS}, {AVOID}
SELECT label_id, user_id, idx, entry_id, CASE WHEN entry_id = 'f' AND inci LIKE 'BLUE%' AND EXISTS (SELECT 1 FROM mem m WHERE m.inci = av.inci AND m.family_id = ['PROMO', 'SMALL', 'round'][user_id % 3 + 1]) THEN 'caution' ELSE raw END AS tier FROM av""")
def _(spark, d):
    caps = members(spark, d).where("startswith(inci, 'BLUE')").withColumn("cap_tier", F.lit("caution"))
    return rules.avoid_matches(ids(spark, d), hits(spark, d), avoid(spark, d), caps).drop("capped", "carried")


def profiles(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "pregnancy").otherwise("rosacea")).alias("conditions"))


def profile_rules(spark, d):
    # the rules of this query come from the part types: promo parts against the first segments, small parts in pregnancy
    t = table(spark, d, "part").select("p_type").distinct()
    r = t.select(F.concat(F.lit("r-"), "p_type").alias("rule_id"), F.when(F.col("p_type") == "PROMO", "BUILDING").when(F.col("p_type") == "SMALL", "pregnancy").alias("condition"), F.col("p_type").alias("family_id"), F.lit("caution").alias("tier"))
    return r.where("condition IS NOT NULL")


@query("j11_profile_rules", f"""WITH {LI}, {IDS}, {HITS}
SELECT DISTINCT label_id, user_id, idx, 'r-' || family_id AS rule_id, 'caution' AS tier FROM ids JOIN hits USING (inci) JOIN customer ON user_id = c_custkey
WHERE (family_id = 'PROMO' AND c_mktsegment = 'BUILDING') OR (family_id = 'SMALL' AND c_custkey % 2 = 0)""")
def _(spark, d):
    return rules.profile_findings(ids(spark, d), hits(spark, d), profiles(spark, d), profile_rules(spark, d))


@query("j12_role_notes", f"""WITH {LI}, {IDS}, {HITS}, {AVOID}
SELECT DISTINCT i.label_id, i.user_id, i.idx, h.family_id FROM ids i JOIN mem h USING (inci) WHERE i.inci LIKE 'BLUE%' AND NOT EXISTS
 (SELECT 1 FROM av a JOIN mem m ON m.inci = a.inci AND m.family_id = ['PROMO', 'SMALL', 'round'][a.user_id % 3 + 1] WHERE a.entry_id = 'f' AND a.label_id = i.label_id AND a.idx = i.idx AND a.inci LIKE 'BLUE%' AND m.family_id = h.family_id)""")
def _(spark, d):
    m = members(spark, d)
    blue = m.where("startswith(inci, 'BLUE')")
    note = F.concat(F.lit("role unclear in "), "family_id")
    found = rules.avoid_matches(ids(spark, d), hits(spark, d), avoid(spark, d), blue.withColumn("cap_tier", F.lit("caution")).withColumn("role_note", note))
    n = rules.role_notes(ids(spark, d), hits(spark, d), blue.withColumn("role_note", note), found)
    return n.select("label_id", "user_id", "idx", "family_id")


@query("j12_family_notes", f"WITH {LI}, {IDS}, {HITS} SELECT DISTINCT label_id, user_id, idx, 'n-round' AS note_id FROM ids JOIN hits USING (inci) WHERE family_id = 'round'")
def _(spark, d):
    notes = hits(spark, d).where("family_id = 'round'").select(F.lit("n-round").alias("note_id"), "family_id").distinct()
    return rules.family_notes(ids(spark, d), hits(spark, d), notes)


@query("j13_candidate_notes", f"""WITH {LI}, {HITS}, c AS (SELECT l_orderkey AS label_id, idx AS o, upper(p_name) AS inci, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li)
SELECT label_id, family_id, string_agg(inci, ' and ' ORDER BY o) AS names FROM c JOIN hits USING (inci) WHERE n >= 2 AND o < 3 AND family_id IN ('round', 'PROMO') GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    # an order's lines play the candidates of one suggested item
    s = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", F.upper("p_name").alias("n")))).alias("m")).select(F.col("l_orderkey").alias("label_id"), F.lit(0).alias("idx"), F.col("m.n").alias("candidates"))
    noted = hits(spark, d).where("family_id IN ('round', 'PROMO')").select("family_id").distinct()
    return rules.candidate_notes(s, hits(spark, d), noted).drop("idx")


@query("j14_regulatory_for_items", f"""WITH {HITS}, {LINES}, n AS (SELECT DISTINCT upper(p_name) AS inci FROM part)
SELECT inci, 'annex' AS kind, NULL AS family_id, text FROM reg UNION ALL
SELECT DISTINCT inci, 'member', family_id, 'Permitted preservative for ' || family_id FROM mem WHERE family_id IN ('PROMO', 'SMALL') AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.inci = mem.inci AND contains(reg.text, 'Permitted preservati')) UNION ALL
SELECT inci, 'family', family_id, 'family ' || family_id FROM hits WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.inci = hits.inci)""")
def _(spark, d):
    n = part_names(spark, d).select(F.col("inci_name").alias("inci"))
    h = hits(spark, d)
    notes = members(spark, d).where("family_id IN ('PROMO', 'SMALL')").select("family_id", F.col("inci").alias("member"), F.concat(F.lit("Permitted preservative for "), "family_id").alias("note"))
    fam = h.select("family_id").distinct().withColumn("text", F.concat(F.lit("family "), "family_id"))
    return rules.regulatory_for_items(n, rules.regulatory_lines(n, annexes(spark, d)), h, notes, fam)


@query("j15_myth_notes", f"""WITH {LI}, {IDS}, {HITS}
SELECT DISTINCT label_id, 'm1' AS note_id FROM ids WHERE inci IN ('BLUE BOLT', 'HOT ROD') UNION SELECT DISTINCT label_id, 'm2' FROM ids JOIN hits USING (inci) WHERE family_id = 'PROMO'""")
def _(spark, d):
    p = table(spark, d, "part")
    t = p.where("p_name IN ('blue bolt', 'hot rod')").select(F.lit("m1").alias("note_id"), F.lit(None).cast("string").alias("family_id"), F.col("p_name").alias("inci")).unionByName(
        p.where("p_type = 'PROMO'").select(F.lit("m2").alias("note_id"), F.col("p_type").alias("family_id"), F.lit(None).cast("string").alias("inci"))).distinct()
    return rules.myth_notes(ids(spark, d), hits(spark, d), t)


@query("j16_expand_avoid", f"""WITH {HITS}, t AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'Blue Bolt' WHEN 1 THEN c_name ELSE 'standard parts' END AS text FROM customer),
 f AS (SELECT DISTINCT p_type AS family_id, 'The ' || p_type || ' parts' AS name FROM part)
SELECT user_id, CASE WHEN text = 'Blue Bolt' THEN 'Blue Bolt' ELSE text END AS label, {sql_key('text', False)} AS keys, CASE WHEN text = 'Blue Bolt' THEN (SELECT coalesce(string_agg(family_id, ',' ORDER BY family_id), '') FROM hits WHERE inci = 'BLUE BOLT') ELSE '' END AS families,
 coalesce((SELECT string_agg(family_id, ',' ORDER BY family_id) FROM f WHERE length({sql_key('text', False)}) >= 8 AND contains({sql_key('f.name', False)}, {sql_key('text', False)})), '') AS name_families FROM t""")
def _(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("user_id"), k.alias("entry_id"), F.when(k % 3 == 0, "Blue Bolt").when(k % 3 == 1, F.col("c_name")).otherwise("standard parts").alias("text"))
    f = table(spark, d, "part").select(F.col("p_type").alias("family_id")).distinct().withColumn("name", F.concat(F.lit("The "), "family_id", F.lit(" parts")))
    r = rules.expand_avoid(t, members(spark, d), f, [("round", "(RING|GEAR)$", ["red ring"])])
    return r.select("user_id", "label", F.array_join("keys", ",").alias("keys"), F.array_join("families", ",").alias("families"), F.array_join("name_families", ",").alias("name_families"))


@query("j26_uncovered_conditions", "SELECT c_custkey AS user_id, c AS condition FROM (SELECT c_custkey, unnest([c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'pregnancy' ELSE 'rosacea' END]) AS c FROM customer) WHERE c NOT IN ('BUILDING', 'pregnancy')")
def _(spark, d):
    return rules.uncovered_conditions(profiles(spark, d), profile_rules(spark, d))


def order_items(spark, d, first_source=None):
    """Line items as resolved/open items of an order, with the suggestion candidates of the open ones; the first one is the AI's unless said otherwise."""
    first_source = F.lit("ai_agent") if first_source is None else first_source
    k = (F.col("l_partkey") + F.col("idx")) % 5
    cand = lambda n, s: F.struct(n.alias("inci_name"), F.lit(0.9).alias("score"), s.alias("source"))
    li = lines(spark, d)
    return li.select(F.col("l_orderkey").alias("label_id"), "idx", F.col("printed").alias("raw"), F.when(k == 0, "suggested").when(k == 1, "not_found").otherwise("resolved").alias("status"),
                     F.when(k > 1, F.upper("p_name")).alias("inci_name"), F.when(k > 1, F.upper("p_name")).alias("inci"), F.when(k > 1, "resolved").otherwise("none").alias("via"),
                     (F.col("l_partkey") % 9 == 0).alias("optional"), (F.col("l_quantity") > 20).alias("high_confidence"), F.when(F.col("p_size") == 7, "colorant").alias("category"),
                     F.when(k == 0, F.array(cand(F.upper("p_type"), first_source), cand(F.upper("p_name"), F.lit("dictionary")))).otherwise(F.array().cast("array<struct<inci_name:string,score:double,source:string>>")).alias("candidates"))


OI = """oi AS (SELECT l_orderkey AS label_id, idx, printed AS raw, (l_partkey + idx) % 5 AS k, upper(p_name) AS name, p_type, l_partkey % 9 = 0 AS optional, l_quantity > 20 AS high, p_size FROM li)"""


@query("j27_guess_roles", f"WITH {LI}, {OI} SELECT label_id, idx, name AS guess_name, {sql_case(TERM)} AS functions FROM (SELECT oi.*, (SELECT min(q.p_type) FROM part q WHERE upper(q.p_name) = name) AS pt FROM oi WHERE k = 0) t(label_id, idx, raw, k, name, p_type0, optional, high, p_size, p_type)")
def _(spark, d):
    f = table(spark, d, "part").groupBy(F.upper("p_name").alias("inci")).agg(F.min("p_type").alias("p_type")).select("inci", F.array(term_col()).alias("functions"))
    return review.guess_roles(order_items(spark, d), f).select("label_id", "idx", "guess_name", F.array_join("functions", ",").alias("functions"))


@query("j20_attach_proposals", f"WITH {LI}, {OI} SELECT label_id, idx, CASE WHEN k = 1 OR (k = 0 AND NOT high) THEN 'suggested' WHEN k = 0 THEN 'suggested' ELSE 'resolved' END AS status, CASE WHEN k = 1 THEN 'AI PICK' WHEN k = 0 AND NOT high THEN p_type || '|' || name || '|AI PICK' WHEN k = 0 THEN p_type || '|' || name ELSE '' END AS cands FROM oi")
def _(spark, d):
    it = order_items(spark, d)
    it = it.withColumn("notes", F.array().cast("array<string>")).withColumn("layer", F.col("status")).withColumn("candidates", F.transform("candidates", lambda c: F.struct(
        c["inci_name"].alias("inci_name"), c["score"].alias("score"), c["source"].alias("source"), F.lit(None).cast("string").alias("source_id"), F.array().cast("array<string>").alias("edits"), F.lit(None).cast("string").alias("note"))))
    p = it.select("label_id", "idx", F.lit(0).alias("ord"), F.lit("ai pick").alias("inci_name"), F.lit("dictionary").alias("source"), F.lit(None).cast("string").alias("source_id"), F.lit("close").alias("rationale"))
    return review.attach_proposals(it, p).select("label_id", "idx", "status", F.array_join(F.col("candidates.inci_name"), "|").alias("cands"))


@query("f5_o5_review_queue", f"WITH {LI}, {OI} SELECT label_id, idx, CASE k WHEN 0 THEN 'suggested' ELSE 'not_found' END AS status, k = 0 AND high AND p_size % 2 = 1 AS bulk FROM oi WHERE NOT optional AND k < 2")
def _(spark, d):
    source = F.when(F.col("p_size") % 2 == 0, "ai_agent").otherwise("dictionary")
    return review.review_queue(order_items(spark, d, source)).select("label_id", "idx", "status", "bulk")


@query("f6_apply_choices", f"""WITH {LI}, {OI}, s AS (SELECT label_id, idx, raw, {sql_key('raw', False)} AS key, CASE WHEN k < 2 AND label_id % 3 = 0 AND idx = 0 THEN 'kept' WHEN k = 0 THEN 'suggested' WHEN k = 1 THEN 'not_found' ELSE 'resolved' END AS status FROM oi),
 ch AS (SELECT label_id, key FROM s WHERE idx = 1 AND label_id % 2 = 0), kp AS (SELECT label_id, key FROM s WHERE idx = 0 AND label_id % 3 = 0)
SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY idx) - 1 AS idx, raw, CASE WHEN EXISTS (SELECT 1 FROM kp WHERE kp.label_id = s.label_id AND kp.key = s.key) THEN 'kept' WHEN status = 'kept' THEN 'kept' ELSE status END AS status
FROM (SELECT label_id, idx, raw, key, status FROM s UNION ALL SELECT DISTINCT label_id, 1000000, 'restored', 'RESTORED', 'not_found' FROM s WHERE label_id % 4 = 0) s WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.label_id = s.label_id AND ch.key = s.key)""")
def _(spark, d):
    it = order_items(spark, d).withColumn("layer", F.col("status"))
    rm = it.select("label_id").distinct().select("label_id", F.lit(7).alias("position"), F.lit("restored").alias("raw"), F.lit("price").alias("reason"))
    key = X.match_key(F.col("raw"), False)
    act = lambda df, a: df.select("label_id", key.alias("key"), F.lit(a).alias("action"), F.lit(None).cast("string").alias("value"))
    ch = act(it.where("idx = 1 AND label_id % 2 = 0"), "not_ingredient").unionByName(act(it.where("idx = 0 AND label_id % 3 = 0"), "keep")).unionByName(act(rm.where("label_id % 4 = 0"), "restore"))
    return review.apply_choices(it, rm, ch)[0].select("label_id", "idx", "raw", "status")


@query("f7_rebuild_text", f"""WITH {LI}, {OI}, p AS (SELECT label_id, string_agg(CASE WHEN idx = 0 AND label_id % 10 = 0 THEN 'NEW' ELSE raw END, ', ' ORDER BY idx) FILTER (NOT optional) AS a, string_agg(CASE WHEN idx = 0 AND label_id % 10 = 0 THEN 'NEW' ELSE raw END, ', ' ORDER BY idx) FILTER (optional) AS b FROM oi GROUP BY 1)
SELECT label_id, concat_ws(', ', a, 'may contain: ' || b, CASE WHEN label_id % 4 = 0 THEN 'EXP 01/27' END) AS text FROM p""")
def _(spark, d):
    it = order_items(spark, d)
    one = it.select("label_id").distinct()
    rm = one.where("label_id % 4 = 0").select("label_id", F.lit(0).alias("position"), F.lit("EXP 01/27").alias("raw"))
    return review.rebuild_text(it, rm, one.where("label_id % 10 = 0").select("label_id", F.lit(0).alias("idx"), F.lit("NEW").alias("text")))


@query("a3_status_counts", f"WITH {LI}, {OI} SELECT label_id, count(*) AS n_items, count(*) FILTER (k > 1) AS inci, count(*) FILTER (k = 0) AS suggested, count(*) FILTER (k = 1) AS not_found, count(*) FILTER (k < 2) AS needs_review FROM oi WHERE NOT optional GROUP BY 1")
def _(spark, d):
    it = order_items(spark, d)
    b = it.withColumn("bucket", review.bucket_of(F.col("status"), F.lit("inci_exact"), F.lit(False), F.lit(False)))
    return review.status_counts(b).select("label_id", "n_items", "inci", "suggested", "not_found", "needs_review")


@query("a4_banner", f"""WITH {LI}, {IDS}, {HITS}, {AVOID}, {OI}, x AS (SELECT oi.*, o_custkey AS user_id, EXISTS (SELECT 1 FROM av a WHERE a.label_id = oi.label_id AND a.idx = oi.idx) AND k > 1 AS hit FROM oi JOIN orders ON label_id = o_orderkey),
 g AS (SELECT label_id, user_id, count(*) FILTER (hit) AS m, count(*) FILTER (NOT optional AND k < 2) AS r, count(*) FILTER (NOT optional AND k > 1) AS i, string_agg(upper(substr(name, 1, 1)) || lower(split_part(substr(name, 2), ' ', 1)) || ' ' || upper(substr(split_part(name, ' ', 2), 1, 1)) || lower(substr(split_part(name, ' ', 2), 2)), ', ' ORDER BY idx) FILTER (hit) AS names FROM x GROUP BY ALL)
SELECT label_id, m AS avoid_matches, r AS needs_review, i AS identified, CASE WHEN user_id % 5 = 0 AND user_id % 7 <> 0 THEN 'You have not set an avoid list yet. Add one in your profile to check ingredients against it.' WHEN m > 0 THEN 'Contains ' || m || ' ingredient' || CASE WHEN m > 1 THEN 's' ELSE '' END || ' you avoid: ' || names || '.' ELSE 'Nothing on your avoid list was found among the identified ingredients.' END
 || CASE WHEN r > 0 THEN ' ' || r || ' item' || CASE WHEN r > 1 THEN 's' ELSE '' END || ' still need review.' ELSE '' END AS text FROM g""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("label_id"), F.col("o_custkey").alias("user_id"))
    it = order_items(spark, d).join(o, "label_id")
    a = avoid(spark, d)
    found = rules.avoid_matches(it.where("inci IS NOT NULL").select("label_id", "user_id", "idx", "inci"), hits(spark, d), a)
    return rules.banner(it, found, a.select("user_id")).drop("user_id")


@query("a5_label_summary", f"""WITH {LI}, {HITS}, {OI}, m AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY idx) AS rn, upper(substr(name, 1, 1)) || lower(split_part(substr(name, 2), ' ', 1)) || ' ' || upper(substr(split_part(name, ' ', 2), 1, 1)) || lower(substr(split_part(name, ' ', 2), 2)) AS t FROM oi WHERE NOT optional)
SELECT label_id, count(*) AS listed, count(*) FILTER (k > 1) AS identified, string_agg(CASE WHEN k > 1 THEN t ELSE '“' || raw || '”' END, ', ' ORDER BY rn) FILTER (rn <= 3) AS first_three, false AS water_first,
 string_agg(t, ', ' ORDER BY rn) FILTER (k > 1 AND EXISTS (SELECT 1 FROM hits WHERE hits.inci = m.name AND family_id = 'round')) AS round FROM m GROUP BY 1""")
def _(spark, d):
    return rules.label_summary(order_items(spark, d), hits(spark, d), ["round"])


@query("a6_role_overview", f"""WITH {LI}, {OI}, r AS (SELECT upper(p_name) AS inci, min(p_type) AS p_type FROM part GROUP BY 1), x AS (SELECT label_id, idx, CASE WHEN k < 2 THEN 'to_confirm' ELSE {sql_case(ROLE, 'r.p_type')} END AS family, CASE WHEN k > 1 THEN name ELSE raw END AS n FROM oi JOIN r ON r.inci = oi.name)
SELECT label_id, family, list_position({list(X.ROLE_BLURB) + ['none', 'to_confirm']}, family) - 1 AS ord, count(*) AS n, string_agg(n, ', ' ORDER BY idx) AS names FROM x GROUP BY label_id, family""")
def _(spark, d):
    f = table(spark, d, "part").groupBy(F.upper("p_name").alias("inci")).agg(F.min("p_type").alias("p_type")).select("inci", F.array(term_col()).alias("functions"), F.lit("official").alias("kind"), F.lit("https://x").alias("url"))
    roles = rules.roles_of(part_names(spark, d).select(F.col("inci_name").alias("inci")), f)
    it = order_items(spark, d).select("label_id", "idx", "inci", "raw", F.when(F.col("via") == "none", "to_confirm").otherwise("identified").alias("status"))
    return rules.role_overview(it, roles)


@query("o3_evaluate_findings", f"""WITH {LI}, {IDS}, {HITS}, {AVOID}, f AS (SELECT label_id, user_id, idx, 'avoid_list' AS kind, entry_id AS rule_id, raw AS tier FROM av UNION ALL SELECT DISTINCT label_id, user_id, idx, 'family_note', 'n-round', 'note' FROM ids JOIN hits USING (inci) WHERE family_id = 'round')
SELECT label_id, idx, kind, rule_id, tier, row_number() OVER (PARTITION BY label_id, user_id, idx ORDER BY list_position(['avoid', 'caution', 'note'], tier), kind, rule_id) - 1 AS ord FROM f""")
def _(spark, d):
    i, h = ids(spark, d), hits(spark, d)
    a = rules.avoid_matches(i, h, avoid(spark, d)).select("label_id", "user_id", "idx", F.lit("avoid_list").alias("kind"), F.col("entry_id").alias("rule_id"), "tier")
    n = rules.family_notes(i, h, h.where("family_id = 'round'").select(F.lit("n-round").alias("note_id"), "family_id").distinct()).select("label_id", "user_id", "idx", F.lit("family_note").alias("kind"), F.col("note_id").alias("rule_id"), F.lit("note").alias("tier"))
    return rules.evaluate_findings(a, n).drop("user_id")


def benchmark_claims(spark, d):
    """Claims whose phrases are the windows of two and three words of the benchmark texts."""
    claim, kind = F.concat(F.lit("c"), (F.col("item_id") % 10).cast("string")), F.when(F.col("item_id") % 2 == 0, "free_from").otherwise("ingredient")
    return benchmark_phrases(spark, d, (2, 3)).select(claim.alias("claim_id"), kind.alias("kind"), F.col("item_id").cast("int").alias("ord"), "phrase")


@query("c1_extract_claims", f"""WITH hit AS ({PHRASE_SQL}), cl AS (SELECT 'c' || (item_id % 10) AS claim_id, CASE WHEN item_id % 2 = 0 THEN 'free_from' ELSE 'ingredient' END AS kind, item_id AS ord, array_to_string(ws[i:i + k], ' ') AS phrase FROM (SELECT item_id, ws, k, unnest(range(1, CAST(len(ws) AS BIGINT) - k + 1)) AS i FROM (VALUES (1), (2)) t(k), (SELECT item_id, regexp_split_to_array(text, '\\s+') AS ws FROM benchmark))),
 j AS (SELECT doc_id, claim_id, kind, matched, edits, row_number() OVER (PARTITION BY doc_id, claim_id ORDER BY CASE kind WHEN 'free_from' THEN 1 ELSE 4 END, ord, matched) AS rn FROM hit JOIN cl USING (phrase))
SELECT doc_id, claim_id, kind, matched, edits FROM j WHERE rn = 1""")
def _(spark, d):
    return claims.extract_claims(dealt(table(spark, d, "documents"), "doc_id"), benchmark_claims(spark, d))


CLAIM_SQL = f"""WITH {LI}, {HITS}, {OI}, h2 AS (SELECT inci, CASE family_id WHEN 'round' THEN 'fragrance_mixtures' WHEN 'PROMO' THEN 'eu_fragrance_allergens' WHEN 'SMALL' THEN 'solvent_alcohols' ELSE family_id END AS f FROM hits),
 e AS (SELECT label_id, count(*) FILTER (NOT optional AND k < 2) > 0 AS open, coalesce(bool_or(k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'fragrance_mixtures')), false) AS parfum, coalesce(bool_or(k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'eu_fragrance_allergens')), false) AS allerg,
  coalesce(bool_or(k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'solvent_alcohols')), false) AS solv, coalesce(bool_or(k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'LARGE')), false) AS fam, bool_or(k > 1 AND p_size = 7 AND NOT optional) AS col, bool_or(k > 1 AND p_size = 7 AND optional) AS colo,
  bool_or(k > 1 AND (name = 'RED BOLT' OR regexp_matches(name, 'GEAR$'))) AS ing FROM oi GROUP BY 1),
 c AS (SELECT e.*, claim_id FROM e, (VALUES ('fragrance'), ('alcohol'), ('colorant'), ('family'), ('unsupported'), ('gears'), ('gentle')) t(claim_id)),
 v AS (SELECT label_id, claim_id, CASE claim_id WHEN 'gentle' THEN 'not_verifiable' WHEN 'unsupported' THEN 'needs_context' WHEN 'gears' THEN CASE WHEN ing THEN 'matches' WHEN open THEN 'needs_context' ELSE 'contradiction' END
  WHEN 'fragrance' THEN CASE WHEN parfum THEN 'contradiction' WHEN allerg OR open THEN 'needs_context' ELSE 'consistent' END WHEN 'alcohol' THEN CASE WHEN solv THEN 'contradiction' WHEN open THEN 'needs_context' ELSE 'consistent' END
  WHEN 'colorant' THEN CASE WHEN col THEN 'contradiction' WHEN colo OR open THEN 'needs_context' ELSE 'consistent' END ELSE CASE WHEN fam THEN 'contradiction' WHEN open THEN 'needs_context' ELSE 'consistent' END END AS verdict FROM c)
SELECT label_id, claim_id, verdict, row_number() OVER (PARTITION BY label_id ORDER BY list_position(['contradiction', 'needs_context', 'matches', 'consistent', 'not_verifiable'], verdict), claim_id) - 1 AS ord FROM v"""


@query("c2_o4_check_claims", CLAIM_SQL)
def _(spark, d):
    return checked_claims(spark, d).select("label_id", "claim_id", "verdict", "ord")


# what each verdict rests on: the outcome, the places of the ingredients and how they read
EVIDENCE_SQL = f"""{CLAIM_SQL[:CLAIM_SQL.index("SELECT label_id, claim_id, verdict")].rstrip()},
 t AS (SELECT oi.*, upper(substr(name, 1, 1)) || lower(split_part(substr(name, 2), ' ', 1)) || ' ' || upper(substr(split_part(name, ' ', 2), 1, 1)) || lower(substr(split_part(name, ' ', 2), 2)) AS shown FROM oi),
 x AS (SELECT c.label_id, c.claim_id, e.open, CASE c.claim_id WHEN 'gentle' THEN 'unverifiable' WHEN 'unsupported' THEN 'unsupported' WHEN 'gears' THEN CASE WHEN e.ing THEN 'ingredient.named' WHEN e.open THEN 'ingredient.open' ELSE 'ingredient.missing' END
   WHEN 'fragrance' THEN CASE WHEN e.parfum THEN 'fragrance.mixture' WHEN e.allerg THEN 'fragrance.allergen' ELSE 'fragrance.none' END WHEN 'alcohol' THEN CASE WHEN e.solv THEN 'alcohol.solvent' ELSE 'alcohol.none' END
   WHEN 'colorant' THEN CASE WHEN e.col THEN 'colorant.named' WHEN e.colo THEN 'colorant.optional' ELSE 'colorant.none' END ELSE CASE WHEN e.fam THEN 'family.member' ELSE 'family.none' END END AS outcome FROM c JOIN e USING (label_id)),
 ev AS (SELECT x.label_id, x.claim_id, t.idx, CASE WHEN outcome LIKE 'colorant%' THEN t.raw ELSE t.shown END AS n FROM x JOIN t ON t.label_id = x.label_id AND CASE outcome
   WHEN 'ingredient.named' THEN k > 1 AND (name = 'RED BOLT' OR regexp_matches(name, 'GEAR$')) WHEN 'fragrance.mixture' THEN k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'fragrance_mixtures')
   WHEN 'fragrance.allergen' THEN k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'eu_fragrance_allergens') WHEN 'alcohol.solvent' THEN k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'solvent_alcohols')
   WHEN 'colorant.named' THEN k > 1 AND p_size = 7 AND NOT optional WHEN 'colorant.optional' THEN k > 1 AND p_size = 7 AND optional WHEN 'family.member' THEN k > 1 AND EXISTS (SELECT 1 FROM h2 WHERE h2.inci = name AND f = 'LARGE') ELSE false END),
 l AS (SELECT label_id, claim_id, string_agg(idx, ',' ORDER BY idx) AS items, string_agg(n, ', ' ORDER BY idx) AS names FROM ev GROUP BY ALL)
SELECT x.label_id, x.claim_id, outcome, coalesce(items, '') AS items, coalesce(names, '') AS names FROM x LEFT JOIN l USING (label_id, claim_id)"""


@query("c2_claim_evidence", EVIDENCE_SQL)
def _(spark, d):
    return checked_claims(spark, d).select("label_id", "claim_id", "outcome", F.array_join("items", ",").alias("items"), "names")


def checked_claims(spark, d):
    it = order_items(spark, d)
    f = F.col("family_id")
    h = hits(spark, d).withColumn("family_id", F.when(f == "round", "fragrance_mixtures").when(f == "PROMO", "eu_fragrance_allergens").when(f == "SMALL", "solvent_alcohols").otherwise(f))
    none = F.array().cast("array<string>")
    kinds = F.array(*[F.struct(F.lit(c).alias("claim_id"), F.lit(k).alias("kind"), F.lit(l).alias("logic"), F.lit(fam).cast("string").alias("family_id")) for c, k, l, fam in [
        ("fragrance", "free_from", "fragrance", None), ("alcohol", "free_from", "alcohol", None), ("colorant", "free_from", "colorant", None), ("family", "free_from", "family", "LARGE"), ("unsupported", "free_from", "unsupported", None), ("gears", "ingredient", "ingredient", None), ("gentle", "unverifiable", "unverifiable", None)]])
    det = it.select("label_id").distinct().select("label_id", F.explode(kinds).alias("c")).select("label_id", "c.*")
    r = det.select("claim_id", "logic", "family_id").distinct().withColumn("inci", F.when(F.col("claim_id") == "gears", F.array(F.lit("Red Bolt"))).otherwise(none)).withColumn("patterns", F.when(F.col("claim_id") == "gears", F.array(F.lit("gear$"))).otherwise(none))
    return claims.check_claims(det.select("label_id", "claim_id", "kind"), it, h, r)


@query("c3_g9_misspellings", f"""WITH {WORDS_SQL}, dic AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> ''),
 w AS (SELECT DISTINCT doc_id, lower(p) AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS p FROM words WHERE confidence >= 80) WHERE length(p) >= 4),
 u AS (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT w FROM dic)),
 nb AS (SELECT DISTINCT u.word, dv.w FROM (SELECT word, word AS v FROM u UNION SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM u)) uv
  JOIN (SELECT w, w AS v FROM dic UNION SELECT w, substr(w, 1, i - 1) || substr(w, i + 1) FROM (SELECT w, CAST(unnest(range(1, length(w) + 1)) AS INT) AS i FROM dic)) dv USING (v) JOIN u ON u.word = uv.word),
 n AS (SELECT word, w AS s, row_number() OVER (PARTITION BY word ORDER BY length(w), w) AS rn FROM nb WHERE damerau_levenshtein(word, w) = 1)
SELECT doc_id, word, s AS suggestion FROM w JOIN n USING (word) WHERE rn = 1""")
def _(spark, d):
    dic = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where("word <> ''")
    return claims.misspellings(document_words(spark, d), dic)


@query("c3_misspelling_notice", f"""WITH {WORDS_SQL}, dic AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> ''),
 w AS (SELECT DISTINCT doc_id, lower(p) AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS p FROM words WHERE confidence >= 80) WHERE length(p) >= 4),
 u AS (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT w FROM dic)),
 nb AS (SELECT DISTINCT u.word, dv.w FROM (SELECT word, word AS v FROM u UNION SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM u)) uv
  JOIN (SELECT w, w AS v FROM dic UNION SELECT w, substr(w, 1, i - 1) || substr(w, i + 1) FROM (SELECT w, CAST(unnest(range(1, length(w) + 1)) AS INT) AS i FROM dic)) dv USING (v) JOIN u ON u.word = uv.word),
 n AS (SELECT DISTINCT word FROM nb WHERE damerau_levenshtein(word, w) = 1)
SELECT doc_id, count(*) AS n_words FROM w JOIN n USING (word) GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, d):
    dic = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where("word <> ''")
    return claims.misspelling_notice(claims.misspellings(document_words(spark, d), dic))
