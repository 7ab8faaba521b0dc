"""Queries for the joins between printed text and dictionary names, and for the resolver."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import matching as M, resolve as R, review
from ..operators.dictionary import alias_override, first_per, name_vocabulary, suffix_frequency
from ..operators.resolve import exact_baseline, resolve_labels
from ..runtime import dealt, durable
from .registry import LI, SQL_CLEAN, lines, order_labels, part_dictionary, part_names, query, sql_key, table
from .text_queries import SPLIT_SQL

NAMES = "names AS (SELECT DISTINCT upper(p_name) AS name FROM part)"


@query("entry_known_ingredients", f"""
WITH base AS (SELECT doc_id, {SQL_CLEAN} AS t FROM documents), {SPLIT_SQL}, {NAMES},
 k AS (SELECT doc_id, {sql_key('p')} AS key FROM pc WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''), d AS (SELECT DISTINCT {sql_key("w")} AS key FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark))
SELECT doc_id, count(*) AS n_items, count(d.key) AS n_known FROM k LEFT JOIN d ON k.key = d.key GROUP BY doc_id""")
def _(spark, d):
    # the dictionary of this query: the words of the benchmark texts
    n = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.upper("w").alias("inci_name")).distinct()
    from ..operators.dictionary import build_dictionary
    dic = build_dictionary(n, n.select("inci_name", F.lit("x").alias("alias"), F.lit("x").alias("kind")).where("false"), {})
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("label_id"), F.col("text").alias("raw"))
    b = exact_baseline(docs, dic)
    return b.groupBy(F.col("label_id").alias("doc_id")).agg(F.count("*").alias("n_items"), F.count("inci_name").alias("n_known"))


VARIANTS = """v AS (SELECT l_orderkey, idx, l_partkey % 6 AS m, upper(p_name) AS name, CASE l_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (x y)' WHEN 2 THEN 'foo (' || p_name || ')' WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
  WHEN 4 THEN 'zz/' || p_name || '/yy' ELSE 'qq ' || p_name || ' oil' END AS raw FROM li)"""


def variants(spark, d):
    m, w = F.col("l_partkey") % 6, F.split("p_name", " ")
    raw = (F.when(m == 0, F.col("p_name")).when(m == 1, F.concat("p_name", F.lit(" (x y)"))).when(m == 2, F.concat(F.lit("foo ("), "p_name", F.lit(")"))).when(m == 3, F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0))))
           .when(m == 4, F.concat(F.lit("zz/"), "p_name", F.lit("/yy"))).otherwise(F.concat(F.lit("qq "), "p_name", F.lit(" oil"))))
    return lines(spark, d).select("l_orderkey", "idx", raw.alias("raw"))


@query("j1_static_ladder", f"""
WITH {LI}, {VARIANTS}
SELECT l_orderkey, idx, raw, CASE m WHEN 3 THEN 'inci_alias' WHEN 4 THEN 'inci_alias' WHEN 5 THEN NULL ELSE 'inci_exact' END AS layer, CASE WHEN m < 5 THEN name END AS inci_name,
 CASE m WHEN 3 THEN 'Matched through a common name alias.' WHEN 4 THEN 'Matched through a slash synonym.' END AS note FROM v""")
def _(spark, d):
    v = variants(spark, d)
    s = M.static_ladder(v.select("raw").distinct(), part_dictionary(spark, d))
    return v.join(s.select("raw", "layer", "inci_name", F.get("notes", F.lit(0)).alias("note")), "raw", "left")


@query("j2_alias_override", f"""
WITH {NAMES}, a AS (SELECT DISTINCT 'RED ' || split_part(upper(p_name), ' ', 2) AS alias, 'BLUE ' || split_part(upper(p_name), ' ', 2) AS target FROM part)
SELECT name AS inci_name, {sql_key('name')} AS key FROM names WHERE NOT EXISTS (SELECT 1 FROM a WHERE {sql_key('alias')} = {sql_key('name')} AND target <> name)""")
def _(spark, d):
    n = part_names(spark, d).withColumn("key", X.match_key(F.col("inci_name")))
    w2 = F.split_part("inci_name", F.lit(" "), F.lit(2))
    a = n.select(X.match_key(F.concat(F.lit("RED "), w2)).alias("key"), F.concat(F.lit("BLUE "), w2).alias("inci_name"), F.lit("common_name").alias("kind")).distinct()
    return alias_override(n, a)


@query("j3_fuzzy_topk")
def _(spark, d):
    k = lines(spark, d).select(M.fuzzy_key(F.col("printed")).alias("key")).distinct()
    r = M.fuzzy_topk(k, part_dictionary(spark, d))
    return r.select("key", F.posexplode("cands").alias("rank", "c")).select("key", "rank", "c.inci_name", F.round("c.score", 3).alias("score"), F.array_join("c.edits", "; ").alias("edits"), "c.unexplained")


@query("j3_fuzzy_pool_documents")
def _(spark, d):
    # every word of every document against the names: the pool before glyph-aware scoring
    w = dealt(table(spark, d, "documents"), "doc_id").select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).select(X.match_key(F.col("w")).alias("key")).where(F.length("key").between(3, 60)).distinct()
    p = M.name_pool(w, part_dictionary(spark, d).corpus)
    return p.groupBy("key").agg(F.count("*").alias("n"), F.min_by("cand_key", "pool_pos").alias("best"))


@query("j4_word_swap_note", f"""
WITH {NAMES}, p AS (SELECT DISTINCT upper(a.p_name) AS text, upper(b.p_name) AS inci_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
 x AS (SELECT text, inci_name, list_filter(regexp_extract_all(text, '[A-Z0-9]{{3,}}'), lambda w: length(w) >= 4 AND NOT list_contains(regexp_extract_all(inci_name, '[A-Z0-9]{{3,}}'), w)) AS tw,
  list_filter(regexp_extract_all(inci_name, '[A-Z0-9]{{3,}}'), lambda w: length(w) >= 4 AND NOT list_contains(regexp_extract_all(text, '[A-Z0-9]{{3,}}'), w)) AS cw FROM p WHERE inci_name IS NOT NULL)
SELECT text, inci_name, 'Printed ''' || tw[1][1] || lower(tw[1][2:]) || ''' is a different ingredient word from ''' || cw[1][1] || lower(cw[1][2:]) || '''. This may be a different ingredient, not a misspelling: check the pack.' AS note
FROM x WHERE len(tw) > 0 AND len(cw) > 0""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("text"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("text").alias("inci_name")), "p_partkey").select("text", "inci_name")
    return M.word_swap_notes(pairs, part_dictionary(spark, d))


@query("j5_compound_lookup", """
WITH t AS (SELECT s_name AS text FROM supplier UNION SELECT 'zq' || s_suppkey || 'wvxy' FROM supplier UNION SELECT s_name || '7' FROM supplier UNION SELECT '50-00-' || s_suppkey FROM supplier),
 k AS (SELECT upper(s_name) AS k, min(s_suppkey) AS cid FROM supplier GROUP BY 1 UNION ALL SELECT '50-00-' || s_suppkey, s_suppkey FROM supplier)
SELECT text, CASE WHEN cid IS NOT NULL THEN 'match' WHEN text LIKE 'zq%' THEN 'not_found' ELSE 'ambiguous' END AS status, cid FROM t LEFT JOIN k ON upper(text) = k.k""")
def _(spark, d):
    s = table(spark, d, "supplier")
    num = F.col("s_suppkey").cast("string")
    t = s.select(F.explode(F.array("s_name", F.concat(F.lit("zq"), num, F.lit("wvxy")), F.concat("s_name", F.lit("7")), F.concat(F.lit("50-00-"), num))).alias("text"))
    return M.compound_lookup(t, s.select(F.col("s_suppkey").alias("cid"), F.col("s_name").alias("name"), F.concat(F.lit("50-00-"), num).alias("cas"))).drop("names")


NEAREST = f"""{NAMES}, nk AS (SELECT name, {sql_key('name', False)} AS nk FROM names),
 t AS (SELECT DISTINCT printed AS text, {sql_key('printed', False)} AS k FROM li),
 tg AS (SELECT DISTINCT k, substr(k, i, 3) AS g FROM (SELECT k, unnest(range(1, CAST(length(k) AS BIGINT) - 1)) AS i FROM t WHERE length(k) >= 4)),
 ng AS (SELECT DISTINCT name, nk, substr(nk, i, 3) AS g FROM (SELECT name, nk, unnest(range(1, CAST(length(nk) AS BIGINT) - 1)) AS i FROM nk)),
 tot AS (SELECT k, count(*) AS tot FROM tg GROUP BY k),
 pr AS (SELECT tg.k, name, nk, count(*) AS c FROM tg JOIN ng USING (g) GROUP BY ALL),
 sc AS (SELECT k, name, 1 - levenshtein(k, nk) / greatest(length(k), length(nk)) AS sim FROM pr JOIN tot USING (k) WHERE c >= greatest(2, floor(tot * 0.35)) AND levenshtein(k, nk) <= floor((1 - 0.6::DOUBLE) * greatest(length(k), length(nk)))),
 be AS (SELECT k, name, sim FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sim DESC, name) rn FROM sc) WHERE rn = 1)"""


@query("j9_nearest_name", f"WITH {LI}, {NEAREST} SELECT text, be.name, round(sim, 6) AS sim FROM t LEFT JOIN be USING (k)")
def _(spark, d):
    r = M.nearest_name(lines(spark, d).select(F.col("printed").alias("text")).distinct(), part_names(spark, d))
    return r.withColumn("sim", F.round("sim", 6))


@query("j9_nearest_name_documents")
def _(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("text")).distinct()
    names = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("inci_name")).distinct()
    return M.nearest_name(w, names).where("name IS NOT NULL")


@query("m3_similar_pairs", r"""
WITH v AS (SELECT DISTINCT lower(w) AS k FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents) WHERE w <> ''),
 b AS (SELECT DISTINCT lower(w) AS k FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> '')
SELECT v.k AS left_key, b.k AS right_key, round(1 - levenshtein(v.k, b.k) / greatest(length(v.k), length(b.k)), 6) AS sim FROM v JOIN b ON 1 - levenshtein(v.k, b.k) / greatest(length(v.k), length(b.k)) >= 0.75""")
def _(spark, d):
    words = lambda n: table(spark, d, n).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("w <> ''").select(F.lower("w").alias("k")).distinct()
    return M.similar_pairs(words("documents"), words("benchmark"), 0.75).withColumn("sim", F.round("sim", 6))


PHRASE_SQL = r"""
WITH ph AS (SELECT DISTINCT array_to_string(ws[i:i + k], ' ') AS phrase FROM (SELECT ws, k, unnest(range(1, CAST(len(ws) AS BIGINT) - k + 1)) AS i FROM (VALUES (1), (2)) t(k), (SELECT regexp_split_to_array(text, '\s+') AS ws FROM benchmark))),
 pn AS (SELECT phrase, trim(regexp_replace(regexp_replace(lower(phrase), '[’''`]', '', 'g'), '[^a-z0-9%]+', ' ', 'g')) AS pw FROM ph),
 pk AS (SELECT phrase, regexp_replace(pw, '[^a-z0-9]', '', 'g') AS key, len(string_split(pw, ' ')) AS nw FROM pn),
 p AS (SELECT *, CASE WHEN length(key) < 10 THEN 0 WHEN length(key) < 16 THEN 1 ELSE 2 END AS budget FROM pk WHERE length(key) >= 5),
 w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[’''`]', '', 'g'), '[^a-z0-9%]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
 pe AS (SELECT phrase, key, budget, n, substr(key, 1, 1) AS c1, unnest(range(length(key) - budget, length(key) + budget + 1)) AS len FROM (SELECT *, unnest(range(greatest(1, nw - 1), nw + 2)) AS n FROM p)),
 x AS (SELECT doc_id, n, unnest(range(0, CAST(len(ws) AS BIGINT) - n + 1)) AS i, ws FROM w, (SELECT DISTINCT n FROM pe)),
 y AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS matched, regexp_replace(array_to_string(ws[i + 1:i + n], ''), '[^a-z0-9]', '', 'g') AS j FROM x),
 h AS (SELECT doc_id, phrase, y.n, i, matched, levenshtein(j, key) AS edits FROM y JOIN pe ON y.n = pe.n AND substr(j, 1, 1) = c1 AND length(j) = len WHERE levenshtein(j, key) <= budget)
SELECT doc_id, phrase, matched, edits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY n, i) rn FROM h) WHERE rn = 1"""


def benchmark_phrases(spark, d, sizes=(2,)):
    """(item_id, phrase): every window of the benchmark texts of so many words."""
    ws = table(spark, d, "benchmark").select("item_id", F.split("text", r"\s+").alias("ws"))
    of = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: F.array_join(F.slice("ws", i, n), " "))).otherwise(F.array().cast("array<string>"))
    return ws.select("item_id", F.explode(F.concat(*map(of, sizes))).alias("phrase"))


@query("m5_find_phrases", PHRASE_SQL)
def _(spark, d):
    ph = benchmark_phrases(spark, d, (2, 3)).select("phrase").distinct()
    return M.find_phrases(dealt(table(spark, d, "documents"), "doc_id"), ph)


@query("m6_character_error_rate", f"""
WITH b AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id, turn, round(levenshtein({sql_key('text')}, {sql_key('nx')}) / greatest(1, length({sql_key('nx')})), 6) AS cer FROM b WHERE nx IS NOT NULL""")
def _(spark, d):
    from ..operators.evaluate import character_error_rate
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("nx", F.lead("text").over(w)).where("nx IS NOT NULL")
    c = c.select("conv_id", "turn", X.nfkc(F.col("text")).alias("text"), X.nfkc(F.col("nx")).alias("nx"))
    return c.select("conv_id", "turn", F.round(character_error_rate(F.col("text"), F.col("nx")), 6).alias("cer"))


@query("j21_search_names", """
WITH q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || substr(p_name, 1, 2) FROM part UNION SELECT DISTINCT substr(p_name, 1, 2) FROM part),
 n AS (SELECT DISTINCT upper(p_name) AS name FROM part),
 h AS (SELECT query, name, list_filter(regexp_extract_all(upper(query), '[A-Z0-9]+'), lambda w: length(w) >= 2)[1:3] AS ws, regexp_extract_all(name, '[A-Z0-9]+') AS toks FROM q, n),
 m AS (SELECT query, name, len(list_filter(ws, lambda w: NOT list_contains(toks, w))) > 0 AS part, NOT starts_with(name, ws[1]) AS inside FROM h WHERE len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(name, w))) = 0)
SELECT query, rank, name FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY part, inside, length(name), name) AS rank FROM m) WHERE rank <= 10""")
def _(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.explode(F.array("p_name", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), F.substring("p_name", 1, 2)), F.substring("p_name", 1, 2))).alias("query"))
    return M.search_names(q, part_names(spark, d))


@query("j22_lookup_by_cas", "SELECT c_custkey, 'C' || (c_custkey % 3000) AS cas, n AS inci_name FROM customer LEFT JOIN (SELECT 'C' || p_partkey AS cas, min(upper(p_name)) AS n FROM part GROUP BY 1) p ON p.cas = 'C' || (c_custkey % 3000)")
def _(spark, d):
    q = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), (F.col("c_custkey") % 3000).cast("string")).alias("cas"))
    return M.lookup_by_cas(q, table(spark, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cas"), F.upper("p_name").alias("inci_name")))


@query("j23_neighbours", """
SELECT event_id, coalesce(lag(event_type) OVER w, '') AS prev_name, coalesce(lead(event_type) OVER w, '') AS next_name FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("label_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("inci_name"), F.lit("").alias("raw"))
    return review.neighbours(e).select(F.col("idx").alias("event_id"), "prev_name", "next_name")


@query("j19_supported_proposals", """
WITH e AS (SELECT user_id AS session_id, event_id % 10 AS tool, event_type, value FROM events),
 ev AS (SELECT session_id, tool, upper(event_type) AS key, min('D ' || event_type) AS display FROM e WHERE value > 30 GROUP BY ALL),
 p AS (SELECT s AS session_id, o AS ord, n FROM (SELECT DISTINCT user_id AS s FROM events), (VALUES (0, 'click'), (1, 'view'), (2, 'error')) t(o, n)),
 h AS (SELECT p.session_id, p.ord, p.n, e FROM p, (SELECT unnest(range(0, 3)) AS e) x WHERE EXISTS (SELECT 1 FROM ev WHERE ev.session_id = p.session_id AND ev.key = upper(p.n) AND ev.tool = (p.session_id + p.ord + x.e) % 10))
SELECT DISTINCT session_id, ord, 'D ' || n AS inci_name FROM h""")
def _(spark, d):
    e = table(spark, d, "events")
    ev = e.where("value > 30").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("tool_call_id"), X.match_key(F.col("event_type")).alias("key"), F.concat(F.lit("D "), "event_type").alias("display"), F.lit("dictionary").alias("source"), F.lit(None).cast("string").alias("source_id"))
    p = e.select(F.col("user_id").alias("session_id")).distinct().select("session_id", F.posexplode(F.array(F.lit("click"), F.lit("view"), F.lit("error"))).alias("ord", "inci_name"))
    p = p.withColumn("evidence_ids", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (F.col("session_id") + F.col("ord") + i) % 10)).withColumn("rationale", F.lit("matches the printed text"))
    return review.supported_proposals(p, ev).select("session_id", "ord", "inci_name")


# ---- windows and the resolver

@query("a1_vocabulary_suffixes", f"WITH {NAMES}, w AS (SELECT split_part(name, ' ', 2) AS last_word, count(*) AS n FROM names GROUP BY 1) SELECT last_word, n, (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(name, '[A-Z0-9]{{3,}}')) AS x FROM names)) AS n_words FROM w")
def _(spark, d):
    n = part_names(spark, d)
    return suffix_frequency(n).join(name_vocabulary(n).agg(F.count("*").alias("n_words")), F.lit(True))


@query("a2_corpus", f"""
WITH {NAMES} SELECT {sql_key('name')} AS key, name AS inci_name, (SELECT count(*) FROM names m WHERE split_part(m.name, ' ', 2) = split_part(n.name, ' ', 2)) AS prior FROM names n
UNION ALL SELECT {sql_key("split_part(name, ' ', 2) || split_part(name, ' ', 1)")}, name, (SELECT count(*) FROM names m WHERE split_part(m.name, ' ', 2) = split_part(n.name, ' ', 2)) FROM names n""")
def _(spark, d):
    return part_dictionary(spark, d).corpus


@query("w1_merge_fragments", """
WITH e AS (SELECT user_id, event_id, value, event_type, lead(value) OVER w AS nv, lead(event_type) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 q AS (SELECT *, coalesce(value + nv > 40, false) AND event_type <> nt AS q FROM e),
 r AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM q),
 p AS (SELECT *, q AND row_number() OVER (PARTITION BY user_id, run, q ORDER BY event_id) % 2 = 1 AS pick FROM r),
 t AS (SELECT *, sum(CASE WHEN coalesce(event_type <> nt, false) AND NOT coalesce(lp, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS tries FROM (SELECT *, lag(pick) OVER (PARTITION BY user_id ORDER BY event_id) AS lp FROM p))
SELECT event_id, pick AND tries <= 40 AS merge_next FROM t""")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    tried = F.lead("event_type").over(w) != F.col("event_type")
    g = R.greedy_pairs(e, ["user_id"], "event_id", (F.col("value") + F.lead("value").over(w) > 40) & tried, tried, 40)
    return g.select("event_id", "merge_next")


@query("w3_confidence_flags", """
WITH o AS (SELECT o_custkey, o_totalprice / 500000 AS s, o_orderkey % 4 AS un, o_orderkey % 3 AS ex, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders),
 t AS (SELECT a.o_custkey, a.s, a.un, a.ex, a.s - coalesce(b.s, 0) AS m FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.rn = 2 WHERE a.rn = 1)
SELECT o_custkey, ((s >= 0.80 AND m >= 0.08 AND un <= 1) OR (s >= 0.85 AND m >= 0.15)) AND ex < 2 AS high FROM t""")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    edits = F.slice(F.array(F.lit("extra 'A'"), F.lit("extra 'B'")), 1, (F.col("o_orderkey") % 3).cast("int"))
    c = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rn", (F.col("o_totalprice") / 500000).alias("score"), edits.alias("edits"), (F.col("o_orderkey") % 4).alias("unexplained")))).alias("c"))
    return c.select("o_custkey", R.confidence_flag(F.col("c"), R.Thresholds()).alias("high"))


@query("w6_first_per_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return first_per(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("o1_top_candidates", "SELECT o_custkey, rank, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "rank", "o_orderkey")


@query("e5_exact_baseline", f"""
WITH {LI}, {NAMES} SELECT l_orderkey AS label_id, count(*) AS n_items, count(*) FILTER (EXISTS (SELECT 1 FROM names WHERE {sql_key('name')} = {sql_key('printed')})) AS n_resolved FROM li GROUP BY 1""")
def _(spark, d):
    b = exact_baseline(order_labels(spark, d), part_dictionary(spark, d))
    return b.groupBy("label_id").agg(F.count("*").alias("n_items"), F.count("inci_name").alias("n_resolved"))


def resolved_orders(spark, d):
    return resolve_labels(order_labels(spark, d), part_dictionary(spark, d), one_source=True)


@query("w5_resolve_labels")
def _(spark, d):
    """Flagship: every printed label resolved; one row per label with its counts by status."""
    items = resolved_orders(spark, d).items
    return items.groupBy("label_id").agg(F.count("*").alias("n_items"), *[F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "suggested", "ambiguous", "not_found")],
                                         F.count_if("high_confidence").alias("high_confidence"), F.count("merged_from").alias("merged"), F.count("split_from").alias("split"))


@query("w5_resolve_items")
def _(spark, d):
    i = resolved_orders(spark, d).items
    return i.select("label_id", "idx", "raw", "status", "layer", "inci_name", F.get("candidates", F.lit(0))["inci_name"].alias("top"), "high_confidence", "merged_from", "split_from")


@query("w5_resolve_documents")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("label_id"), F.lit(0).alias("source_index"), F.col("text").alias("raw"))
    r = resolve_labels(docs, part_dictionary(spark, d), one_source=True)
    return r.items.groupBy("status", "layer").agg(F.count("*").alias("n")).unionByName(r.removed.groupBy(F.lit("removed").alias("status"), F.col("kind").alias("layer")).agg(F.count("*").alias("n")))
