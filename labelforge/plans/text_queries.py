"""Queries for string columns, generators, filters and pack facts."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import pack as P, text as X
from ..operators import ocr, review, rules, segment as S
from ..operators.matching import find_phrases
from ..operators.resolve import split_non_ingredients
from ..runtime import dealt
from .registry import LI, SQL_CLEAN, lines, query, sql_key, table

TITLE = ("list_aggregate(list_transform(range(1, CAST(length(s) AS BIGINT) + 1), lambda i: CASE WHEN regexp_matches(c[i], '[a-z]') AND (i = 1 OR regexp_matches(c[i - 1], '[\\s/(-]')) THEN upper(c[i]) ELSE c[i] END), 'string_agg', '')")


@query("normalise_names", f"""
WITH n AS (SELECT p_partkey, p_name || '-' || lower(p_brand) || ' (' || lower(p_type) || ')/x' AS raw FROM part)
SELECT p_partkey, {sql_key('raw')} AS key, {sql_key('raw', False)} AS plain_key, trim(regexp_replace(raw, '\\s*\\([^)]*\\)', '', 'g')) AS no_parens,
 regexp_extract(raw || ')', '\\(([^()]+)\\)\\s*$', 1) AS inner_text, {TITLE} AS title, trim(regexp_replace(regexp_replace(upper(raw), '[^A-Z0-9/,.\\- ]', '', 'g'), '\\s+', ' ', 'g')) AS label
FROM (SELECT *, lower(raw) AS s, string_split(lower(raw), '') AS c FROM n)""")
def _(spark, d):
    raw = F.concat("p_name", F.lit("-"), F.lower("p_brand"), F.lit(" ("), F.lower("p_type"), F.lit(")/x"))
    n = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    r = F.col("raw")
    return n.select("p_partkey", X.match_key(r).alias("key"), X.match_key(r, False).alias("plain_key"), X.strip_parens(r).alias("no_parens"),
                    X.inner_parens(F.concat(r, F.lit(")"))).alias("inner_text"), X.title_case(r).alias("title"), X.label_norm(r).alias("label"))


@query("normalise_texts", f"""
SELECT doc_id, md5({SQL_CLEAN}) AS clean, md5({sql_key('text')}) AS key,
 md5(trim(regexp_replace(regexp_replace(lower(text), '[’''`]', '', 'g'), '[^a-z0-9%]+', ' ', 'g'))) AS claim FROM documents""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_text(t)).alias("clean"), F.md5(X.match_key(t)).alias("key"), F.md5(X.claim_text(t)).alias("claim"))


TERM = {"ECONOMY": "SKIN CONDITIONING - EMOLLIENT", "SMALL": "HUMECTANT", "MEDIUM": "SURFACTANT - EMULSIFYING", "PROMO": "PERFUMING", "STANDARD": "SOLVENT", "LARGE": "ANTIOXIDANT"}
ROLE = {"ECONOMY": "soften", "SMALL": "moisture", "MEDIUM": "texture", "PROMO": "scent", "STANDARD": "base", "LARGE": "keep"}


def term_col(c="p_type"):
    return F.create_map(*[F.lit(x) for kv in TERM.items() for x in kv])[F.col(c)]


def sql_case(m: dict, c: str = "p_type") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query("role_table", f"""
WITH t AS (SELECT p_partkey, {sql_case(TERM)} AS fn, {sql_case(ROLE)} AS family FROM part)
SELECT p_partkey, fn AS "function", upper(substr(replace(lower(fn), ' - ', ', '), 1, 1)) || substr(replace(lower(fn), ' - ', ', '), 2) AS pretty, family,
 CASE fn WHEN 'SKIN CONDITIONING - EMOLLIENT' THEN 'softens' WHEN 'HUMECTANT' THEN 'holds water' ELSE {sql_case(X.ROLE_BLURB, 'family').replace("skin's", "skin''s")} END AS plain FROM t""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", term_col().alias("function"))
    g = p.select(F.when(F.col("function") == "HUMECTANT", "humectant").otherwise("emollient").alias("function")).distinct().withColumn("en", F.when(F.col("function") == "humectant", "holds water").otherwise("softens"))
    return p.join(rules.plain_function(p, g), "function")


@query("review_table", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'accepted' WHEN o_orderkey % 11 = 0 THEN 'kept'
  WHEN o_orderstatus = 'F' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'class' WHEN '2' THEN 'pubchem' WHEN '3' THEN 'synonym' ELSE 'inci' END
  WHEN o_orderstatus = 'O' THEN 'suggested' WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'ambiguous' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'unavailable' ELSE 'not_found' END AS bucket,
 CASE WHEN o_orderkey % 7 = 0 THEN 'A' || o_orderkey WHEN o_orderstatus = 'F' THEN 'N' || o_custkey END AS identity,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'differs by 1 edit (look-alike glyphs)' ELSE 'differs by 2 edits (missing characters, extra characters)' END AS why,
 (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'F') AS review FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    c1 = F.substring("o_orderpriority", 1, 1)
    st = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "suggested").when(c1.isin("1", "2"), "ambiguous").when(c1 == "3", "lookup_unavailable").otherwise("not_found")
    layer = F.when(c1 == "1", "category_recognized").when(c1 == "2", "pubchem_match").when(c1 == "3", "inci_alias").otherwise("inci_exact")
    k = F.col("o_orderkey")
    items = o.select(k.alias("label_id"), F.lit(0).alias("idx"), F.col("o_orderkey").cast("string").alias("raw"), st.alias("status"), layer.alias("layer"), (k % 5 == 0).alias("optional"), (k % 11 == 0).alias("kept"),
                     F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("inci_name"),
                     F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("C→Q (look-alike glyphs)"))).otherwise(F.array(F.lit("'I' missing"), F.lit("extra 'L'"))).alias("edits"))
    ch = o.where("o_orderkey % 7 = 0").select(k.alias("label_id"), k.cast("string").alias("key"), F.lit("accept").alias("action"), F.concat(F.lit("A"), k.cast("string")).alias("value"))
    i = review.identities(items, ch)
    return i.select(F.col("label_id").alias("o_orderkey"), review.bucket_of(F.col("status"), F.col("layer"), F.col("via") == "accepted", F.col("kept")).alias("bucket"), F.col("inci").alias("identity"),
                    review.explain_candidate(F.col("edits")).alias("why"), review.needs_review(F.col("status"), F.col("optional"), F.col("via") != "none").alias("review"))


# ---- generators

SPLIT_SQL = """ch AS (SELECT doc_id, i, c, sum(CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN -1 ELSE 0 END) OVER w AS s FROM
  (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM base) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM ch),
 ct AS (SELECT *, c IN (',', ';') AND depth = 0 AS cut, sum(CASE WHEN c IN (',', ';') AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM dp),
 pc AS (SELECT doc_id, piece, coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT cut), '') AS p FROM ct GROUP BY doc_id, piece)"""


@query("g1_split_top_level", f"""
WITH base AS (SELECT doc_id, text AS t FROM documents), {SPLIT_SQL}
SELECT doc_id, count(*) AS n_pieces, md5(string_agg(p, '|' ORDER BY piece)) AS pieces FROM pc GROUP BY doc_id""")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", S.split_top_level(F.col("text")).alias("p"))
    return s.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "|")).alias("pieces"))


@query("g2_segment_documents", f"""
WITH base AS (SELECT doc_id, regexp_replace({SQL_CLEAN}, '(?i)^\\s*(?:ingredients?|ingredientes|inci)\\s*(?:\\(inci\\))?\\s*[:\\-]?\\s*', '') AS t FROM documents), {SPLIT_SQL},
 ex AS (SELECT doc_id, piece, unnest(x) AS p, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, piece, CASE WHEN regexp_matches(trim(p), '(?i)^(?:MRP|M\\.R\\.P|B\\.?\\s?NO|BATCH|LOT|MFG|MFD|EXP|USE BEFORE|BEST BEFORE|PAO)\\b') THEN [p] ELSE string_split(regexp_replace(p, '\\.\\s+([A-Z+])', chr(1) || '\\1', 'g'), chr(1)) END AS x FROM pc)),
 tr AS (SELECT doc_id, piece, k, regexp_replace(regexp_replace(p, '^\\s*\\.*\\s*', ''), '\\s*\\.*\\s*$', '') AS p FROM ex),
 st AS (SELECT doc_id, piece, k, CASE WHEN regexp_matches(p, '\\s*\\*{{1,3}}\\s*$') THEN trim(regexp_replace(p, '\\s*\\*{{1,3}}\\s*$', '')) ELSE p END AS p FROM
  (SELECT doc_id, piece, k, CASE WHEN regexp_matches(p, '\\s*[-–:]?\\s*(\\d+(?:\\.\\d+)?)\\s*%\\s*\\**\\s*$') THEN trim(regexp_replace(p, '\\s*[-–:]?\\s*(\\d+(?:\\.\\d+)?)\\s*%\\s*\\**\\s*$', '')) ELSE p END AS p FROM tr WHERE p <> ''))
SELECT doc_id, count(*) AS n_segments, md5(string_agg(p, '|' ORDER BY piece, k)) AS segments FROM st GROUP BY doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("label_id"), F.lit(0).alias("source_index"), F.col("text").alias("raw"))
    s = S.segment_labels(docs, one_source=True).groupBy("label_id").agg(F.count("*").alias("n_segments"), F.array_sort(F.collect_list(F.struct("position", "raw"))).alias("s"))
    return s.select(F.col("label_id").alias("doc_id"), "n_segments", F.md5(F.array_join("s.raw", "|")).alias("segments"))


PIECE = {0: ("p_name", ""), 1: ("p_name || ' (nano)'", "nano")}


@query("g3_g4_segment_labels", f"""
WITH {LI}, b AS (SELECT l_orderkey AS label_id, idx, l_partkey % 7 AS v, p_name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS q FROM li)
SELECT label_id, CAST(idx AS INT) AS position, CASE v WHEN 1 THEN p_name || ' (nano)' ELSE p_name END AS raw, coalesce(bool_or(v = 4) OVER (PARTITION BY label_id ORDER BY idx), false) AS optional,
 CASE v WHEN 1 THEN 'nano' WHEN 2 THEN 'label_percent=' || q WHEN 3 THEN 'marker=*' ELSE '' END AS tags FROM b""")
def _(spark, d):
    v = F.col("l_partkey") % 7
    q = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))
    piece = (F.when(v == 1, F.concat("p_name", F.lit(" (nano)"))).when(v == 2, F.concat("p_name", F.lit(" - "), q, F.lit("%**"))).when(v == 3, F.concat("p_name", F.lit("***")))
             .when(v == 4, F.concat(F.lit("May contain: "), "p_name")).otherwise(F.col("p_name")))
    # blends and sentence ends separate as commas do
    sep = F.when(v == 5, " (and) ").when(v == 6, "; ").otherwise(", ")
    g = lines(spark, d).select("l_orderkey", "idx", F.concat(piece, sep).alias("t")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("m"))
    lab = g.select(F.col("l_orderkey").alias("label_id"), F.lit(0).alias("source_index"), F.concat(F.lit("Ingredients: "), F.array_join(F.col("m.t"), "")).alias("raw"))
    return S.segment_labels(lab).select("label_id", "position", "raw", "optional", F.array_join("tags", ",").alias("tags"))


@query("g6_reference_names", r"""
WITH p AS (SELECT doc_id, unnest(x) AS n, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\([^)]*\)', ' ', 'g'), '[,;.]\s*') AS x FROM documents)),
 q AS (SELECT doc_id, k, regexp_replace(regexp_replace(n, '(?i)^\s*(ingredients?\s*[:\-]\s*)', ''), '^\s+|\s+$', '', 'g') AS n FROM p)
SELECT doc_id, count(*) AS n_names, md5(string_agg(n, '|' ORDER BY k)) AS names FROM q WHERE length(n) > 1 GROUP BY doc_id""")
def _(spark, d):
    r = table(spark, d, "documents").select("doc_id", S.reference_names(F.col("text")).alias("n")).where("size(n) > 0")
    return r.select("doc_id", F.size("n").alias("n_names"), F.md5(F.array_join("n", "|")).alias("names"))


@query("g7_vitamin_codes", """
SELECT c_custkey, v.ord, v.code, v.pro FROM customer, LATERAL (SELECT * FROM (VALUES (0, 0, 'E', false), (0, 1, 'B' || (c_custkey % 10), false), (0, 2, 'B5', true), (1, 0, 'C', true), (2, 0, 'A', false), (2, 1, 'D3', false)) t(m, ord, code, pro) WHERE m = c_custkey % 3) v""")
def _(spark, d):
    k = F.col("c_custkey")
    text = (F.when(k % 3 == 0, F.concat("c_name", F.lit(" with Vitamin E & B"), (k % 10).cast("string"), F.lit(" And Pro-vitamin B5 for all")))
            .when(k % 3 == 1, F.concat(F.lit("pro-vitamin c, "), "c_name")).otherwise(F.concat(F.lit("our vitamins A + d3. "), "c_name")))
    r = table(spark, d, "customer").select("c_custkey", F.posexplode(S.vitamin_codes(text)).alias("ord", "v"))
    return r.select("c_custkey", "ord", "v.code", "v.pro")


def gram_counts(spark, d):
    # the texts are dealt out by document: a document's windows are put in order where it is, the first of each text counts the document,
    # and only the counts of a gram are shuffled
    docs = dealt(table(spark, d, "documents"), "doc_id", always=True).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    grams = F.transform("texts", lambda t: S.window_texts(F.filter(F.split(t, r"\s+"), lambda x: x != ""), 2, 3))
    new = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("gram"), ((i == 0) | (F.get(g, F.greatest(i - 1, F.lit(0))) != x)).alias("new")))
    x = docs.select("doc_id", F.explode(X.let(F.sort_array(F.flatten(grams)), new)).alias("w"))
    return x.groupBy(F.col("w.gram").alias("gram")).agg(F.count("*").alias("n_windows"), F.count_if(F.col("w.new") & F.col("doc_id").isNotNull()).alias("n_docs"))


@query("g8_word_windows", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
 n AS (SELECT doc_id, k AS n, unnest(range(0, CAST(len(ws) AS BIGINT) - k + 1)) AS i, ws FROM w, (VALUES (2), (3)) t(k)),
 x AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS t FROM n)
SELECT t AS gram, count(*) AS n_windows, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY t""")
def _(spark, d):
    return gram_counts(spark, d)


# ---- filters and classifiers

# RE2 word boundaries are ASCII; accented letters are made plain letters first so that both engines see the same words
FOLD = "regexp_replace(ln, '[À-ı]', 'x', 'g')"


@query("f1_f2_f3_line_filters", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
 c AS (SELECT doc_id, line_no, CASE {' '.join(f"WHEN regexp_matches({FOLD}, '{rx}') THEN '{k}'" for k, _r, rx in X.NON_INGREDIENT)} END AS kind,
  len(list_filter(regexp_split_to_array(ln, '\\s+'), lambda x: x <> '')) > 9 OR length(ln) > 90 AS is_long,
  len(regexp_extract_all(upper(ln), '[A-Za-z]+')) >= 4 AND len(list_filter(regexp_extract_all(upper(ln), '[A-Za-z]+'), lambda x: x IN ({', '.join(f"'{w}'" for w in X.MARKETING_WORDS)}))) >= 2 AS is_copy FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_long) AS n_long, count(*) FILTER (is_copy) AS n_copy, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _r, _x in X.NON_INGREDIENT)} FROM c GROUP BY doc_id""")
def _(spark, d):
    l = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("ln"))
    c = l.select("doc_id", X.non_ingredient_kind(F.col("ln")).alias("kind"), X.is_long_text(F.col("ln")).alias("is_long"), X.is_marketing_copy(F.col("ln")).alias("is_copy"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_long").alias("n_long"), F.count_if("is_copy").alias("n_copy"),
                                   *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, _r, _x in X.NON_INGREDIENT])


@query("f1_split_non_ingredients", f"""
WITH {LI}
SELECT l_orderkey AS label_id, idx, CASE l_partkey % 6 WHEN 0 THEN 'price' WHEN 1 THEN 'batch code' WHEN 2 THEN 'date' WHEN 3 THEN 'product/packaging code' WHEN 4 THEN 'directions' END AS reason FROM li WHERE l_partkey % 6 < 5""")
def _(spark, d):
    k = F.col("l_partkey") % 6
    t = (F.when(k == 0, F.concat(F.lit("MRP Rs. "), F.col("l_extendedprice").cast("string"))).when(k == 1, F.concat(F.lit("B.NO. X"), F.col("l_partkey").cast("string"), F.lit("99"))).when(k == 2, F.concat(F.lit("EXP "), F.date_format("l_shipdate", "MM/yy")))
         .when(k == 3, F.concat(F.lit("FIL"), F.lpad(F.col("l_partkey").cast("string"), 7, "1"))).when(k == 4, F.concat(F.lit("apply on "), "p_name")).otherwise(F.col("p_name")))
    s = lines(spark, d).select(F.col("l_orderkey").alias("label_id"), "idx", t.alias("raw"))
    known = s.where("false").select("raw", F.lit("inci_exact").alias("layer"))
    r = split_non_ingredients(s, known).where("kind IS NOT NULL")
    return r.select("label_id", "idx", X.removal_reason(F.col("kind")).alias("reason"))


@query("f4_classify_category", """
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'colorant' WHEN 1 THEN 'polymer' WHEN 2 THEN 'fragrance' WHEN 3 THEN 'botanical' WHEN 4 THEN CASE WHEN length(split_part(p_name, ' ', 1)) >= 3 AND length(split_part(p_name, ' ', 2)) >= 3 THEN 'botanical' END WHEN 5 THEN 'colorant' END AS category FROM part""")
def _(spark, d):
    k = F.col("p_size") % 7
    t = (F.when(k == 0, F.concat(F.lit("CI 7"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).when(k == 1, F.concat("p_name", F.lit("/x crosspolymer"))).when(k == 2, F.lit("Parfum (Fragrance)"))
         .when(k == 3, F.concat("p_name", F.lit(" (Curcuma longa)"))).when(k == 4, F.concat("p_name", F.lit(" seed leaf extract."))).when(k == 5, F.lit("FD&C Red No. 40 Lake")).otherwise(F.concat(F.lit("x "), "p_name")))
    return table(spark, d, "part").select("p_partkey", X.classify_category(t).alias("category"))


@query("f8_photo_quality_triage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity * 2 < 40 THEN 'blur,' ELSE '' END || CASE WHEN l_discount * 6 > 0.10 AND l_discount * 6 < 0.5 AND l_partkey % 256 < 250 THEN 'glare,' ELSE '' END ||
 CASE WHEN l_suppkey * 10 < 300 OR (l_linenumber > 0 AND l_linenumber < 8 AND l_linenumber % 3 = 0) THEN 'small,' ELSE '' END AS prompts FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    h = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber")).otherwise(0)
    p = ocr.photo_prompts(F.col("l_quantity") * 2, F.col("l_discount") * 6, F.col("l_partkey") % 256, F.col("l_suppkey") * 10, h)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform(p, lambda x: F.concat(x, F.lit(","))), "").alias("prompts"))


WORDS_SQL = r"""ws AS (SELECT doc_id, line, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS word_no FROM (SELECT doc_id, line, list_filter(regexp_split_to_array(ln, '\s+'), lambda x: x <> '') AS w FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))),
 words AS (SELECT doc_id, line, word_no, text, CAST(40 + (doc_id * 31 + line * 7 + word_no * 13) % 60 AS DOUBLE) AS confidence, CAST((word_no * 7 + doc_id + line) % 23 AS BIGINT) AS height FROM ws)"""


def document_words(spark, d):
    """Words of every document line with a synthetic reading confidence and height."""
    ln = dealt(table(spark, d, "documents"), "doc_id", always=True).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "ln"))
    w = ln.select("doc_id", "line", F.posexplode(F.filter(F.split("ln", r"\s+"), lambda x: x != "")).alias("word_no", "text"))
    return w.select("doc_id", "line", "word_no", "text", (40 + (F.col("doc_id") * 31 + F.col("line") * 7 + F.col("word_no") * 13) % 60).cast("double").alias("confidence"),
                    ((F.col("word_no") * 7 + F.col("doc_id") + F.col("line")) % 23).cast("long").alias("height"))


@query("f9_ocr_readability", f"""
WITH {WORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY height) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM words WHERE regexp_matches(text, '[A-Za-z]{{3,}}')),
 m AS (SELECT doc_id, height FROM r WHERE i = n // 2),
 a AS (SELECT doc_id, count(*) FILTER (regexp_matches(text, '[A-Za-z]{{3,}}')) AS n_words, sum(length(text) - length(replace(text, ',', ''))) AS n_commas, avg(confidence) AS c FROM words GROUP BY doc_id)
SELECT a.doc_id, n_words, CAST(n_commas AS BIGINT) AS n_commas, CASE WHEN n_words < 8 THEN 'too_little_text' WHEN n_commas < 4 THEN 'no_list' WHEN c < 60 OR (coalesce(height, 0) > 0 AND height < 9) THEN 'check_words' END AS problem FROM a LEFT JOIN m USING (doc_id)""")
def _(spark, d):
    s = ocr.reading_stats(document_words(spark, d), "doc_id")
    return s.select("doc_id", "n_words", "n_commas", ocr.readability(F.col("n_words"), F.col("n_commas"), F.col("mean_conf"), F.col("median_height")).alias("problem"))


@query("g5_segments_from_words", f"""
WITH {WORDS_SQL}, h AS (SELECT *, lead(line) OVER w IS NOT NULL AND lead(line) OVER w <> line AND regexp_matches(text, '[A-Za-z]-$') AS h, lead(text) OVER w AS nt FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY line, word_no)),
 t AS (SELECT doc_id, line, word_no, confidence, CASE WHEN coalesce(lag(h) OVER w, false) THEN '' WHEN h THEN substr(text, 1, length(text) - 1) || nt ELSE text END AS t FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line, word_no)),
 c AS (SELECT doc_id, line, word_no, confidence, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM t WHERE t <> ''),
 s AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line, word_no, i) AS s FROM c),
 dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line, word_no, i)) AS depth FROM s),
 ct AS (SELECT *, c IN (',', ';') AND depth = 0 AS cut, sum(CASE WHEN c IN (',', ';') AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line, word_no, i) AS seg FROM dp),
 w AS (SELECT doc_id, seg, line, word_no, string_agg(c, '' ORDER BY i) AS text, max(confidence) AS confidence FROM ct WHERE NOT cut GROUP BY ALL),
 f AS (SELECT *, min(seg) OVER (PARTITION BY doc_id) AS fs, row_number() OVER (PARTITION BY doc_id, seg ORDER BY line, word_no) - 1 AS wi FROM w),
 l AS (SELECT *, min(wi) FILTER (seg = fs AND wi <= 4 AND regexp_matches(text, '(?i)^ingredients?:?$')) OVER (PARTITION BY doc_id, seg) AS la FROM f),
 g AS (SELECT doc_id, seg, string_agg(text, ' ' ORDER BY wi) AS text, avg(confidence) AS conf FROM l WHERE la IS NULL OR wi > la GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS seg_no, text, round(conf, 4) AS conf FROM g WHERE trim(text) <> ''""")
def _(spark, d):
    s = ocr.segments_from_words(document_words(spark, d), ["doc_id"])
    return s.select("doc_id", "seg_no", "text", F.round("conf", 4).alias("conf"))


# ---- pack facts

@query("extract_pack_facts", f"""
WITH {LI}, b AS (SELECT l_orderkey, idx, l_partkey, CAST(l_shipdate AS DATE) AS dt, (l_orderkey + idx) % 6 AS v, round(l_extendedprice, 2) AS price, CAST(l_quantity AS INT) AS q FROM li),
 f AS (SELECT *, v = 4 AND day(dt) > 12 AS swapped FROM b),
 x AS (SELECT *, CASE WHEN v IN (0, 3) THEN day(dt) WHEN v = 4 THEN CASE WHEN swapped THEN day(dt) ELSE month(dt) END END AS d, CASE WHEN v = 5 THEN NULL WHEN v = 4 AND NOT swapped THEN day(dt) ELSE month(dt) END AS m, CASE WHEN v = 5 THEN NULL ELSE CASE WHEN v IN (1, 3) OR swapped THEN 2000 + year(dt) % 100 ELSE year(dt) END END AS y,
   CASE v WHEN 0 THEN 'DD/MM/YYYY' WHEN 1 THEN 'MM/YY' WHEN 2 THEN 'MON YYYY' WHEN 3 THEN 'DD/MM/YY' WHEN 4 THEN CASE WHEN swapped THEN 'DD/MM/YY' ELSE 'DD/MM/YYYY' END END AS fmt FROM f),
 z AS (SELECT *, CASE WHEN d IS NOT NULL THEN make_date(y, m, 1) + CAST(d - 1 AS INT) WHEN m IS NOT NULL THEN last_day(make_date(y, m, 1)) END AS until FROM x)
SELECT l_orderkey, idx, CASE WHEN v = 5 THEN NULL WHEN v IN (0, 3) THEN 'mfg' ELSE 'expiry' END AS kind, d AS day, m AS month, y AS year, fmt AS format, CASE WHEN v <> 5 THEN swapped OR v = 2 END AS needs_confirm,
 CASE WHEN v IN (1, 4) AND NOT swapped THEN until < DATE '1998-06-15' END AS passed, CASE WHEN q IN (3, 6, 9, 12, 18, 24, 30, 36) THEN q END AS pao,
 CASE WHEN q IN (3, 6, 9, 12, 18, 24, 30, 36) THEN CAST(date_trunc('month', dt) + to_months(q) AS DATE) + CAST(day(dt) - 1 AS INT) END AS use_by, price AS mrp, CAST(q AS DOUBLE) AS volume_ml, round(price / q, 6) AS per_unit FROM z""")
def _(spark, d):
    li = lines(spark, d)
    v, dt = (F.col("l_orderkey") + F.col("idx")) % 6, F.col("l_shipdate").cast("date")
    line = (F.when(v == 0, F.concat(F.lit("MFG DATE: "), F.date_format(dt, "dd/MM/yyyy"))).when(v == 1, F.concat(F.lit("Use before "), F.date_format(dt, "MM/yy")))
            .when(v == 2, F.concat(F.lit("EXP "), F.date_format(dt, "MMM yyyy"), F.lit(" (smudged)"))).when(v == 3, F.concat(F.lit("Mfd. "), F.date_format(dt, "dd-MM-yy")))
            .when(v == 4, F.concat(F.lit("best before: "), F.date_format(dt, "MM.dd."), F.when(F.day(dt) > 12, F.date_format(dt, "yy")).otherwise(F.date_format(dt, "yyyy")))).otherwise(F.concat(F.lit("made on "), F.date_format(dt, "dd/MM/yyyy"))))
    q = F.col("l_quantity").cast("int")
    price = F.concat(F.lit("MRP Rs. "), F.format_string("%,.2f", F.round("l_extendedprice", 2)), F.lit(", "), q.cast("string"), F.lit(" ml"))
    t = li.select("l_orderkey", "idx", dt.alias("opened"), line.alias("line"), price.alias("price"), F.concat(F.lit("PAO "), q.cast("string"), F.lit("M")).alias("pao_text"))
    t = t.withColumn("f", P.date_in_line(F.col("line"), F.lit(False), F.lit(False))).withColumn("p", P.parse_price(F.col("price"))).withColumn("pao", P.pao_months(F.col("pao_text")))
    f = F.col("f")
    return t.select("l_orderkey", "idx", f["kind"].alias("kind"), f["day"].alias("day"), f["month"].alias("month"), f["year"].alias("year"), f["format"].alias("format"), f["needs_confirm"].alias("needs_confirm"),
                    P.date_passed(f["kind"], f["day"], f["month"], f["year"], f["needs_confirm"], F.lit("1998-06-15").cast("date")).alias("passed"), "pao",
                    P.add_months_overflow(F.col("opened"), F.col("pao")).alias("use_by"), F.col("p.mrp").alias("mrp"), F.col("p.volume_ml").alias("volume_ml"), F.round(P.price_per_unit(F.col("p.mrp"), F.col("p.volume_ml")), 6).alias("per_unit"))


@query("d7_confirmed_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE month(o_orderdate) END AS month, CASE WHEN o_orderkey % 4 = 0 THEN 2030 ELSE year(o_orderdate) END AS year, o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 AS needs_confirm FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 3 == 0).alias("nc"))
    fix = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(1).alias("fm"), F.lit(2030).alias("fy"))
    return P.confirmed_date(o, fix, "o_orderkey")
