"""Queries for scans, sources and sinks."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curate, dictionary as D
from ..operators.products import reference_lookup, user_report
from ..operators.resolve import resolve_labels
from ..runtime import checkpoint_folder
from ..sources.store import forget_users, tolerant_products, upsert
from ..sources.tables import parse_seed_lines
from .match_queries import benchmark_phrases
from .registry import LI, lines, order_labels, part_dictionary, part_names, query, sql_key, table


@query("s1_read_seed_names", """
SELECT n AS inci_name, alias, kind FROM (SELECT DISTINCT upper(p_name) AS n FROM part),
 LATERAL (VALUES (n || ' X', 'common_name'), ('A:' || n, 'trade_name')) v(alias, kind)""")
def _(spark, d):
    n = part_names(spark, d)
    body = n.select(F.concat("inci_name", F.lit("||"), "inci_name", F.lit(" X:common_name;A:"), "inci_name", F.lit(":trade_name")).alias("value"))
    notes = n.select(F.concat(F.lit("# "), "inci_name").alias("value"))
    return parse_seed_lines(body.unionByName(notes))[1].drop("ord")


@query("s2_read_catalogue", "SELECT trim(p_name) AS inci_name, CAST(p_partkey AS VARCHAR) AS cas, p_type AS functions FROM part WHERE trim(p_name) <> ''")
def _(spark, d):
    return D.map_catalogue_columns(table(spark, d, "part").select(F.col("p_name").alias("INCI Name"), F.col("p_partkey").alias("CAS No."), F.col("p_type").alias("Function"), F.col("p_brand").alias("Brand")))


@query("s3_merge_catalogues", f"""
WITH o AS (SELECT n, ref FROM (SELECT upper(p_name) AS n, CAST(p_partkey AS VARCHAR) AS ref, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey) rn FROM part WHERE p_size % 2 = 0 AND p_name NOT LIKE 'red%') WHERE rn = 1),
 s AS (SELECT upper(p_name) AS n, min(p_type) AS cat FROM part WHERE p_name NOT LIKE 'hot%' GROUP BY 1)
SELECT coalesce(o.n, s.n) AS inci_name, ref AS cosing_ref, cat AS category, CASE WHEN o.n IS NULL THEN '{D.SEED_ONLY}' END AS description FROM o FULL JOIN s ON o.n = s.n""")
def _(spark, d):
    p = table(spark, d, "part")
    o = p.where("p_size % 2 = 0 AND NOT startswith(p_name, 'red')").select(F.col("p_name").alias("inci_name"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("cosing_ref"))
    s = p.where("NOT startswith(p_name, 'hot')").groupBy(F.col("p_name").alias("inci_name")).agg(F.min("p_type").alias("category")).withColumn("aliases", F.lit(None).cast("string"))
    return D.merge_catalogues(o, s).drop("aliases")


@query("s4_build_dictionary", f"""
SELECT n AS inci_name, {sql_key('n')} AS key, t AS category FROM (SELECT upper(trim(p_name)) AS n, p_type AS t, row_number() OVER (PARTITION BY upper(trim(p_name)) ORDER BY p_partkey) rn FROM part) WHERE rn = 1""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("inci_name"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"))
    empty = rows.select("inci_name", F.col("category").alias("alias"), F.col("category").alias("kind")).where("false")
    return D.build_dictionary(rows, empty, {"dictionarySource": "parts"}).names.select("inci_name", "key", "category")


@query("s5_extract_html_rows", r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1)) AS u, generate_subscripts(regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1), 1) - 1 AS table_no FROM pages),
 r AS (SELECT page_id, table_no, unnest(regexp_extract_all(u, '(?s)<li[^>]*>(.*?)</li>', 1)) AS r, generate_subscripts(regexp_extract_all(u, '(?s)<li[^>]*>(.*?)</li>', 1), 1) - 1 AS row_no FROM t)
SELECT page_id, table_no, row_no, array_to_string(list_transform(regexp_extract_all(r, '(?s)<a[^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), '|') AS cells FROM r""")
def _(spark, d):
    rows = curate.extract_html_rows(table(spark, d, "pages"), "page_id", "html", "ul", "li", "a")
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("s6_extract_annex_entries", """
SELECT CAST(l_orderkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE '' END AS entry, 'III' AS annex, p_name AS cell, 'C' || l_partkey AS cas,
 CASE WHEN l_returnflag = 'A' THEN '' ELSE 'max ' || l_linenumber || ' | ' END || 'type ' || p_type AS conditions
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 3""")
def _(spark, d):
    li = lines(spark, d)
    ref = F.when(F.col("l_linenumber") == 3, "Reference number").otherwise(F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("")))
    extra = F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("max "), F.col("l_linenumber").cast("string")))
    cells = F.array(ref, F.lit("x"), F.col("p_name"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")), F.lit("ec"), extra, F.concat(F.lit("type "), "p_type"))
    html = li.select("l_orderkey", F.concat(F.lit("<table><tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr></table>")).alias("h"))
    return curate.annex_rows(curate.extract_html_rows(html, "l_orderkey", "h", gap=" "), "III").drop("full_cell")


@query("s6_prohibited_entries", f"""
WITH n AS (SELECT p_partkey, upper(p_name) AS a, {sql_key('p_name')} AS k FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS entry, CASE WHEN length(k) >= 8 THEN 'X-' || p_partkey || '|' || a ELSE 'X-' || p_partkey END AS names FROM n""")
def _(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    cells = F.array(key, F.concat("p_name", F.lit("; (INCI: x-"), key, F.lit(")")))
    r = curate.prohibited_rows(p.select(cells.alias("cells")), part_names(spark, d).select(F.col("inci_name").alias("name")))
    return r.select("entry", F.array_join("inci", "|").alias("names"))


@query("s7_longest_span_names")
def _(spark, d):
    # every word and every two- and three-word window of the benchmark texts is looked for in every document
    names = benchmark_phrases(spark, d, (1, 2, 3)).select("phrase").distinct()
    r = curate.longest_span_names(table(spark, d, "documents"), names, "doc_id", "text")
    return r.select("doc_id", F.array_join("names", "|").alias("names"))


@query("s8_build_families", """
WITH a AS (SELECT CASE p_size % 3 WHEN 0 THEN 'III' WHEN 1 THEN 'V' ELSE 'II_prohibited_identified' END AS annex, CAST(p_partkey AS VARCHAR) AS entry,
  upper(p_name) || CASE WHEN p_size % 5 = 0 THEN 'PARABEN' ELSE '' END AS inci, CASE WHEN p_size % 2 = 0 THEN 'the presence of the substance must be indicated' ELSE 'none' END AS cond FROM part),
 f AS (SELECT 'eu_fragrance_allergens' AS family_id, inci FROM a WHERE annex = 'III' AND regexp_matches(cond, 'presence of the substance( or substances)? (shall|must) be indicated')
  UNION SELECT 'preservatives_annex_v', inci FROM a WHERE annex = 'V' UNION SELECT 'parabens', inci FROM a WHERE annex = 'II_prohibited_identified' AND inci LIKE '%PARABEN'
  UNION ALL SELECT 'types', p_type FROM part GROUP BY p_type)
SELECT family_id, inci, CASE WHEN family_id = 'eu_fragrance_allergens' AND inci LIKE 'RED%' THEN 'caution' END AS cap_tier FROM f""")
def _(spark, d):
    p = table(spark, d, "part")
    annex = F.when(F.col("p_size") % 3 == 0, "III").when(F.col("p_size") % 3 == 1, "V").otherwise("II_prohibited_identified")
    name = F.concat(F.upper("p_name"), F.when(F.col("p_size") % 5 == 0, "PARABEN").otherwise(""))
    a = p.select(annex.alias("annex"), F.col("p_partkey").cast("string").alias("entry"), F.array(name).alias("inci"), F.when(F.col("p_size") % 2 == 0, "the presence of the substance must be indicated").otherwise("none").alias("conditions"))
    cur = p.select(F.lit("types").alias("family_id"), F.col("p_type").alias("inci"), F.array().cast("array<string>").alias("aliases")).distinct()
    caps = a.select(F.explode("inci").alias("inci")).distinct().where("startswith(inci, 'RED')").select("inci", F.lit("caution").alias("cap_tier"), F.lit("note").alias("role_note"))
    return curate.build_families(a, cur, caps).select("family_id", "inci", "cap_tier")


@query("s9_build_functions", """
WITH e AS (SELECT event_id AS ord, 'U' || user_id AS inci, event_type, value FROM events),
 ok AS (SELECT *, row_number() OVER (PARTITION BY inci ORDER BY ord) rn FROM e WHERE event_type NOT IN ('error', 'signup'))
SELECT inci, CASE event_type WHEN 'click' THEN 'PERFUMING|SOLVENT' WHEN 'view' THEN 'BUFFERING' ELSE 'HUMECTANT' END AS functions FROM ok WHERE rn = 1""")
def _(spark, d):
    t = F.col("event_type")
    fns = F.when(t == "click", F.array(F.lit("fragrance"), F.lit(" Perfuming"), F.lit("solvent"))).when(t == "view", F.array(F.lit("pH adjuster"), F.lit("Fragrance excipient"))).otherwise(F.array(F.lit("humectant")))
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("inci"), fns.alias("functions"),
                                         F.when(t == "error", "unverified").otherwise("official").alias("kind"), F.when(t == "signup", "http://x").otherwise("https://x").alias("url"))
    return curate.build_functions(e)[0].select("inci", F.array_join("functions", "|").alias("functions"))


@query("s12_upsert_products", """
WITH a AS (SELECT o_custkey AS user_id, o_orderkey % 4 AS product_id, o_orderkey AS v FROM orders)
SELECT user_id, product_id, max(v) AS saved FROM a GROUP BY ALL""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 4).alias("product_id"), F.col("o_orderkey").alias("saved"))
    return upsert(o.where("saved % 2 = 0"), o.where("saved % 2 = 1"), ["user_id", "product_id"], "saved")


@query("s12_load_collections", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n_ingredients FROM customer")
def _(spark, d):
    ing = F.when(F.col("c_custkey") % 3 != 0, F.array("c_name"))
    t = tolerant_products(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), ing.alias("ingredients"), F.lit(None).cast("array<string>").alias("unresolved")))
    return t.select("user_id", F.size("ingredients").alias("n_ingredients"))


@query("s13_forget_user", "SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return forget_users(e, e.where("event_type = 'error' AND value > 40")).drop("value")


@query("s14_reference_lookup", """
WITH p AS (SELECT 'P-' || p_partkey AS code, p_name AS name FROM part),
 q AS (SELECT 'b' || s_suppkey AS query_id, CAST(s_suppkey AS VARCHAR) AS d, '' AS q FROM supplier UNION ALL SELECT DISTINCT 'n' || p_name, '', p_name FROM part),
 h AS (SELECT query_id, code, name FROM q JOIN p ON d <> '' AND regexp_replace(code, '\\D', '', 'g') = d UNION ALL SELECT query_id, code, name FROM q JOIN p ON d = '' AND contains(p.name, q.q))
SELECT query_id, rank, code, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY code) AS rank FROM h) WHERE rank <= 6""")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brands"), F.lit(None).cast("string").alias("ingredients_text"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("query_id"), F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("barcode"), F.lit("").alias("q"))
    n = table(spark, d, "part").select(F.concat(F.lit("n"), "p_name").alias("query_id"), F.lit("").alias("barcode"), F.col("p_name").alias("q")).distinct()
    return reference_lookup(b.unionByName(n), p).select("query_id", "rank", "code", "name")


@query("s15_write_resolution")
def _(spark, d):
    from ..sources.store import write_resolution
    r = resolve_labels(order_labels(spark, d), part_dictionary(spark, d), one_source=True)
    out = f"{checkpoint_folder(spark)}/resolution-{uuid.uuid4().hex}"
    write_resolution(r, out, {"dictionaryVersion": "1"})
    return spark.read.parquet(f"{out}/items").groupBy("status", "layer").agg(F.count("*").alias("n"))


@query("s16_quality_gate", "SELECT count(*) AS n_names, true AS ok FROM (SELECT DISTINCT upper(p_name) FROM part)")
def _(spark, d):
    return D.quality_gate(part_names(spark, d), allow_small=True)


GATES = (10, 1_000_000_000)


@query("s16_gated_write", f"""
WITH n AS (SELECT DISTINCT upper(p_name) AS name FROM part), c AS (SELECT count(*) AS n_names, count(*) FILTER (length(name) > 8) AS long FROM n)
SELECT CAST(m AS BIGINT) AS minimum, a AS asserted, n_names, CASE WHEN a THEN long ELSE 0 END AS broken, n_names >= m AND (NOT a OR long = 0) AS ok FROM c, (VALUES {", ".join(f"({g})" for g in GATES)}) t(m), (VALUES (true), (false)) u(a)""")
def _(spark, d):
    n, rows = part_names(spark, d), []
    for minimum in GATES:
        for asserted in (True, False):
            rule = {"broken": F.length("inci_name") <= 8} if asserted else None
            try:
                seen, ok = D.write_gated(n, f"{checkpoint_folder(spark)}/names-{uuid.uuid4().hex}", minimum, rule), True
            except D.GateFailed as e:
                seen, ok = e.metrics, False
            rows.append((minimum, asserted, seen["n_names"], seen.get("broken", 0), ok))
    return spark.createDataFrame(rows, "minimum long, asserted boolean, n_names long, broken long, ok boolean")


@query("s17_user_report", """
WITH p AS (SELECT o_custkey AS user_id, o_orderkey, 'Order ' || o_orderkey AS name, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Morning' WHEN '2' THEN 'Evening' WHEN '3' THEN 'Morning and evening' ELSE 'Time not set' END AS w, o_orderstatus, o_orderdate FROM orders),
 pr AS (SELECT user_id, count(*) AS n_products, string_agg(name || ' - ' || w, '; ' ORDER BY name || ' - ' || w) AS products FROM p WHERE o_orderstatus <> 'P' GROUP BY 1),
 av AS (SELECT c_custkey AS user_id, c_mktsegment || ' · ' || CASE WHEN c_custkey % 2 = 0 THEN 'doctor-confirmed' ELSE 'personal preference' END AS avoid_list FROM customer WHERE c_acctbal > 0),
 re AS (SELECT user_id, string_agg(l, '; ' ORDER BY l) AS reactions FROM (SELECT user_id, CASE WHEN o_orderstatus = 'P' THEN '(removed product)' ELSE name END || ', ' || strftime(o_orderdate, '%Y-%m-%d') AS l FROM p WHERE o_orderkey % 3 = 0 AND user_id % 2 = 0) GROUP BY 1)
SELECT user_id, n_products, products, coalesce(avoid_list, '') AS avoid_list, coalesce(reactions, '') AS reactions, '' AS notes FROM pr LEFT JOIN av USING (user_id) LEFT JOIN re USING (user_id)""")
def _(spark, d):
    o = table(spark, d, "orders")
    c1 = F.substring("o_orderpriority", 1, 1)
    when = F.when(c1 == "1", "am").when(c1 == "2", "pm").when(c1 == "3", "both").otherwise("")
    p = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("product_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), when.alias("when"))
    c = table(spark, d, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2 == 0).alias("consent"))
    avoid = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "doctor").otherwise("preference").alias("strength"))
    re = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("product_id"), F.col("o_orderdate").alias("date"), F.lit(None).cast("string").alias("note"))
    return user_report(users, p, p.where("false").select("user_id", F.col("name").alias("title")), avoid, re)
