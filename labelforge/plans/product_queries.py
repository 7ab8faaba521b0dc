"""Queries over saved products.  An order is a product, its lines the ingredients, its customer the user; a routine is a customer's orders of one year."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import products as P
from ..operators.review import build_products
from .registry import LI, lines, query, sql_key, table
from .rules_queries import OI, order_items

BY = ["user_id", "year"]


def products(spark, d):
    """Orders with at least one line as products; type and time of use come from the order priority."""
    g = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", F.upper("p_name").alias("n")))).alias("m")).select(F.col("l_orderkey").alias("product_id"), F.col("m.n").alias("ingredients"))
    c1 = F.substring("o_orderpriority", 1, 1)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("year"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("name"),
                                         F.when(F.col("o_orderkey") % 5 == 0, "sunscreen").when(F.col("o_orderkey") % 5 == 1, "").otherwise("cream").alias("type"), F.when(c1 == "1", "am").when(c1 == "2", "pm").when(c1 == "3", "both").otherwise("").alias("when"),
                                         F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unresolved"), "o_orderstatus")
    return o.join(g, "product_id")


def class_members(spark, d):
    """Active classes: retinoid, aha and benzoyl by the last word of the part name."""
    w = F.split_part("p_name", F.lit(" "), F.lit(2))
    cls = F.when(w == "ring", "retinoid").when(w == "gear", "aha").when(w == "bolt", "benzoyl")
    return table(spark, d, "part").select(cls.alias("class_id"), F.col("p_name").alias("member")).where("class_id IS NOT NULL").distinct()


def stacking(spark, d):
    c = class_members(spark, d).select("class_id").distinct()
    return c.where("class_id <> 'retinoid'").select(F.concat(F.lit("s-"), "class_id").alias("rule_id"), F.lit("retinoid").alias("a"), F.col("class_id").alias("b"), F.lit("caution").alias("tier"))


PR = f"""{LI}, pr AS (SELECT o_orderkey AS product_id, o_custkey AS user_id, year(o_orderdate) AS year, 'P' || o_orderkey AS name, CASE o_orderkey % 5 WHEN 0 THEN 'sunscreen' WHEN 1 THEN '' ELSE 'cream' END AS type,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'am' WHEN '2' THEN 'pm' WHEN '3' THEN 'both' ELSE '' END AS "when", o_orderkey % 4 = 0 AS unres, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 rt AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, year) AS c FROM pr) WHERE c >= 2),
 act AS (SELECT DISTINCT rt.user_id, rt.year, product_id, name, "when", upper(p_name) AS inci, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'retinoid' WHEN 'gear' THEN 'aha' ELSE 'benzoyl' END AS cls FROM rt JOIN li ON l_orderkey = product_id WHERE split_part(p_name, ' ', 2) IN ('ring', 'gear', 'bolt'))"""


def actives(spark, d):
    p = P.routine_gate(products(spark, d), BY)
    return p, P.product_actives(p, class_members(spark, d), BY)


PAIRS = """pa AS (SELECT product_id AS a_id, lead(product_id) OVER (PARTITION BY user_id ORDER BY product_id) AS b_id, unres AS au, lead(unres) OVER (PARTITION BY user_id ORDER BY product_id) AS bu FROM pr),
 k AS (SELECT l_orderkey AS id, list(DISTINCT upper(p_name)) AS ks, count(*) AS n FROM li GROUP BY 1)"""


def next_pairs(spark, d):
    """Each product with the same user's next one."""
    w = Window.partitionBy("user_id").orderBy("product_id")
    p = products(spark, d).select("user_id", "product_id", "ingredients", F.size("unresolved").alias("u"))
    nx = F.lead(F.struct("product_id", "ingredients", "u")).over(w)
    return p.withColumn("nx", nx).where("nx IS NOT NULL").select(F.col("product_id").alias("a_id"), F.col("nx.product_id").alias("b_id"), F.col("ingredients").alias("a_ingredients"), F.col("nx.ingredients").alias("b_ingredients"), F.col("u").alias("a_unresolved"), F.col("nx.u").alias("b_unresolved"))


@query("a7_u1_compare_products", f"""WITH {PR}, {PAIRS}
SELECT a_id, b_id, len(list_intersect(a.ks, b.ks)) AS n_shared, coalesce(array_to_string(list_sort(list_intersect(a.ks, b.ks)), ','), '') AS shared, len(a.ks) - len(list_intersect(a.ks, b.ks)) AS n_only_a, round(len(list_intersect(a.ks, b.ks)) / (len(a.ks) + len(b.ks) - len(list_intersect(a.ks, b.ks))), 6) AS similarity,
 CASE WHEN (au::INT + bu::INT) / greatest(1, a.n + b.n + au::INT + bu::INT) > 0.25 THEN 'low' ELSE 'ok' END AS reliability FROM pa JOIN k a ON a.id = a_id JOIN k b ON b.id = b_id WHERE b_id IS NOT NULL""")
def _(spark, d):
    c = P.compare_products(next_pairs(spark, d))
    return c.select("a_id", "b_id", "n_shared", F.array_join(F.array_sort("shared"), ",").alias("shared"), F.size("only_a").alias("n_only_a"), F.round("similarity", 6).alias("similarity"), "reliability")


# the candidates of a product are every other product of the user
ALT = """b AS (SELECT pr.product_id, pr.user_id, k.ks FROM pr JOIN k ON k.id = product_id), s AS (SELECT x.product_id AS base_id, y.product_id AS cand_id, len(list_intersect(x.ks, y.ks)) AS c, len(list_intersect(x.ks, y.ks)) / (len(x.ks) + len(y.ks) - len(list_intersect(x.ks, y.ks))) AS sim, y.product_id % 6 = 0 AS bad
 FROM b x JOIN b y ON x.user_id = y.user_id AND y.product_id <> x.product_id)"""


@query("o2_rank_alternatives", f"""WITH {PR}, {PAIRS}, {ALT}
SELECT base_id, rank, cand_id, c AS n_shared, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY sim DESC, cand_id) AS rank FROM s WHERE NOT bad AND c >= 3) WHERE rank <= 5""")
def _(spark, d):
    return saved_alternatives(spark, d)[0].withColumn("similarity", F.round("similarity", 6))


@query("o2_alternative_counts", f"WITH {PR}, {PAIRS}, {ALT} SELECT base_id, count(*) FILTER (bad) AS excluded, count(*) FILTER (NOT bad AND c < 3) AS too_few FROM s GROUP BY 1")
def _(spark, d):
    return saved_alternatives(spark, d)[1]


def saved_alternatives(spark, d):
    p = products(spark, d).select("user_id", "product_id", "ingredients")
    return P.saved_alternatives(p, p.where("product_id % 6 = 0").select(F.col("product_id").alias("cand_id")))


@query("j17_stacking_conflicts", f"""WITH {PR}, p AS (SELECT DISTINCT user_id, year, product_id, "when", cls FROM act)
SELECT a.user_id, a.year, 's-' || b.cls AS rule_id, a.product_id AS a_id, b.product_id AS b_id, (a."when" = '' OR b."when" = '' OR (a."when" IN ('am', 'both') AND b."when" IN ('am', 'both')) OR (a."when" IN ('pm', 'both') AND b."when" IN ('pm', 'both'))) AS overlap,
 CASE WHEN (a."when" = '' OR b."when" = '' OR (a."when" IN ('am', 'both') AND b."when" IN ('am', 'both')) OR (a."when" IN ('pm', 'both') AND b."when" IN ('pm', 'both'))) THEN 'caution' ELSE 'note' END AS tier
FROM p a JOIN p b ON a.user_id = b.user_id AND a.year = b.year AND a.cls = 'retinoid' AND b.cls <> 'retinoid' AND a.product_id <> b.product_id""")
def _(spark, d):
    return P.stacking_conflicts(actives(spark, d)[1], stacking(spark, d), BY)


@query("a8_duplicate_actives", f"""WITH {PR}
SELECT user_id, year, replace(inci, ' ', '') AS what, count(DISTINCT product_id) AS n_products FROM act GROUP BY ALL HAVING count(DISTINCT product_id) > 1 UNION ALL
SELECT user_id, year, cls, count(DISTINCT product_id) FROM act WHERE cls IN ('retinoid', 'aha') GROUP BY ALL HAVING count(DISTINCT product_id) > 1 AND count(DISTINCT inci) > 1""")
def _(spark, d):
    one, fam = P.duplicate_actives(actives(spark, d)[1], BY)
    return one.select(*BY, F.col("key").alias("what"), "n_products").unionByName(fam.select(*BY, F.col("class_id").alias("what"), "n_products"))


@query("a9_sunscreen_check", f"""WITH {PR}, c AS (SELECT user_id, year, CASE WHEN NOT bool_or(type <> '') THEN 'types_not_marked' WHEN bool_or(type = 'sunscreen' AND "when" IN ('am', 'both')) THEN 'present' ELSE 'missing' END AS sunscreen_check FROM rt GROUP BY ALL)
SELECT user_id, year, sunscreen_check, CASE WHEN EXISTS (SELECT 1 FROM act a WHERE a.user_id = c.user_id AND a.year = c.year AND cls IN ('retinoid', 'aha')) THEN CASE WHEN sunscreen_check = 'missing' THEN 'caution' ELSE 'note' END END AS tier FROM c""")
def _(spark, d):
    p, a = actives(spark, d)
    return P.sunscreen_check(p, a, class_members(spark, d).where("class_id <> 'benzoyl'"), BY)


@query("a10_timing_notes", f"""WITH {PR} SELECT DISTINCT user_id, year, product_id, name FROM act WHERE cls = 'retinoid' AND "when" = 'am'""")
def _(spark, d):
    return P.timing_notes(actives(spark, d)[1], BY)


@query("a11_routine_report", f"""WITH {PR}, p AS (SELECT DISTINCT user_id, year, product_id, name, "when", cls FROM act),
 st AS (SELECT a.user_id, a.year, 'stacking' AS kind, 'Retinoid with ' || upper(substr(b.cls, 1, 1)) || substr(b.cls, 2) || ': ' || a.name || ' and ' || b.name AS title FROM p a JOIN p b ON a.user_id = b.user_id AND a.year = b.year AND a.cls = 'retinoid' AND b.cls <> 'retinoid' AND a.product_id <> b.product_id),
 du AS (SELECT user_id, year, 'duplicate' AS kind, inci || ' appears in ' || count(DISTINCT product_id) || ' products' AS title FROM act GROUP BY user_id, year, inci HAVING count(DISTINCT product_id) > 1 UNION ALL SELECT user_id, year, 'duplicate', 'More than one ' || cls || ' product' FROM act WHERE cls IN ('retinoid', 'aha') GROUP BY user_id, year, cls HAVING count(DISTINCT product_id) > 1 AND count(DISTINCT inci) > 1),
 c AS (SELECT user_id, year, CASE WHEN NOT bool_or(type <> '') THEN 'Mark your product types to check sunscreen' WHEN bool_or(type = 'sunscreen' AND "when" IN ('am', 'both')) THEN 'A sunscreen is marked for the morning' ELSE 'No sunscreen marked in your morning routine' END AS title FROM rt GROUP BY ALL),
 al AS (SELECT * FROM st UNION ALL SELECT * FROM du UNION ALL SELECT user_id, year, 'sunscreen', title FROM c WHERE EXISTS (SELECT 1 FROM act a WHERE a.user_id = c.user_id AND a.year = c.year AND cls IN ('retinoid', 'aha'))
  UNION ALL SELECT user_id, year, 'timing', name || ': you set it for the morning' FROM act WHERE cls = 'retinoid' AND "when" = 'am' UNION ALL SELECT user_id, year, 'coverage', 'Some ingredients are not confirmed' FROM rt WHERE unres)
SELECT DISTINCT user_id, year, kind, title FROM al""")
def _(spark, d):
    m = class_members(spark, d)
    classes = m.select("class_id").distinct().select("class_id", F.initcap("class_id").alias("name"), (F.col("class_id") != "benzoyl").alias("sun_sensitising"))
    return P.check_routine(products(spark, d), m, classes, stacking(spark, d), BY).drop("tier")


@query("a11_routine_slots", f"""WITH {PR} SELECT user_id, year, coalesce(string_agg(name, ', ' ORDER BY name) FILTER ("when" IN ('am', 'both')), '') AS am, coalesce(string_agg(name, ', ' ORDER BY name) FILTER ("when" IN ('pm', 'both')), '') AS pm, coalesce(string_agg(name, ', ' ORDER BY name) FILTER ("when" = ''), '') AS unplaced FROM rt GROUP BY ALL""")
def _(spark, d):
    return P.routine_slots(products(spark, d), BY)


@query("a12_reaction_patterns", f"""WITH {PR}, fm AS (SELECT DISTINCT upper(p_name) AS inci, p_type AS f FROM part WHERE p_size < 5), x AS (SELECT DISTINCT user_id, product_id, o_orderstatus = 'F' AS r, upper(p_name) AS inci FROM pr JOIN li ON l_orderkey = product_id),
 ab AS (SELECT user_id FROM pr WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 2), y AS (SELECT * FROM x WHERE user_id IN (SELECT user_id FROM ab)),
 i AS (SELECT user_id, 'ingredient' AS kind, inci AS label, count(*) FILTER (r) AS reacted, count(*) FILTER (NOT r) AS unreacted FROM y GROUP BY ALL HAVING count(*) FILTER (r) >= 2),
 f AS (SELECT user_id, 'family' AS kind, f AS label, count(DISTINCT product_id) FILTER (r) AS reacted, count(DISTINCT product_id) FILTER (NOT r) AS unreacted FROM y JOIN fm USING (inci) GROUP BY user_id, f HAVING count(DISTINCT product_id) FILTER (r) >= 2 AND count(DISTINCT inci) FILTER (r) >= 2)
SELECT user_id, kind, lower(label) AS label, reacted, unreacted FROM i UNION ALL SELECT user_id, kind, lower(label), reacted, unreacted FROM f""")
def _(spark, d):
    p = products(spark, d)
    m = table(spark, d, "part").where("p_size < 5").select(F.col("p_type").alias("family_id"), F.upper("p_name").alias("inci")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    r = P.reaction_patterns(p, p.where("o_orderstatus = 'F'").select("user_id", "product_id"), m)
    return r.select("user_id", "kind", F.lower("label").alias("label"), "reacted", "unreacted")


@query("a12_reaction_products", f"""WITH {PR}, fm AS (SELECT DISTINCT upper(p_name) AS inci, p_type AS f FROM part WHERE p_size < 5), x AS (SELECT DISTINCT user_id, product_id, o_orderstatus = 'F' AS r, upper(p_name) AS inci FROM pr JOIN li ON l_orderkey = product_id),
 ab AS (SELECT user_id FROM pr WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 2), y AS (SELECT * FROM x WHERE user_id IN (SELECT user_id FROM ab)),
 i AS (SELECT user_id, 'ingredient' AS kind, inci AS label, count(*) FILTER (r) AS reacted, count(*) FILTER (NOT r) AS unreacted FROM y GROUP BY ALL HAVING count(*) FILTER (r) >= 2),
 f AS (SELECT user_id, 'family' AS kind, f AS label, count(DISTINCT product_id) FILTER (r) AS reacted, count(DISTINCT product_id) FILTER (NOT r) AS unreacted FROM y JOIN fm USING (inci) GROUP BY user_id, f HAVING count(DISTINCT product_id) FILTER (r) >= 2 AND count(DISTINCT inci) FILTER (r) >= 2)
SELECT DISTINCT user_id, kind, lower(label) AS label, product_id, 'P' || product_id AS name, r AS reacted FROM (SELECT i.user_id, kind, label, product_id, r FROM i JOIN y ON y.user_id = i.user_id AND y.inci = i.label
 UNION ALL SELECT f.user_id, kind, label, product_id, r FROM f JOIN fm ON fm.f = f.label JOIN y ON y.user_id = f.user_id AND y.inci = fm.inci)""")
def _(spark, d):
    p = products(spark, d)
    m = table(spark, d, "part").where("p_size < 5").select(F.col("p_type").alias("family_id"), F.upper("p_name").alias("inci")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return P.reaction_pattern_products(p, p.where("o_orderstatus = 'F'").select("user_id", "product_id"), m).withColumn("label", F.lower("label"))


@query("a13_function_coverage", f"""WITH {LI} SELECT l_orderkey AS label_id, count(*) AS identified, count(*) FILTER (p_name NOT LIKE 'red%') AS with_role FROM li GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (p_name NOT LIKE 'red%') FROM li""")
def _(spark, d):
    from ..operators.evaluate import function_coverage
    n = lines(spark, d).select(F.col("l_orderkey").alias("label_id"), F.upper("p_name").alias("inci"))
    roles = table(spark, d, "part").where("NOT startswith(p_name, 'red')").select(F.upper("p_name").alias("inci")).distinct()
    return function_coverage(n, roles)


@query("a13_missing_roles", f"WITH {LI} SELECT upper(p_name) AS inci, count(*) AS n FROM li WHERE p_name LIKE 'red%' GROUP BY 1")
def _(spark, d):
    from ..operators.evaluate import missing_roles
    n = lines(spark, d).select(F.upper("p_name").alias("inci"))
    return missing_roles(n, table(spark, d, "part").where("NOT startswith(p_name, 'red')").select(F.upper("p_name").alias("inci")).distinct())


@query("a15_build_products", f"""WITH {LI}, {OI} SELECT label_id, coalesce(string_agg(upper(substr(name, 1, 1)) || lower(split_part(substr(name, 2), ' ', 1)) || ' ' || upper(substr(split_part(name, ' ', 2), 1, 1)) || lower(substr(split_part(name, ' ', 2), 2)), ', ' ORDER BY idx) FILTER (k > 1), '') AS ingredients,
 coalesce(string_agg(raw, ', ' ORDER BY idx) FILTER (k < 2), '') AS unresolved, CAST(label_id % 1000 AS DOUBLE) AS mrp, 50.0::DOUBLE AS volume_ml FROM oi WHERE NOT optional GROUP BY 1""")
def _(spark, d):
    it = order_items(spark, d)
    pack = it.select("label_id").distinct().withColumn("text", F.concat(F.lit("MRP Rs. "), (F.col("label_id") % 1000).cast("string"), F.lit(" for 50 ml")))
    return build_products(it, pack).select("label_id", F.array_join("ingredients", ", ").alias("ingredients"), F.array_join("unresolved", ", ").alias("unresolved"), "mrp", "volume_ml")


@query("j18_reference_compare", f"""WITH {PR}, {PAIRS}, x AS (SELECT a_id, idx, p_name AS n, EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = b_id AND b.p_name = a.p_name) AS s FROM pa JOIN li a ON a.l_orderkey = a_id WHERE b_id IS NOT NULL),
 y AS (SELECT a_id, idx, p_name AS n, EXISTS (SELECT 1 FROM li a WHERE a.l_orderkey = a_id AND a.p_name = b.p_name) AS s FROM pa JOIN li b ON b.l_orderkey = b_id)
SELECT a_id AS label_id, (SELECT count(*) FROM x WHERE x.a_id = p.a_id) AS pack_count, (SELECT count(*) FROM y WHERE y.a_id = p.a_id) AS ref_count, coalesce((SELECT string_agg(n, ', ' ORDER BY idx) FROM x WHERE x.a_id = p.a_id AND s), '') AS shared,
 coalesce((SELECT string_agg(n, ', ' ORDER BY idx) FROM x WHERE x.a_id = p.a_id AND NOT s), '') AS only_on_pack, coalesce((SELECT string_agg(n, ', ' ORDER BY idx) FROM y WHERE y.a_id = p.a_id AND NOT s), '') AS only_in_reference FROM pa p WHERE b_id IS NOT NULL""")
def _(spark, d):
    pairs = next_pairs(spark, d)
    ex = lambda c: pairs.select(F.col("a_id").alias("label_id"), F.posexplode(c).alias("idx", "name")).withColumn("name", F.lower("name"))
    return P.reference_compare(ex("a_ingredients"), ex("b_ingredients"))
