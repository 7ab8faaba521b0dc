"""Queries over OCR readings, evaluation and streams.  Events are readings: a user is a photo, a week a pass."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F, types as T

from ..functions import text as X
from ..operators import evaluate as E, ocr as O
from ..operators.stitch import merge_photos
from ..runtime import checkpoint_folder, shuffled
from ..streaming import jobs as J
from .match_queries import resolved_orders
from .registry import LI, lines, part_dictionary, part_names, query, sql_key, table


def readings(spark, d):
    """Events as readings: photo, pass (week of the month), place in the pass, text, confidence, nearest name and its similarity."""
    e = table(spark, d, "events")
    text = F.concat_ws(" ", "event_type", F.substring(F.md5((F.col("event_id") % 40).cast("string")), 1, 5))
    w = Window.partitionBy("photo_id", "pass_id").orderBy("event_id")
    b = e.select(F.col("user_id").alias("photo_id"), F.concat(F.lit("p"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")).alias("pass_id"), "event_id", text.alias("text"), (30 + F.col("event_id") % 60).cast("double").alias("conf"),
                 F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("N"), (F.col("event_id") % 25).cast("string"))).alias("name"))
    b = b.withColumn("sim", F.when(F.col("name").isNotNull(), 0.68 + (F.col("event_id") % 8) * 0.04).otherwise(F.lit(0.3)))
    return b.withColumn("idx", F.row_number().over(w) - 1).drop("event_id")


RD = """rd AS (SELECT user_id AS photo_id, 'p' || CAST((day(ts) - 1) // 7 AS INT) AS pass_id, event_id, event_type || ' ' || substr(md5(CAST(event_id % 40 AS VARCHAR)), 1, 5) AS text, CAST(30 + event_id % 60 AS DOUBLE) AS conf,
 CASE WHEN event_id % 3 <> 0 THEN 'N' || (event_id % 25) END AS name, row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY event_id) - 1 AS idx FROM events)"""
CL = f"""{RD}, rk AS (SELECT *, {sql_key('text', False)} AS k FROM rd), ks AS (SELECT photo_id, k, row_number() OVER (PARTITION BY photo_id ORDER BY k) AS rn FROM (SELECT DISTINCT photo_id, k FROM rk WHERE name IS NULL)),
 rt AS (WITH RECURSIVE s AS (SELECT photo_id, 0::BIGINT AS rn, ''::VARCHAR AS k, ''::VARCHAR AS root, []::VARCHAR[] AS roots FROM (SELECT DISTINCT photo_id FROM ks) UNION ALL
  SELECT photo_id, rn, k, coalesce(hit, k), CASE WHEN hit IS NULL THEN list_append(roots, k) ELSE roots END FROM (SELECT ks.photo_id, ks.rn, ks.k, s.roots, list_filter(s.roots, lambda x: 1 - levenshtein(x, ks.k) / greatest(length(x), length(ks.k)) >= 0.75)[1] AS hit FROM s JOIN ks ON ks.photo_id = s.photo_id AND ks.rn = s.rn + 1))
  SELECT photo_id, k, root FROM s WHERE rn > 0),
 cl AS (SELECT rk.*, base || '#' || row_number() OVER (PARTITION BY photo_id, pass_id, base ORDER BY idx) AS cluster FROM (SELECT rk.*, CASE WHEN name IS NOT NULL THEN 'n:' || name ELSE 'r:' || root END AS base FROM rk LEFT JOIN rt USING (photo_id, k)) rk)"""


@query("w8_cluster_readings", f"WITH {CL} SELECT photo_id, cluster, count(DISTINCT pass_id) AS votes, count(*) AS n FROM cl GROUP BY ALL")
def _(spark, d):
    return O.cluster_readings(readings(spark, d)).groupBy("photo_id", "cluster").agg(F.count_distinct("pass_id").alias("votes"), F.count("*").alias("n"))


@query("w8_base_pass", f"""WITH {CL}, s AS (SELECT photo_id, pass_id, count(DISTINCT cluster) FILTER (name IS NOT NULL) * 1000 + avg(conf) AS score FROM cl GROUP BY ALL)
SELECT photo_id, pass_id AS base_pass FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, pass_id) rn FROM s) WHERE rn = 1""")
def _(spark, d):
    return O.base_pass(O.cluster_readings(readings(spark, d)))


@query("w8_consensus_readings")
def _(spark, d):
    r = O.consensus(readings(spark, d))
    return r.select("photo_id", "cluster", "text", "name", F.round("sim", 3).alias("sim"), "votes", "from_", F.round("pos", 5).alias("pos"))


@query("w9_fuse_passes", f"""WITH {RD}, rk AS (SELECT *, {sql_key('text', False)} AS k, count(*) OVER (PARTITION BY photo_id, pass_id) AS n FROM rd), ks AS (SELECT photo_id, k, row_number() OVER (PARTITION BY photo_id ORDER BY k) AS rn FROM (SELECT DISTINCT photo_id, k FROM rk)),
 rt AS (WITH RECURSIVE s AS (SELECT photo_id, 0::BIGINT AS rn, ''::VARCHAR AS k, ''::VARCHAR AS root, []::VARCHAR[] AS roots FROM (SELECT DISTINCT photo_id FROM ks) UNION ALL
  SELECT photo_id, rn, k, coalesce(hit, k), CASE WHEN hit IS NULL THEN list_append(roots, k) ELSE roots END FROM (SELECT ks.photo_id, ks.rn, ks.k, s.roots, list_filter(s.roots, lambda x: 1 - levenshtein(x, ks.k) / greatest(length(x), length(ks.k)) >= 0.7)[1] AS hit FROM s JOIN ks ON ks.photo_id = s.photo_id AND ks.rn = s.rn + 1))
  SELECT photo_id, k, root FROM s WHERE rn > 0),
 cl AS (SELECT rk.*, 'r:' || root || '#' || row_number() OVER (PARTITION BY photo_id, pass_id, root ORDER BY idx) AS cluster, conf * least(1.0, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / 6) AS q, CASE WHEN n > 1 THEN idx / (n - 1) ELSE 0.5 END AS pos FROM rk JOIN rt USING (photo_id, k)),
 g AS (SELECT photo_id, cluster, first(text ORDER BY q DESC, pass_id, idx) AS text, first(conf ORDER BY q DESC, pass_id, idx) AS conf, count(*) AS votes, round(avg(pos), 5) AS pos, count(DISTINCT text) > 1 AS conflict FROM cl GROUP BY ALL)
SELECT * FROM g WHERE conf >= 45 OR votes >= 2""")
def _(spark, d):
    return O.fuse_passes(readings(spark, d)).withColumn("pos", F.round("pos", 5))


@query("w11_segment_provenance", f"WITH {RD} SELECT name, count(DISTINCT photo_id) AS n_photos, count(DISTINCT text) > 1 AS conflict, max(conf) < 70 AS low_confidence FROM rd WHERE name IS NOT NULL GROUP BY 1")
def _(spark, d):
    return O.segment_provenance(readings(spark, d).where("name IS NOT NULL"), ["name"])


@query("a14_photo_confidence", f"WITH {RD} SELECT photo_id, round(avg(conf), 6) AS mean_conf, min(conf) FILTER (regexp_matches(text, '\\d')) AS min_digit_conf FROM rd GROUP BY 1")
def _(spark, d):
    return O.photo_confidence(readings(spark, d).withColumnRenamed("conf", "confidence"), ["photo_id"]).withColumn("mean_conf", F.round("mean_conf", 6))


def two_photos(spark, d):
    """An order's lines as two photos of one list: the first without its last line, the second without its first one or two."""
    li = lines(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    name = F.concat("p_name", F.lit(" "), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "idx")), 1, 5))
    a = li.where("idx < n - 1").select(F.col("l_orderkey").alias("product_id"), F.col("idx").alias("i"), name.alias("text"), F.lit(80.0).alias("conf"))
    cut = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(2)
    b = li.where(F.col("idx") >= cut).select(F.col("l_orderkey").alias("product_id"), (F.col("idx") - cut).alias("i"), name.alias("text"), (70.0 + F.col("idx") * 5).alias("conf"))
    return a, b


@query("w7_stitch_overlaps")
def _(spark, d):
    return O.stitch_overlaps(*two_photos(spark, d))


@query("w7_stitch_counts", f"""WITH {LI}, n AS (SELECT l_orderkey AS product_id, count(*) AS n, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 2 END AS cut FROM li GROUP BY 1)
SELECT product_id, n - 1 - cut >= 2 AS overlap FROM n WHERE n - 1 > 0 OR n > cut""")
def _(spark, d):
    return O.stitch_overlaps(*two_photos(spark, d)).groupBy("product_id").agg(F.bool_or("overlap").alias("overlap"))


# three photos of an order: without its last line, and twice without its first; from four lines on every photo overlaps the list before it
@query("w7_merge_photos", f"""WITH {LI}, x AS (SELECT l_orderkey AS product_id, idx, p_name || ' ' || substr(md5(l_orderkey || '-' || idx), 1, 12) AS t, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li),
 y AS (SELECT *, unnest(CASE WHEN (n = 3 AND idx = 1) OR (n = 2 AND idx = 1) THEN [1, 2] ELSE [1] END) AS k FROM x)
SELECT product_id, string_agg(t, '|' ORDER BY idx, k) AS texts, any_value(CASE n WHEN 1 THEN '' WHEN 2 THEN 'false,false' WHEN 3 THEN 'false,true' ELSE 'true,true' END) AS overlaps,
 any_value(CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 * n - 3 END) AS matched FROM y GROUP BY 1""")
def _(spark, d):
    li = lines(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    name = F.concat("p_name", F.lit(" "), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "idx")), 1, 12))
    words = F.transform(F.split(name, " "), lambda w: F.named_struct(F.lit("text"), w, F.lit("confidence"), 70.0 + F.col("idx")))
    seen = F.when(F.col("n") == 1, F.array(F.lit(1))).when(F.col("idx") == 0, F.array(F.lit(1))).when(F.col("idx") == F.col("n") - 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    r = merge_photos(li.select(F.col("l_orderkey").alias("product_id"), F.explode(seen).alias("photo_id"), "idx", words.alias("words")))
    return r.select("product_id", F.array_join("items.text", "|").alias("texts"), F.array_join(F.transform("overlaps", lambda x: x.cast("string")), ",").alias("overlaps"), "matched")


@query("f10_trim_junk_prefix")
def _(spark, d):
    li = lines(spark, d)
    junk = F.when(F.col("l_partkey") % 3 == 0, F.array(F.struct(F.lit("zxqv").alias("text"), F.lit(20.0).alias("confidence")))).otherwise(F.array().cast("array<struct<text:string,confidence:double>>"))
    ws = F.concat(junk, F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("text"), F.lit(50.0).alias("confidence"))))
    s = li.select(F.concat_ws("-", "l_orderkey", "idx").alias("seg_id"), ws.alias("words"))
    return O.trim_junk_prefix(s, part_names(spark, d))


# ---- evaluation

@query("j24_match_truth", f"""WITH {LI}, t AS (SELECT l_orderkey AS label_id, idx AS ord, {sql_key('p_name')} AS want FROM li), i AS (SELECT l_orderkey AS label_id, idx, {sql_key('printed')} AS key FROM li),
 m AS (SELECT t.label_id, ord, CASE WHEN want = key THEN 0 ELSE 1 END AS r, idx FROM t JOIN i ON t.label_id = i.label_id AND (want = key OR (least(length(want), length(key)) >= 5 AND (contains(want, key) OR contains(key, want)) AND least(length(want), length(key)) / greatest(length(want), length(key)) >= 0.8))),
 b AS (SELECT *, row_number() OVER (PARTITION BY label_id, ord ORDER BY r, idx) rn FROM m)
SELECT t.label_id, t.ord, b.idx FROM t LEFT JOIN b ON t.label_id = b.label_id AND t.ord = b.ord AND rn = 1""")
def _(spark, d):
    li = lines(spark, d).withColumnRenamed("l_orderkey", "label_id")
    return E.match_truth(li.select("label_id", F.col("idx").alias("ord"), F.col("p_name").alias("raw")), li.select("label_id", "idx", F.col("printed").alias("raw")))


@query("j25_word_recall")
def _(spark, d):
    li = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", "p_name", "printed"))).alias("m"))
    p = li.select(F.col("l_orderkey").alias("photo_id"), F.array_join("m.p_name", " ").alias("truth"), F.array_join("m.printed", " ").alias("ocr"))
    return E.word_recall(p)


@query("e1_resolution_outcome", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'resolved_ok' ELSE 'resolved_wrong' END WHEN 'O' THEN CASE o_custkey % 3 WHEN 0 THEN 'sugg_top1_ok' WHEN 1 THEN 'sugg_top3_only' ELSE 'sugg_top1_wrong' END ELSE 'not_found' END
 WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 3 = 2 THEN 'sugg_top1_wrong' ELSE 'sugg_top1_ok' END ELSE 'not_found' END
 ELSE CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 4 = 0 THEN 'category_ok' WHEN o_custkey % 4 = 1 THEN 'category_ok' ELSE 'category_wrong' END ELSE 'not_found' END END AS outcome FROM orders""")
def _(spark, d):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    st = F.when(s == "F", "resolved").when(s == "O", "suggested").otherwise("not_found")
    cands = F.when(c % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(c % 3 == 1, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("C")))
    want = F.when(k % 3 == 0, "A")
    anyof = F.when(k % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    layer = F.when(c % 4 == 0, "inci_exact").otherwise("category_recognized")
    icat = F.when(c % 4 == 1, "botanical").otherwise("polymer")
    o = E.resolution_outcome(k % 10 != 0, st, layer, F.when(c % 2 == 0, "A").otherwise("Z"), icat, F.when(s == "O", cands).otherwise(F.array().cast("array<string>")), want, anyof, F.lit("Botanical extract"))
    return table(spark, d, "orders").select("o_orderkey", o.alias("outcome"))


def order_outcomes(spark, d):
    """The resolved order labels measured against the true part names."""
    li = lines(spark, d)
    truth = li.select(F.col("l_orderkey").alias("label_id"), F.col("idx").alias("ord"), F.col("printed").alias("raw"), F.upper("p_name").alias("inci"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("suggested_any_of"))
    return E.truth_outcomes(truth, resolved_orders(spark, d).items)


@query("e2_resolution_report")
def _(spark, d):
    return E.resolution_report(order_outcomes(spark, d))


@query("e2_layer_report")
def _(spark, d):
    return E.layer_report(order_outcomes(spark, d))


@query("e2_grouped_report")
def _(spark, d):
    return E.grouped_report(order_outcomes(spark, d).withColumn("grp", F.when(F.col("label_id") % 10 == 0, "golden").when(F.col("label_id") % 3 == 0, "synthetic").otherwise("clean")))


# removed fragments, changes and missing rows stated by the lines of an order
@query("e2_change_report", f"""WITH {LI}, l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'synthetic' ELSE 'clean' END AS grp, count(*) FILTER (l_returnflag = 'A') AS merges, count(*) FILTER (l_returnflag = 'R') // 2 AS splits FROM li GROUP BY 1),
 rm AS (SELECT l_orderkey, {sql_key('printed')} AS x FROM li WHERE l_quantity > 30), er AS (SELECT l_orderkey, {sql_key('p_name')} AS w FROM li WHERE l_quantity > 25),
 ms AS (SELECT l_orderkey, {sql_key("split_part(p_name, ' ', 1)")} AS w FROM li WHERE l_quantity <= 10),
 p AS (SELECT grp, merges, splits, (SELECT count(*) FROM er WHERE er.l_orderkey = l.l_orderkey) AS expected_removed,
  (SELECT count(*) FROM er WHERE er.l_orderkey = l.l_orderkey AND EXISTS (SELECT 1 FROM rm WHERE rm.l_orderkey = er.l_orderkey AND length(x) >= 4 AND (contains(x, w) OR contains(w, x)))) AS removed_right,
  (SELECT count(*) FROM ms WHERE ms.l_orderkey = l.l_orderkey AND EXISTS (SELECT 1 FROM rm WHERE rm.l_orderkey = ms.l_orderkey AND length(x) >= 5 AND (contains(x, w) OR contains(w, x)))) AS wrongly_removed FROM l)
SELECT grp, count(*) AS labels, CAST(sum(expected_removed) AS BIGINT) AS expected_removed, CAST(sum(removed_right) AS BIGINT) AS removed_right, CAST(sum(wrongly_removed) AS BIGINT) AS wrongly_removed, CAST(sum(merges) AS BIGINT) AS merges, CAST(sum(splits) AS BIGINT) AS splits FROM p GROUP BY ROLLUP (grp)""")
def _(spark, d):
    li = lines(spark, d).withColumnRenamed("l_orderkey", "label_id")
    labels = li.select("label_id").distinct().withColumn("grp", F.when(F.col("label_id") % 3 == 0, "synthetic").otherwise("clean"))
    items = li.select("label_id", (F.col("l_returnflag") == "A").alias("merged"), (F.col("l_returnflag") == "R").alias("split"))
    raw = lambda where, c: li.where(where).select("label_id", c.alias("raw"))
    return E.change_report(labels, items, raw("l_quantity > 30", F.col("printed")), raw("l_quantity > 25", F.col("p_name")), raw("l_quantity <= 10", F.split_part("p_name", F.lit(" "), F.lit(1))))


@query("e3_threshold_sweep", """
WITH s AS (SELECT o_totalprice / 500000 AS score, (o_custkey % 40) / 100.0 AS margin, o_orderkey % 4 AS un, o_orderkey % 3 AS ex, o_orderstatus = 'F' AS ok FROM orders),
 g AS (SELECT * FROM (VALUES (0.75), (0.80), (0.85)) a(high_score), (VALUES (0.05), (0.08), (0.12)) b(high_margin), (VALUES (1), (2)) c(max_unexplained), (VALUES (0.85), (0.90)) e(dominant_score), (VALUES (0.12), (0.15), (0.20), (0.25)) f(dominant_margin))
SELECT CAST(high_score AS DOUBLE) AS high_score, CAST(high_margin AS DOUBLE) AS high_margin, max_unexplained, CAST(dominant_score AS DOUBLE) AS dominant_score, CAST(dominant_margin AS DOUBLE) AS dominant_margin, count(*) FILTER (h) AS total, count(*) FILTER (h AND ok) AS "right", count(*) FILTER (h AND NOT ok) AS wrong
FROM (SELECT *, ((score >= high_score::DOUBLE AND margin::DOUBLE >= high_margin::DOUBLE AND un <= max_unexplained) OR (score >= dominant_score::DOUBLE AND margin::DOUBLE >= dominant_margin::DOUBLE)) AND ex < 2 AS h FROM s, g) GROUP BY ALL""")
def _(spark, d):
    s = table(spark, d, "orders").select((F.col("o_totalprice") / 500000).alias("score"), ((F.col("o_custkey") % 40) / 100.0).alias("margin"), (F.col("o_orderkey") % 4).alias("unexplained"), (F.col("o_orderkey") % 3).alias("extra"), (F.col("o_orderstatus") == "F").alias("right"))
    return E.threshold_sweep(s)


@query("e4_noisy_copies")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("raw"))
    return E.noisy_copies(p, 5)


@query("e4_noisy_distance", "SELECT CAST(c AS INT) AS copy, count(*) AS n, 0 AS too_far FROM part, (SELECT unnest(range(1, 6)) AS c) GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("raw"))
    n = E.noisy_copies(p, 5).join(shuffled(p.withColumnRenamed("raw", "orig")), "id")
    return n.groupBy("copy").agg(F.count("*").alias("n"), F.count_if(F.levenshtein("raw", "orig") > 4).alias("too_far"))


@query("e6_text_score", f"""WITH {LI}, e AS (SELECT l_orderkey AS photo_id, p_name AS key, l_quantity > 5 AS cov FROM li), i AS (SELECT l_orderkey AS photo_id, printed AS key, l_returnflag = 'A' AS au, idx FROM li),
 x AS (SELECT *, row_number() OVER (PARTITION BY photo_id, key) AS o FROM e WHERE cov), y AS (SELECT *, row_number() OVER (PARTITION BY photo_id, key ORDER BY idx) AS o FROM i),
 m AS (SELECT x.photo_id, count(*) AS n, count(y.o) AS top1, count(*) FILTER (au) AS auto FROM x LEFT JOIN y USING (photo_id, key, o) GROUP BY 1)
SELECT *, (SELECT count(*) FROM i WHERE i.photo_id = m.photo_id AND NOT EXISTS (SELECT 1 FROM e WHERE e.photo_id = i.photo_id AND e.key = i.key)) AS false_accepts FROM m""")
def _(spark, d):
    li = lines(spark, d).withColumnRenamed("l_orderkey", "photo_id")
    e = li.select("photo_id", F.col("p_name").alias("key"), F.col("idx").alias("ord"), (F.col("l_quantity") > 5).alias("covered"))
    return E.text_score(e, li.select("photo_id", F.col("printed").alias("key"), "idx", F.when(F.col("l_returnflag") == "A", "auto").otherwise("sugg").alias("how")))


def scores(spark, d):
    """Orders as photo scores: the photo is the customer, the variant the year."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("photo_id"), F.year("o_orderdate").cast("string").alias("variant")).agg(F.count("*").alias("top1"), F.avg(F.col("o_totalprice") / 500000).alias("cer"))


@query("e7_variant_compare", """WITH s AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) = 1996) AS x, count(*) FILTER (year(o_orderdate) = 1997) AS y FROM orders GROUP BY 1)
SELECT count(*) FILTER (x > y) AS a_better, count(*) FILTER (y > x) AS b_better, count(*) FILTER (x = y) AS ties, CAST(coalesce(sum(y - x), 0) AS BIGINT) AS net_gain FROM s WHERE x > 0 AND y > 0""")
def _(spark, d):
    return E.variant_compare(scores(spark, d), "1996", "1997")


@query("e7_variant_means", "SELECT CAST(y AS VARCHAR) AS variant, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(top1), 6) AS top1 FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS top1, avg(o_totalprice / 500000) AS cer FROM orders GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return E.variant_means(scores(spark, d)).withColumn("cer", F.round("cer", 6)).withColumn("top1", F.round("top1", 6))


@query("e8_merge_gain", f"""WITH {LI}, r AS (SELECT l_orderkey AS product_id, CASE idx % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'merged' END AS reading, count(*) FILTER (l_quantity > 10) / count(*) AS r FROM li GROUP BY ALL)
SELECT product_id, round(max(r) FILTER (reading = 'a'), 6) AS a, round(max(r) FILTER (reading = 'b'), 6) AS b, round(max(r) FILTER (reading = 'merged'), 6) AS merged FROM r GROUP BY 1""")
def _(spark, d):
    k = F.col("idx") % 3
    s = lines(spark, d).groupBy(F.col("l_orderkey").alias("product_id"), F.when(k == 0, "a").when(k == 1, "b").otherwise("merged").alias("reading")).agg(F.count_if(F.col("l_quantity") > 10).alias("top1"), F.count("*").alias("n"))
    m = E.merge_gain(s)
    return m.select("product_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "merged")])


@query("e9_consensus_gain", f"""WITH {LI}, t AS (SELECT DISTINCT l_orderkey AS photo_id, CASE WHEN l_orderkey % 3 = 0 THEN 'real' ELSE 'synthetic' END AS grp, p_name AS key FROM li),
 n AS (SELECT DISTINCT l_orderkey AS photo_id, ['single', 'consensus', 'other'][l_linenumber % 3 + 1] AS reading, printed AS key FROM li),
 ok AS (SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM t WHERE t.photo_id = n.photo_id AND t.key = n.key)),
 h AS (SELECT t.photo_id, grp, count(*) AS truth, (SELECT count(*) FROM ok WHERE ok.photo_id = t.photo_id AND reading = 'single') AS s, (SELECT count(*) FROM ok WHERE ok.photo_id = t.photo_id AND reading = 'consensus') AS c, (SELECT count(DISTINCT key) FROM ok WHERE ok.photo_id = t.photo_id AND reading <> 'consensus') AS a,
  (SELECT count(*) FROM n WHERE n.photo_id = t.photo_id AND reading = 'single') AS sg, (SELECT count(*) FROM n WHERE n.photo_id = t.photo_id AND reading = 'consensus') AS cg FROM t GROUP BY t.photo_id, grp)
SELECT grp, CAST(sum(truth) AS BIGINT) AS truth, CAST(sum(s) AS BIGINT) AS single, CAST(sum(c) AS BIGINT) AS consensus, CAST(sum(a) AS BIGINT) AS any_pass, CAST(sum(sg) AS BIGINT) AS single_given, CAST(sum(cg) AS BIGINT) AS consensus_given FROM h GROUP BY ROLLUP (grp)""")
def _(spark, d):
    li = lines(spark, d)
    t = li.select(F.col("l_orderkey").alias("photo_id"), F.when(F.col("l_orderkey") % 3 == 0, "real").otherwise("synthetic").alias("grp"), F.col("p_name").alias("key")).distinct()
    r = F.col("l_linenumber") % 3
    n = li.select(F.col("l_orderkey").alias("photo_id"), F.when(r == 0, "single").when(r == 1, "consensus").otherwise("other").alias("reading"), F.col("printed").alias("key"))
    return E.consensus_gain(n, t, ["grp"])


@query("f11_e10_cause_report", f"""WITH {LI}, tk AS (SELECT l_orderkey, printed || CASE l_partkey % 5 WHEN 0 THEN ' MRP 5' WHEN 1 THEN ' butter' ELSE '' END AS tok, l_quantity > 48 AS rh, l_partkey % 7 = 0 AS cl, l_partkey % 11 = 0 AS c2, l_suppkey % 13 = 0 AS ip FROM li),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(upper(tok), '[^A-Z0-9/,.\\- ]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM tk),
 nm AS (SELECT DISTINCT l_orderkey, upper(p_name) AS m FROM li), r AS (SELECT l_orderkey, n, max(1 - levenshtein(n, m) / greatest(length(n), length(m))) AS best FROM (SELECT DISTINCT l_orderkey, n FROM k) JOIN nm USING (l_orderkey) GROUP BY ALL),
 c AS (SELECT tok, rh OR regexp_matches(tok, '(?i)\\bMRP\\b') AS l, c2 OR ip AS br, cl OR regexp_matches(tok, '(?i)\\b(EXTRACT|LEAF JUICE|SEED GUM|BUTTER)\\b') AS w, best >= 0.7 AND best < 1 AS nz FROM k JOIN r USING (l_orderkey, n)),
 x AS (SELECT list_filter([CASE WHEN l THEN '4_leakage' END, CASE WHEN br THEN '2_broken_merged' END, CASE WHEN w THEN '3_wrong_tool' END, CASE WHEN NOT br AND NOT w AND nz THEN '1_ocr_noise' END], lambda y: y IS NOT NULL) AS cs FROM c),
 z AS (SELECT unnest(CASE WHEN len(cs) = 0 THEN ['5_unknown'] ELSE cs END) AS cause, generate_subscripts(CASE WHEN len(cs) = 0 THEN ['5_unknown'] ELSE cs END, 1) AS i FROM x)
SELECT cause, count(*) FILTER (i = 1) AS as_primary, count(*) AS as_any FROM z GROUP BY 1""")
def _(spark, d):
    k = F.col("l_partkey") % 5
    li = lines(spark, d)
    t = li.select(F.col("l_orderkey").alias("label_id"), F.concat("printed", F.when(k == 0, " MRP 5").when(k == 1, " butter").otherwise("")).alias("token"), (F.col("l_quantity") > 48).alias("removed"),
                  (F.col("l_partkey") % 7 == 0).alias("classed"), (F.col("l_partkey") % 11 == 0).alias("two"), (F.col("l_suppkey") % 13 == 0).alias("part"))
    best = E.best_truth_ratio(t, li.select(F.col("l_orderkey").alias("label_id"), F.upper("p_name").alias("name")))
    c = t.join(best, ["label_id", "token"]).select(E.failure_causes(F.col("token"), F.col("best"), F.col("two"), F.col("part"), F.col("removed"), F.col("classed")).alias("causes"))
    return E.cause_report(c)


# an order as a label with truth: some tokens hold two lines' names, some entries are "A + B", some are known by class only
TRUTH = f"""{LI}, nx AS (SELECT *, lead(p_name) OVER (PARTITION BY l_orderkey ORDER BY idx) AS nxt FROM li),
 tk AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 11 = 0 AND nxt IS NOT NULL THEN printed || ' ' || nxt ELSE printed || CASE l_partkey % 5 WHEN 0 THEN ' MRP 5' WHEN 1 THEN ' butter' ELSE '' END END AS tok FROM nx),
 tr AS (SELECT l_orderkey, idx, CASE WHEN l_suppkey % 13 = 0 AND nxt IS NOT NULL THEN p_name || ' + ' || nxt ELSE p_name END AS raw, CASE WHEN l_partkey % 7 <> 0 THEN upper(p_name) END AS inci FROM nx),
 rm AS (SELECT DISTINCT l_orderkey, upper(split_part(p_name, ' ', 1)) AS e FROM nx WHERE l_quantity > 48)"""
SQL_NORM = "trim(regexp_replace(regexp_replace(upper({}), '[^A-Z0-9/,.\\- ]', '', 'g'), '\\s+', ' ', 'g'))"


@query("f11_e10_causes_from_truth", f"""WITH {TRUTH}, k AS (SELECT l_orderkey, tok, {SQL_NORM.format('tok')} AS n FROM tk),
 pt AS (SELECT l_orderkey, contains(raw, ' + ') AS j, {SQL_NORM.format("unnest(string_split(raw, ' + '))")} AS e FROM tr),
 h AS (SELECT k.l_orderkey, k.tok, e FROM k JOIN pt ON k.l_orderkey = pt.l_orderkey AND length(e) > 5 AND contains(n, e)),
 b2 AS (SELECT l_orderkey, tok FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.l_orderkey = h.l_orderkey AND o.tok = h.tok AND o.e <> h.e AND contains(o.e, h.e)) GROUP BY ALL HAVING count(*) >= 2),
 f AS (SELECT k.*, regexp_matches(tok, '(?i)\\bMRP\\b') OR EXISTS (SELECT 1 FROM rm WHERE rm.l_orderkey = k.l_orderkey AND contains(k.n, rm.e)) AS l,
  EXISTS (SELECT 1 FROM b2 WHERE b2.l_orderkey = k.l_orderkey AND b2.tok = k.tok) OR EXISTS (SELECT 1 FROM pt WHERE pt.l_orderkey = k.l_orderkey AND j AND e = k.n) AS br,
  regexp_matches(tok, '(?i)\\bBUTTER\\b') OR coalesce((SELECT arg_min(inci IS NULL, idx) FROM tr WHERE tr.l_orderkey = k.l_orderkey AND {SQL_NORM.format('raw')} = k.n), false) AS w,
  coalesce((SELECT max(1 - levenshtein(k.n, inci) / greatest(length(k.n), length(inci))) FROM tr WHERE tr.l_orderkey = k.l_orderkey AND inci IS NOT NULL), 0) AS best FROM k),
 x AS (SELECT list_filter([CASE WHEN l THEN '4_leakage' END, CASE WHEN br THEN '2_broken_merged' END, CASE WHEN w THEN '3_wrong_tool' END, CASE WHEN NOT br AND NOT w AND best >= 0.7 AND best < 1 THEN '1_ocr_noise' END], lambda y: y IS NOT NULL) AS cs FROM f),
 z AS (SELECT unnest(CASE WHEN len(cs) = 0 THEN ['5_unknown'] ELSE cs END) AS cause, generate_subscripts(CASE WHEN len(cs) = 0 THEN ['5_unknown'] ELSE cs END, 1) AS i FROM x)
SELECT cause, count(*) FILTER (i = 1) AS as_primary, count(*) AS as_any FROM z GROUP BY 1""")
def _(spark, d):
    k, nxt = F.col("l_partkey"), F.col("nxt")
    li = lines(spark, d).withColumn("nxt", F.lead("p_name").over(Window.partitionBy("l_orderkey").orderBy("idx"))).withColumnRenamed("l_orderkey", "label_id")
    end = F.when(k % 5 == 0, " MRP 5").when(k % 5 == 1, " butter").otherwise("")
    tokens = li.select("label_id", F.when((k % 11 == 0) & nxt.isNotNull(), F.concat_ws(" ", "printed", nxt)).otherwise(F.concat("printed", end)).alias("token"))
    truth = li.select("label_id", F.col("idx").alias("ord"), F.when((F.col("l_suppkey") % 13 == 0) & nxt.isNotNull(), F.concat_ws(" + ", "p_name", nxt)).otherwise(F.col("p_name")).alias("raw"),
                      F.when(k % 7 != 0, F.upper("p_name")).alias("inci"), F.when(k % 7 == 0, "polymer").alias("category"))
    gone = li.where("l_quantity > 48").select("label_id", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("raw"))
    return E.cause_report(E.token_causes(tokens, truth, gone))


@query("e11_truth_coverage", f"""WITH {LI}, n AS (SELECT DISTINCT upper(p_name) AS m FROM part) SELECT DISTINCT printed AS raw, CASE WHEN m IS NOT NULL THEN true ELSE false END AS covered, coalesce(m, upper(printed)) AS inci FROM li LEFT JOIN n ON {sql_key('m')} = {sql_key('printed')}""")
def _(spark, d):
    t = lines(spark, d).select(F.col("printed").alias("raw")).distinct()
    return E.truth_coverage(t, part_dictionary(spark, d).lookup).drop("category")


# ---- streams

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream(spark, d, name="events"):
    """A table as a stream; the pattern matches its name alone, be it one file or a folder of files (a stream takes no single file)."""
    schema = table(spark, d, name).schema
    s = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def place(spark):
    root = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


@query("t2_dedup_labels", "SELECT count(DISTINCT user_id || event_type) AS n_keys FROM events")
def _(spark, d):
    s = stream(spark, d).select("event_id", "ts", F.concat(F.col("user_id").cast("string"), "event_type").alias("key"))
    out = J.run_to_table(J.dedup_labels(s, "key", horizon="60 days"), *place(spark), mode="append")
    return out.agg(F.count("*").alias("n_keys"))


@query("t3_reaction_alerts", "SELECT user_id, event_type AS key, min(event_id) AS first_product, max(event_id) AS second_product FROM events WHERE value > 25 GROUP BY ALL HAVING count(DISTINCT event_id) >= 2")
def _(spark, d):
    s = stream(spark, d).where("value > 25").select("user_id", F.col("event_id").alias("product_id"), F.col("event_type").alias("key"))
    out = J.run_to_table(J.reaction_alerts(s), *place(spark))
    return out.groupBy("user_id", "key").agg(F.max_by("first_product", "batch").alias("first_product"), F.max_by("second_product", "batch").alias("second_product"))


@query("t3_reaction_alerts_once", """WITH o AS (SELECT user_id, event_type AS key, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE value > 25)
SELECT a.user_id, a.key, a.event_id AS first_product, b.event_id AS second_product FROM o a JOIN o b ON a.user_id = b.user_id AND a.key = b.key AND a.n = 1 AND b.n = 2""")
def _(spark, d):
    s = stream(spark, d).where("value > 25").select("user_id", F.col("event_id").alias("product_id"), F.col("event_type").alias("key"), "ts")
    return J.run_to_table(J.reaction_alerts_once(s, "400 days"), *place(spark), mode="append").drop("batch", "alerted")


@query("t4_needs_review_rate", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_review FROM events GROUP BY 1")
def _(spark, d):
    s = stream(spark, d).withColumn("needs_review", F.col("event_type") == "error")
    out = J.run_to_table(J.needs_review_rate(s), *place(spark))
    return out.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max("n").alias("n"), F.max("n_review").alias("n_review"))


@query("t5_review_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, d):
    out = J.run_to_table(J.review_sessions(stream(spark, d), "12 hours").drop("session_end"), *place(spark), mode="complete")
    last = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return last.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("t1_resolve_stream")
def _(spark, d):
    s = stream(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("label_id"), F.lit(0).alias("source_index"), F.col("text").alias("raw"))
    out, state = place(spark)
    J.resolve_stream(s, part_dictionary(spark, d), out, state, one_source=True).awaitTermination()
    return spark.read.parquet(out).groupBy("status", "layer").agg(F.count("*").alias("n"))
