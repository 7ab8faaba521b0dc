"""One query per operator, over its whole table, and the SQL of those that SQL can state."""
from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bpe, chat, decontaminate, exact, language, lines, near, periodic, quality, secrets, substrings, topk, variants
from .common import crc_mod, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_language_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language.learn(docs.filter(crc_mod("doc_id", 4) != 2))
    return language.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality_pu(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.learn(docs.filter(crc_mod("doc_id", 5) != 0), table(spark, d, "labels").filter(crc_mod("doc_id", 5) != 0))
    s = quality.score(docs, model)
    return s.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    n = near.near_duplicates(table(spark, d, "documents"))
    return n.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Conversation -7: texts that hold every control string of the template.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_paths(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    w = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = rows.withColumn("msg_id", F.row_number().over(w)).withColumn("parent_id", F.col("msg_id") - 1)
    f = chat.format_trees(rows, tree_col="conv_id")
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    f = f.select("conv_id", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                    F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), chr(10), '\n')) + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) + 13 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def op5_phrase_automata(spark: SparkSession, d: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN m USING (win) WHERE doc_id > low),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
k AS (SELECT doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (c.p IS NULL) AS kept FROM t LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op6_line_windows(spark: SparkSession, d: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l WHERE len(l) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE trim(replace(win, chr(10), '')) <> '') WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r),
s AS (SELECT l.doc_id, t.p, l.l[t.p] AS line, c.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p FROM l) t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id, p))
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM (SELECT doc_id FROM documents) d LEFT JOIN
 (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id) k USING (doc_id)"""


def op7_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    s = secrets.scan_secrets(table(spark, d, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [of(k) for k in secrets.BASE]
    return s.select("doc_id", *n, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op8_top_k(spark: SparkSession, d: str) -> DataFrame:
    return topk.exact_top_k(table(spark, d, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    c = decontaminate.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest")
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", longest)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
d1 AS (SELECT doc_id, item_id, i - s AS diag, i, n FROM m JOIN (SELECT item_id, n, win, i AS s FROM (SELECT item_id, least(13, len(ws)) AS n, i, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
   FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0))) x USING (item_id, n) JOIN dw USING (doc_id, i, n) WHERE x.win = dw.win),
g AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, max(i + n) - min(i) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS run FROM d1) GROUP BY doc_id, item_id, diag, run) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(longest, 0) AS longest
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)"""


def op10_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    e = bpe.encode_decode(table(spark, d, "documents"), RANKS, PATTERN)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


BLANKS = r"[\x20\x09-\x0D]+"


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Documents whose text is made periodic from word ``a`` on, with period ``p``, where ten divides the crc32 ``h`` of the id; the other texts unchanged."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ws = F.filter(F.split("text", BLANKS, -1), lambda w: w != "")
    hit = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, ws).alias("ws"))
    hit = hit.select("*", F.size("ws").cast("long").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    a = F.pmod(F.col("g"), F.col("n"))
    hit = hit.select("*", F.when(F.col("n") > 0, a).cast("int").alias("a"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))
    hit = hit.select("*", p.cast("int").alias("p"))
    times = (F.floor((F.col("n") - F.col("a")) / F.col("p")) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    made = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    return hit.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    r = periodic.periodic_runs(repeat_tails(table(spark, d, "documents")))
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("k"), x["start"].alias("start"), x["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    length = -F.col("best.k")
    return r.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                    F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII expression as SQL: the bits of each character go through the register one at a time."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), CAST(4294967295 AS BIGINT))"


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {sql_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % len(ws) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t0 AS (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM p),
src AS (SELECT doc_id, unnest(range(n)) AS j, h % 10 = 0 AS made, a, p FROM p),
t AS (SELECT s.doc_id, j, word FROM src s JOIN t0 ON t0.doc_id = s.doc_id AND t0.i = CASE WHEN made AND j >= a THEN a + (j - a) % p ELSE j END),
g AS (SELECT doc_id, j, md5(concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w, lead(word, 5) OVER w)) AS gram,
  lead(word, 5) OVER w IS NOT NULL AS whole FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
same AS (SELECT x.doc_id, x.j, y.j - x.j AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.j < y.j AND x.whole AND y.whole),
isl AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS k FROM same),
ext AS (SELECT doc_id, q, min(j) AS s, max(j) + 6 + q AS e FROM isl GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM ext WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, q) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM runs) WHERE k = 1),
list AS (SELECT doc_id, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS l FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS j FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS l FROM t ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(c, 0) AS n_runs, s AS start, n AS length, q AS period, 1000 * n // q AS exponent_milli, sha256(coalesce(list.l, '')) AS runs_sha256, sha256(coalesce(kept.l, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN list USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def slip(doc_id, words: list[bytes]) -> list[bytes]:
    """Words of a document with a letter left out wherever 31 divides the crc32 of ``id:word``; words too short to count are left as they are."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = []
    for w in words:
        if len(w) >= variants.LEAST:
            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
        out.append(w)
    return out


def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    words = variants.count_words(table(spark, d, "documents"), slip=slip).filter("n >= 2")
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


_UTF8_BITS = """flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
 ELSE [CAST(195 AS BIGINT), 0, 0, 0, 0, 0, 0, 0, ord(c) - 64, 0, 0, 0, 0, 0, 0, 0] END))"""

OP12_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
h AS (SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_UTF8_BITS}), lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT doc_id, w, count(*) AS c FROM r WHERE length(w) >= 7 GROUP BY doc_id, w)),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT * FROM (SELECT near.word, other, w.n, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS k, count(*) OVER (PARTITION BY near.word) AS c FROM near JOIN words w ON w.word = other) WHERE k = 1),
f AS (SELECT words.word, words.n, coalesce(c, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN other END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS depth FROM f UNION ALL SELECT walk.word, f.form, depth + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, depth) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def op13_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = exact.exact_duplicates(table(spark, d, "documents"))
    return e.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""

QUERIES = {f.__name__: f for f in (op1_language_mixture, op2_quality_pu, op3_simhash, op4_chat_paths, op5_phrase_automata, op6_line_windows, op7_secret_scan, op8_top_k, op9_decontaminate, op10_byte_bpe, op11_periodic_runs, op12_spelling_variants, op13_exact_dedup)}
ORACLES = {"op4_chat_paths": OP4_SQL, "op5_phrase_automata": OP5_SQL, "op6_line_windows": OP6_SQL, "op8_top_k": OP8_SQL, "op9_decontaminate": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_dedup": OP13_SQL}
