"""Joins between printed text and the name dictionary: static ladder, fuzzy top-k, nearest name, similarity joins."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X
from ..functions.similarity import confusion_explain, confusion_score, indel_ratio, indel_ratio_one
from ..runtime import durable, shuffled
from .dictionary import NameDictionary
from .phrases import find_phrases  # noqa: F401  (part of this module's interface)
from .segment import word_windows

POOL_NAMES = 4_096            # names of one block, on average
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUGGEST_FLOOR, POOL_LIMIT, POOL_CUTOFF = 0.55, 40, 45.0
NEAR_EDITS, SHORTER = 3, 1 << 10  # letters that a near name may differ by; most ways to leave letters out of a key
DENSE_PAIRS = 1 << 14         # a block (label, photo) of at most so many pairs is compared pair by pair


# ---------------------------------------------------------------------------------------------------
# Exact layers

def static_ladder(texts: DataFrame, d: NameDictionary) -> DataFrame:
    """texts(raw, distinct) -> raw, layer, inci_name, category, cas, ec, source, notes for the texts that match.

    Readings of a text are tried in order - as printed, without parentheses, the name in the last parentheses - each by
    exact name then alias, then the parts of a slash synonym, then the recognised classes.
    """
    base = X.strip_nano(F.col("raw"))
    plain = X.strip_parens(base)
    keys = F.filter(F.array(X.fold_key(base), X.fold_key(plain), X.fold_key(X.inner_parens(base))), lambda k: k != "")
    slash = F.when(base.contains("/"), F.transform(F.split(base, "/"), lambda p: X.fold_key(p))).otherwise(F.array().cast("array<string>"))
    t = texts.select("raw", F.coalesce(X.classify_category(base), X.classify_category(plain)).alias("class"),
                     F.array_distinct(keys).alias("ks"), slash.alias("sl"))
    t = t.select("raw", "class", F.size("ks").alias("n"), F.posexplode_outer(F.concat("ks", "sl")).alias("pos", "key"))
    lk = d.materialised().lookup.select("key", F.struct("layer", "inci_name", "kind", F.col("category").alias("cat"), "cas", "ec", "source").alias("hit"))
    best = (t.join(lk, "key", "left").groupBy("raw")
            .agg(F.min_by(F.struct("hit", (F.col("pos") >= F.col("n")).alias("slash")), F.when(F.col("hit").isNotNull(), F.col("pos"))).alias("m"),
                 F.first("class").alias("class")))
    hit, via_slash = F.col("m.hit"), F.col("m.slash")
    note = (F.when(hit.isNull(), F.lit(X.CATEGORY_NOTE)).when(via_slash, F.lit("Matched through a slash synonym."))
            .when(hit["layer"] == "inci_alias", F.concat(F.lit("Matched through a "), F.replace(hit["kind"], F.lit("_"), F.lit(" ")), F.lit(" alias."))))
    return (best.where(hit.isNotNull() | F.col("class").isNotNull())
            .select("raw",
                    F.when(hit.isNull(), "category_recognized").when(via_slash, "inci_alias").otherwise(hit["layer"]).alias("layer"),
                    hit["inci_name"].alias("inci_name"), F.when(hit.isNull(), F.col("class")).otherwise(hit["cat"]).alias("category"),
                    hit["cas"].alias("cas"), hit["ec"].alias("ec"), hit["source"].alias("source"),
                    F.array_compact(F.array(note)).alias("notes")))


# ---------------------------------------------------------------------------------------------------
# Fuzzy top-k

def fuzzy_key(text: Column) -> Column:
    """Key a text is compared by: without parentheses (unless nothing is left) and the nano mark."""
    plain = X.strip_parens(text)
    return X.fold_key(X.strip_nano(F.when(plain == "", text).otherwise(plain)))


def letter_profile(c: Column) -> list[Column]:
    """Letter counts of a string as three bit maps (nine buckets of seven unary levels each; the last bucket holds all that is
    not A-Z) and the number of letters beyond seven of a kind.

    ``bit_count`` of two maps' common bits, plus the smaller excess, bounds the letters that two strings share from above.
    """
    count = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    count.append(F.length(c) - sum(count, F.lit(0)))
    unary = [F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(7))) - 1 for n in count]
    maps = [sum((F.shiftleft(unary[9 * m + i], 7 * i) for i in range(9)), F.lit(0).cast("long")).alias(f"m{m}") for m in range(3)]
    return [*maps, sum((F.greatest(n - 7, F.lit(0)) for n in count), F.lit(0)).alias("over")]


def length_band(n: Column) -> Column:
    """Bands of a quarter octave; a longer string is never in a lower band."""
    return F.floor(F.log2(n) * 4).cast("int")


def pool_floors(keys: DataFrame, names: DataFrame, cutoff: float, limit: int, parts: int) -> DataFrame:
    """(key, floor): the ``limit``-th best ratio among names that share one of the key's rarest trigrams, where there are so many.

    Any ``limit`` names give a true lower bound of the final ``limit``-th best, so which grams are asked decides work, not results:
    a key's grams are taken from the rarest on until they list four pools of names.
    """
    posts = names.select(F.col("key").alias("cand_key"), F.explode(trigrams(F.col("key"))).alias("g"))
    freq = posts.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") <= 32 * limit)
    w = Window.partitionBy("key").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = keys.select("key", F.explode(trigrams(F.col("key"))).alias("g")).join(freq, "g")
    asked = asked.withColumn("before", F.sum("df").over(w) - F.col("df")).where(F.col("before") < 4 * limit).select("key", "g")
    # one shuffle by key serves the distinct pairs and the lists; its stated width keeps small but costly pairs from being coalesced
    rated = asked.join(posts, "g").select("key", "cand_key").repartition(parts, "key").distinct().withColumn("ratio", indel_ratio("key", "cand_key"))
    top = rated.groupBy("key").agg(F.sort_array(F.collect_list("ratio"), asc=False).alias("r"))  # at most 36 pools of numbers
    return top.select("key", F.get("r", F.lit(limit - 1)).alias("floor")).where(F.col("floor") > cutoff)


def shortened(keys: DataFrame, col: str, out: dict[int, list[int]]) -> DataFrame:
    """(col, h): a hash of every string that ``out[length]`` letters less leave of a key; at most a few thousand a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, len(b), 256):
                part = b.slice(first, 256)
                at, left = [], []
                for row, k in enumerate(part.column(0).to_pylist()):
                    for n in out.get(len(k), ()):
                        some = {"".join(x) for x in combinations(k, len(k) - n)}
                        at += [row] * len(some)
                        left += some
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(left, pa.string())], [col, "v"])
    return keys.select(F.col("key").alias(col)).mapInArrow(run, f"{col} string, v string").select(col, F.xxhash64("v").alias("h"))


def near_names(keys: DataFrame, names: DataFrame, cutoff: float, limit: int, edits: int) -> tuple[DataFrame, DataFrame]:
    """keys(key), names(key), both distinct -> (key, cand_key, pool_pos) of the keys whose pool is settled by names that differ by at most
    ``edits`` letters left out or put in, and the keys that are open.

    Two strings d letters apart have a string in common that the one has i and the other d - i letters more than, so they meet on it by a plain
    join. A name that is not met is more letters apart, which bounds its ratio; a key is settled if its ``limit``-th best is above that bound, or
    if the bound is below the cutoff. Only lengths that both sides have are asked, and a key that can be shortened in too many ways takes fewer letters.
    """
    sizes = lambda d: sorted(r[0] for r in d.select(F.length("key")).distinct().collect())
    key_sizes, name_sizes = sizes(keys), sizes(names)
    key_out, name_out, bound = {a: set() for a in key_sizes}, {b: set() for b in name_sizes}, {}
    for a in key_sizes:
        ways = lambda e: [(b, i, i + b - a) for b in name_sizes for i in range(min(e, a) + 1) if 0 <= i + b - a <= min(e - i, b)]
        most = max(e for e in range(edits + 1) if e == 0 or all(comb(a, i) <= SHORTER and comb(b, j) <= SHORTER for b, i, j in ways(e)))
        for b, i, j in ways(most):
            key_out[a].add(i)
            name_out[b].add(j)
        bound[a] = 100.0 - 100.0 * (most + 1) / (a + min(a + most + 1, name_sizes[-1]))
    if not bound or not name_sizes:
        return keys.select("key", F.col("key").alias("cand_key"), F.lit(0).alias("pool_pos")).where("false"), keys
    met = shortened(keys, "key", {a: sorted(x) for a, x in key_out.items()}).join(shuffled(shortened(names, "cand_key", {b: sorted(x) for b, x in name_out.items()})), "h")
    rated = met.select("key", "cand_key").distinct().withColumn("ratio", indel_ratio("key", "cand_key")).where(F.col("ratio") >= cutoff)
    w = Window.partitionBy("key").orderBy(F.desc("ratio"), "cand_key")
    top = durable(rated.withColumn("pool_pos", (F.row_number().over(w) - 1).cast("int")).where(F.col("pool_pos") < limit))
    beyond = F.element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.length("key")) + 1e-9
    full = top.where((F.col("pool_pos") == limit - 1) & (F.col("ratio") > beyond)).select("key")
    done = top.where(beyond < cutoff).unionByName(top.where(beyond >= cutoff).join(shuffled(full), "key", "left_semi"))
    return done.select("key", "cand_key", "pool_pos"), keys.where(beyond >= cutoff).join(shuffled(full), "key", "left_anti")


def reaching(keys: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """The keys with letters that can reach the cutoff with some name's: asked once for keys, and names, of the same letters."""
    side = lambda d: d.select("key", F.length("key").alias("n"), *letter_profile(F.col("key")))
    of = ["n", "m0", "m1", "m2", "over"]
    k, r = side(keys), side(names).select(*of).distinct().alias("r")
    l = k.select(*of).distinct().alias("l")
    shared = sum((F.bit_count(F.col(f"l.m{m}").bitwiseAND(F.col(f"r.m{m}"))) for m in range(3)), F.least("l.over", "r.over"))
    able = 200.0 * F.least(shared, F.col("l.n"), F.col("r.n")) / (F.col("l.n") + F.col("r.n")) >= cutoff
    return k.join(shuffled(l.join(r, able, "left_semi")), of, "left_semi").select("key")


def name_pool(keys: DataFrame, corpus_keys: DataFrame, cutoff: float = POOL_CUTOFF, limit: int = POOL_LIMIT, block: int = POOL_NAMES, near: int = 0) -> DataFrame:
    """For each distinct key the ``limit`` names of best Indel ratio (>= cutoff), exactly; (key, cand_key, pool_pos).

    Two rounds.  The first gives each key a floor: what its ``limit`` best among a few near names reach.  In the second, names stand in
    length bands cut into blocks of about ``block`` names, a key goes to the bands that its floor allows (a ratio r bounds the quotient
    of the lengths by r / (200 - r)), and the join's condition compares letter counts by bit maps.  Both bounds are exact.  Only pairs
    that could reach the floor leave the join and are rated.  The shuffles are Spark's: a small dictionary is broadcast by
    its measured size, a large one meets the keys on (band, block).  With ``near``, for pools of a few names, keys are first settled by names
    that differ by at most so many letters (``near_names``), and keys whose letters no name has go before they meet any; only the rest
    takes the two rounds.
    """
    spark = keys.sparkSession
    names = corpus_keys.select("key").where(F.length("key") > 0).distinct()
    n = names.count()
    blocks, parts = -(-n // block) or 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select("key").where(F.length("key") > 0).distinct()
    settled = None
    if n > 8 * limit and near:
        settled, asked = near_names(durable(asked), durable(names), cutoff, limit, near)
        asked = reaching(asked, names, cutoff)
    if n > 8 * limit:  # else a floor costs more than it saves
        asked = durable(asked)
        asked = asked.join(pool_floors(asked, names, cutoff, limit, parts), "key", "left").withColumn("floor", F.coalesce("floor", F.lit(cutoff)))
    else:
        asked = asked.withColumn("floor", F.lit(cutoff))
    asked = asked.repartition(parts, "key")
    a, q = F.length("key"), F.col("floor") / (200 - F.col("floor"))
    bands = F.sequence(length_band(F.greatest(F.floor(a * q) - 1, F.lit(1))), length_band(F.ceil(a / q) + 1))
    left = asked.select("key", "floor", *letter_profile(F.col("key"))).select("*", F.explode(bands).alias("band"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = names.select(F.col("key").alias("cand_key"), *letter_profile(F.col("key")), length_band(F.length("key")).alias("band"),
                         F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    l, r = left.alias("l"), right.alias("r")
    shared = sum((F.bit_count(F.col(f"l.m{m}").bitwiseAND(F.col(f"r.m{m}"))) for m in range(3)), F.least("l.over", "r.over"))
    able = 200.0 * shared / (F.length("l.key") + F.length("r.cand_key")) >= F.col("l.floor")
    met = l.join(r, (F.col("l.band") == F.col("r.band")) & (F.col("l.block") == F.col("r.block")) & able)
    found = met.select("key", "cand_key", "floor").withColumn("ratio", indel_ratio("key", "cand_key")).where(F.col("ratio") >= F.col("floor"))
    w = Window.partitionBy("key").orderBy(F.desc("ratio"), "cand_key")
    best = (found.withColumn("pool_pos", (F.row_number().over(w) - 1).cast("int")).where(F.col("pool_pos") < limit)
            .select("key", "cand_key", "pool_pos"))
    return best if settled is None else settled.unionByName(best)


def fuzzy_topk(keys: DataFrame, d: NameDictionary, limit: int = 3, floor: float = SUGGEST_FLOOR, block: int = POOL_NAMES) -> DataFrame:
    """keys(key, distinct) -> (key, cands) with up to ``limit`` candidates (inci_name, score, edits, unexplained), best first.

    Cheap ratio pool, glyph-aware score on the pool, best key per name, rank by score step, last-word prior, score, name;
    the readable edits are worked out for the finalists only.
    """
    d = d.materialised()
    usable = keys.select("key").where(F.length("key").between(3, 60))
    pool = name_pool(usable, d.corpus, block=block)
    corpus = d.corpus.select(F.col("key").alias("cand_key"), "inci_name", "prior")
    scored = pool.withColumn("score", confusion_score("key", "cand_key")).where(F.col("score") >= floor).join(corpus, "cand_key")
    # at most one pool (40 rows) per key is gathered
    per_key = scored.groupBy("key").agg(F.array_sort(F.collect_list(
        F.struct("inci_name", (-F.col("score")).alias("neg"), "pool_pos", "cand_key", "prior"))).alias("p"))
    best = F.filter("p", lambda x, i: (i == 0) | (F.get("p", F.greatest(i - 1, F.lit(0)))["inci_name"] != x["inci_name"]))
    ranked = F.array_sort(F.transform(best, lambda x: F.struct(
        (-F.rint(-x["neg"] / 0.005)).alias("step"), (-x["prior"]).alias("np"), x["neg"].alias("neg"), x["inci_name"].alias("inci_name"), x["cand_key"].alias("cand_key"))))
    finals = per_key.select("key", F.explode(F.slice(ranked, 1, limit)).alias("r")).select("key", "r.*")
    finals = finals.withColumn("e", confusion_explain("key", "cand_key"))
    cand = F.struct((-F.rint(F.col("e.score") / 0.005)).alias("step"), "np", (-F.col("e.score")).alias("neg"), "inci_name",
                    F.col("e.edits").alias("edits"), F.col("e.unexplained").alias("unexplained"))
    return (finals.groupBy("key").agg(F.array_sort(F.collect_list(cand)).alias("c"))
            .select("key", F.transform("c", lambda x: F.struct(x["inci_name"].alias("inci_name"), (-x["neg"]).alias("score"),
                                                               x["edits"].alias("edits"), x["unexplained"].alias("unexplained"))).alias("cands")))


@F.pandas_udf(T.StringType())
def _swapped_word(printed: pd.Series, named: pd.Series) -> pd.Series:
    def one(p, n):
        if p is None or n is None:
            return None
        return next((f"{w}|{c}" for w in p for c in n if indel_ratio_one(w, c) < 90), None)
    return pd.Series([one(p, n) for p, n in zip(printed, named)], dtype=object)


def word_swap_notes(pairs: DataFrame, d: NameDictionary) -> DataFrame:
    """pairs(text, inci_name) -> note where a whole printed word and a whole name word are both known but different words."""
    words = lambda c: F.regexp_extract_all(F.upper(c), F.lit("([A-Z0-9]{3,})"), 1)
    p = pairs.select("text", "inci_name").distinct()
    tw, cw = words(X.strip_parens(F.col("text"))), words(F.col("inci_name"))
    long4 = lambda a: F.filter(a, lambda w: F.length(w) >= 4)
    p = p.select("text", "inci_name", long4(F.array_except(tw, cw)).alias("tw"), long4(F.array_except(cw, tw)).alias("cw")).where("size(tw) > 0 AND size(cw) > 0")
    known = (p.select("text", "inci_name", "cw", F.posexplode("tw").alias("o", "word")).join(d.vocabulary, "word", "left_semi")
             .groupBy("text", "inci_name").agg(F.first("cw").alias("cw"), F.array_sort(F.collect_list(F.struct("o", "word"))).alias("k")))
    sw = known.withColumn("sw", _swapped_word(F.col("k.word"), F.col("cw"))).where("sw IS NOT NULL")
    w, c = F.split_part("sw", F.lit("|"), F.lit(1)), F.split_part("sw", F.lit("|"), F.lit(2))
    return sw.select("text", "inci_name", F.concat(
        F.lit("Printed '"), X.title_case(w), F.lit("' is a different ingredient word from '"), X.title_case(c),
        F.lit("'. This may be a different ingredient, not a misspelling: check the pack.")).alias("note"))


# ---------------------------------------------------------------------------------------------------
# Nearest name by shared trigrams and edit similarity

def trigrams(c: Column) -> Column:
    starts = F.when(F.length(c) >= 3, F.sequence(F.lit(1), F.length(c) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(3))))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def nearest_name(texts: DataFrame, names: DataFrame, min_sim: float = 0.6, text_col: str = "text", name_col: str = "inci_name") -> DataFrame:
    """texts(text) -> (text, name, sim): the name of best edit similarity among those sharing enough trigrams.

    Texts are scored once per distinct key.  A key must share max(2, 35%) of its trigrams, so it shares at least one of
    all but its ``need - 1`` most common ones: only those rarest trigrams are joined, and the row of the first shared
    one is kept, so a pair is produced once and the common trigrams never meet.
    """
    n = names.select(F.col(name_col).alias("name")).distinct().withColumn("nk", X.match_key(F.col("name"), False)).withColumn("ng", trigrams(F.col("nk")))
    gram_df = n.select(F.explode("ng").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    keys = texts.select(X.match_key(F.col(text_col), False).alias("k")).where(F.length("k") >= 4).distinct()
    k = keys.withColumn("kg", trigrams(F.col("k"))).withColumn("need", F.greatest(F.lit(2), F.floor(F.size("kg") * 0.35).cast("int")))
    # grams unknown to every name cannot be shared: rank the known ones by rarity
    known = (k.select("k", "need", F.size("kg").alias("tot"), F.explode("kg").alias("g")).join(gram_df, "g")
             .groupBy("k").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs")))
    known = known.where(F.size("gs") >= F.col("need")).select("k", "need", F.col("gs.g").alias("gs"))
    probe = known.select("k", "need", "gs", F.explode(F.slice("gs", 1, F.size("gs") - F.col("need") + 1)).alias("g"))
    post = n.select("name", "nk", "ng", F.explode("ng").alias("g"))
    max_d = F.floor((1 - F.lit(min_sim)) * F.greatest(F.length("k"), F.length("nk"))).cast("int")
    pairs = (probe.join(post, "g").where((F.abs(F.length("k") - F.length("nk")) <= max_d))
             .where(F.element_at(F.array_intersect("gs", "ng"), 1) == F.col("g"))
             .where(F.size(F.array_intersect("gs", "ng")) >= F.col("need"))
             .withColumn("sim", edit_similarity(F.col("k"), F.col("nk"))).where((F.col("sim") >= min_sim - 1e-12) & (F.levenshtein("k", "nk") <= max_d)))
    best = pairs.groupBy("k").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "name")).alias("b")).select("k", F.col("b.name").alias("name"), (-F.col("b.neg")).alias("sim"))
    out = texts.withColumn("k", X.match_key(F.col(text_col), False))
    return out.join(best, "k", "left").drop("k")


# ---------------------------------------------------------------------------------------------------
# Edit-similarity join by matching segments: exact, no cross product

def _segments_of(n: Column, parts: Column) -> Column:
    """(start, length) of an even partition of n characters into ``parts`` segments (the longer ones last)."""
    short = F.floor(n / parts).cast("int")
    extra = (n - short * parts).cast("int")
    def seg(i):
        late = F.greatest(F.lit(0), i - (parts - extra))
        return F.struct(i.alias("i"), (i * short + late + 1).cast("int").alias("p"), (short + F.when(i >= parts - extra, 1).otherwise(0)).cast("int").alias("l"))
    return F.transform(F.sequence(F.lit(0), parts - 1), seg)


def block_pairs(left: DataFrame, right: DataFrame, block: list[str], most: int = DENSE_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left(block..., a), right(block..., b) -> all pairs (block..., a, b) of the blocks that have at most ``most``, and what is left of both
    sides: the larger blocks, for which the caller has a join by content.

    A row of either side is shuffled once, where a join by content shuffles every piece of it.
    """
    # one stated shuffle, which Spark reuses for all three results
    both = left.select(*block, "a").unionByName(right.select(*block, "b"), allowMissingColumns=True).dropna(subset=list(block)).repartition(*block)
    w = Window.partitionBy(*block)
    both = both.withColumn("n_pairs", F.count("a").over(w) * F.count("b").over(w)).where("n_pairs > 0")
    g = both.where(F.col("n_pairs") <= most).groupBy(*block).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    pairs = g.select(*block, F.explode("a").alias("a"), "b").select(*block, "a", F.explode("b").alias("b"))
    rest = both.where(F.col("n_pairs") > most)
    return pairs, rest.where("a IS NOT NULL").select(*block, "a"), rest.where("b IS NOT NULL").select(*block, "b")


def similar_pairs(left: DataFrame, right: DataFrame, min_sim: float, block: list[str] = (), most: int = DENSE_PAIRS) -> DataFrame:
    """Pairs of distinct keys with 1 - levenshtein/longest >= min_sim, within the same ``block`` values.

    left(block..., k), right(block..., k), both distinct.  With at most D edits between two strings, one of D+1 segments of
    the shorter string stands unchanged in the longer one near its old place.  Segments are the equi-join key; the edit
    distance is computed only for pairs that meet.  Both directions (which side is shorter) are joined and united.
    Blocks of at most ``most`` pairs are compared pair by pair instead; the segments of their keys would be more rows.
    """
    block = list(block)
    if block:
        side = lambda d, c: d.where(F.length("k") > 0).select(*block, F.col("k").alias(c))
        dense, left, right = block_pairs(side(left, "a"), side(right, "b"), block, most)
        longest = F.greatest(F.length("a"), F.length("b"))
        able = F.floor((1 - min_sim) * longest + 1e-9).cast("int")
        dense = dense.withColumn("able", able).where(F.abs(F.length("a") - F.length("b")) <= F.col("able")).withColumn("edits", F.expr("levenshtein(a, b, able)")).where("edits >= 0")
        dense = dense.select(*block, F.col("a").alias("left_key"), F.col("b").alias("right_key"), (1 - F.col("edits") / longest).alias("sim")).where(F.col("sim") >= min_sim - 1e-12)
        left, right = left.withColumnRenamed("a", "k"), right.withColumnRenamed("b", "k")

    def one_way(longer: DataFrame, shorter: DataFrame, strict: bool) -> DataFrame:
        n = F.length("k")
        # largest edit count any admissible partner of this length allows
        reach = F.floor((1 - min_sim) * F.floor(n / min_sim + 1e-9) + 1e-9).cast("int")
        index = (shorter.where(n > 0).select(*block, F.col("k").alias("sk"), F.explode(_segments_of(n, F.least(reach + 1, n))).alias("s"))
                 .select(*block, "sk", F.length("sk").alias("n"), F.col("s.i").alias("i"), F.expr("substr(sk, s.p, s.l)").alias("seg")))
        m = F.length("k")
        d = F.floor((1 - min_sim) * m + 1e-9).cast("int")
        lens = F.sequence(F.greatest(F.lit(1), F.ceil(m * min_sim - 1e-9).cast("int")), m - (1 if strict else 0))
        lens = F.when(m - (1 if strict else 0) >= F.greatest(F.lit(1), F.ceil(m * min_sim - 1e-9).cast("int")), lens).otherwise(F.array().cast("array<int>"))

        def probes(ln):
            gap = m - ln
            r = F.floor((1 - min_sim) * F.floor(ln / min_sim + 1e-9) + 1e-9).cast("int")
            lo, hi = F.floor((d - gap) / 2).cast("int"), F.floor((d + gap) / 2).cast("int")
            def of(s):
                first, last = F.greatest(F.lit(1), s["p"] - lo), F.least(m - s["l"] + 1, s["p"] + hi)
                at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
                return F.transform(at, lambda p: F.struct(ln.alias("n"), s["i"].alias("i"), F.substr("k", p, s["l"]).alias("seg")))
            return F.flatten(F.transform(_segments_of(ln, F.least(r + 1, ln)), of))

        probe = (longer.where(m > 0).select(*block, "k", F.explode(F.array_distinct(F.flatten(F.transform(lens, probes)))).alias("t"))
                 .select(*block, "k", "t.n", "t.i", "t.seg"))
        pairs = probe.join(shuffled(index), [*block, "n", "i", "seg"]).select(*block, "k", "sk").distinct()
        sim = edit_similarity(F.col("k"), F.col("sk"))
        return pairs.withColumn("sim", sim).where(F.col("sim") >= min_sim - 1e-12)

    down = one_way(left, right, False).select(*block, F.col("k").alias("left_key"), F.col("sk").alias("right_key"), "sim")
    up = one_way(right, left, True).select(*block, F.col("sk").alias("left_key"), F.col("k").alias("right_key"), "sim")
    far = down.unionByName(up)
    return dense.unionByName(far) if block else far


def one_edit_neighbours(words: DataFrame, vocabulary: DataFrame, col: str = "word") -> DataFrame:
    """(word, suggestion): vocabulary words one deletion, insertion, replacement or adjacent swap away.

    Both sides are joined on their deletion neighbourhoods (the word and every one-letter deletion), then verified.
    """
    def hood(df, name):
        w = F.col(name)
        cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        return df.select(name, F.explode(F.array_distinct(F.concat(F.array(w), cut))).alias("h"))
    a = hood(words.select(F.col(col).alias("word")).distinct(), "word")
    b = hood(vocabulary.select(F.col(vocabulary.columns[0]).alias("suggestion")).distinct(), "suggestion")
    p = a.join(b, "h").select("word", "suggestion").where("word <> suggestion").distinct()
    i = F.array_position(F.transform(F.sequence(F.lit(1), F.length("word")), lambda x: F.substr("word", x, F.lit(1)) != F.substr("suggestion", x, F.lit(1))), F.lit(True)).cast("int")
    swap = F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1, F.lit(1)), F.substr("word", i, F.lit(1)), F.substr("word", i + 2))
    return p.where((F.levenshtein("word", "suggestion") == 1) | ((F.length("word") == F.length("suggestion")) & (swap == F.col("suggestion"))))


# ---------------------------------------------------------------------------------------------------
# Look-ups

def compound_lookup(names: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """names(text) against a compound snapshot(cid, name, cas): match, ambiguous (close names), not_found or unavailable."""
    t = names.select("text").distinct().where((F.length(X.fold_key(F.col("text"))) >= 4) & ~F.col("text").contains("?"))
    if snapshot is None:
        return t.select("text", F.lit("unavailable").alias("status"), F.lit(None).cast("long").alias("cid"), F.array().cast("array<string>").alias("names"))
    up = F.upper(X.strip(F.col("text")))
    keyed = snapshot.select(F.upper("name").alias("k"), "cid").unionByName(snapshot.where("cas IS NOT NULL").select(F.col("cas").alias("k"), "cid"))
    exact = t.withColumn("k", up).join(keyed.groupBy("k").agg(F.min("cid").alias("cid")), "k", "left").drop("k")
    # close names: Indel ratio of the keys >= 75, five best
    open_ = exact.where("cid IS NULL").select(up.alias("k")).distinct()
    fold = lambda c: X.fold_key(c, False)
    snap = snapshot.select(F.upper("name").alias("name")).distinct().withColumn("sk", fold(F.col("name"))).where("sk <> ''")
    pool = name_pool(open_.select(fold(F.col("k")).alias("key")).where("key <> ''").distinct(), snap.select(F.col("sk").alias("key")), cutoff=75.0, limit=5, near=NEAR_EDITS)
    close = open_.withColumn("key", fold(F.col("k"))).join(pool, "key").join(snap, F.col("cand_key") == F.col("sk"))
    w = Window.partitionBy("k").orderBy("pool_pos", "name")
    top = (close.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("k")
           .agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("n")).select("k", F.col("n.name").alias("names")))
    res = exact.withColumn("k", up).join(top, "k", "left")
    return res.select("text", F.when(F.col("cid").isNotNull(), "match").when(F.size("names") > 0, "ambiguous").otherwise("not_found").alias("status"),
                      "cid", F.when(F.col("cid").isNull(), F.coalesce("names", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("names"))


def search_names(queries: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """queries(query) -> up to ``limit`` names (<= 80 characters) containing all of its first three words.

    Names are indexed by their character trigrams (bigrams for two-letter words); a query probes with its rarest gram only,
    so a gram that most names hold is never the join key unless every gram of the query is that common.
    """
    words = F.slice(F.filter(F.regexp_extract_all(F.upper("query"), F.lit("([A-Za-z0-9]+)"), 1), lambda w: F.length(w) >= 2), 1, 3)
    q = queries.select("query").distinct().withColumn("ws", words).where("size(ws) > 0")
    def grams(c, size):
        at = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(c, i, F.lit(size)))
    n = names.select(F.col("inci_name").alias("name")).distinct().where(F.length("name") <= 80)
    posts = n.select("name", F.explode(F.array_distinct(F.concat(grams(F.upper("name"), 2), grams(F.upper("name"), 3)))).alias("g"))
    freq = posts.groupBy("g").agg(F.count("*").alias("df"))
    qg = q.select("query", "ws", F.explode(F.array_distinct(F.flatten(F.transform("ws", lambda w: F.when(F.length(w) == 2, F.array(w)).otherwise(grams(w, 3)))))).alias("g"))
    rare = qg.join(freq, "g", "left").groupBy("query").agg(F.first("ws").alias("ws"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r")).select("query", "ws", F.col("r.g").alias("g"))
    hit = rare.join(posts, "g").where(F.forall("ws", lambda w: F.contains(F.upper("name"), w)))
    toks = F.regexp_extract_all(F.upper("name"), F.lit("([A-Z0-9]+)"), 1)
    hit = hit.select("query", "name", (~F.forall("ws", lambda w: F.array_contains(toks, w))).alias("part"),
                     (~F.startswith(F.upper("name"), F.get("ws", F.lit(0)))).alias("inside"), F.length("name").alias("len"))
    w = Window.partitionBy("query").orderBy("part", "inside", "len", "name")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query", "rank", "name")


def lookup_by_cas(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries(cas) -> first name (in name order) of that CAS number."""
    n = names.where("cas IS NOT NULL").groupBy("cas").agg(F.min("inci_name").alias("inci_name"))
    return queries.join(n, "cas", "left")
