"""Tables read by OCR: segments from words, quality triage, junk trimming, consensus of passes, stitching of photos."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X
from ..runtime import durable, shuffled
from .matching import DENSE_PAIRS, block_pairs, edit_similarity, nearest_name, similar_pairs

# Calibrated photo and reading thresholds.
BLUR_MIN, GLARE_BLOB_MAX, GLARE_MAX_SHARE, WHITE_PAGE, LONG_SIDE_MIN, TEXT_HEIGHT_MIN = 40, 0.10, 0.5, 250, 300, 8
MIN_WORDS, MIN_COMMAS, MIN_CONF, MIN_WORD_HEIGHT = 8, 4, 60, 9
NAME_SIM, RAW_SIM, BETTER_BY, JUNK_CONF = 0.68, 0.75, 0.08, 55
MATCH_SIM, MIN_RUN = 0.75, 2


def plain_key(c: Column) -> Column:
    return X.fold_key(c, False)


def photo_prompts(blur: Column, glare_blob: Column, median_luma: Column, long_side: Column, text_height: Column) -> Column:
    """Array of prompts a photo needs: blur, glare, small text."""
    glare = (glare_blob > GLARE_BLOB_MAX) & (glare_blob < GLARE_MAX_SHARE) & (median_luma < WHITE_PAGE)
    small = (long_side < LONG_SIDE_MIN) | ((text_height > 0) & (text_height < TEXT_HEIGHT_MIN))
    return F.array_compact(F.array(F.when(blur < BLUR_MIN, F.lit("blur")), F.when(glare, F.lit("glare")), F.when(small, F.lit("small"))))


def readability(n_words: Column, n_commas: Column, mean_conf: Column, median_height: Column) -> Column:
    """First thing wrong with a reading: too_little_text, no_list, check_words; null when fine."""
    return (F.when(n_words < MIN_WORDS, "too_little_text").when(n_commas < MIN_COMMAS, "no_list")
            .when((mean_conf < MIN_CONF) | ((median_height > 0) & (median_height < MIN_WORD_HEIGHT)), "check_words"))


def reading_stats(words: DataFrame, by: str = "photo_id") -> DataFrame:
    """words(by, text, height, confidence) -> n_words, n_commas, mean_conf, median_height (the upper median, not interpolated).

    The median is found by ranking within a photo and keeping the middle row; no word list is gathered.
    """
    real = F.col("text").rlike("[A-Za-z]{3,}")
    agg = words.groupBy(by).agg(F.count_if(real).alias("n_words"), F.sum(F.regexp_count("text", F.lit(","))).alias("n_commas"), F.avg("confidence").alias("mean_conf"))
    w = Window.partitionBy(by).orderBy("height")
    mid = words.where(real).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(by))).where(F.col("i") == F.floor(F.col("n") / 2)).select(by, F.col("height").alias("median_height"))
    return agg.join(mid, by, "left").withColumn("median_height", F.coalesce("median_height", F.lit(0)))


def segments_from_words(words: DataFrame, by: list[str]) -> DataFrame:
    """words(by..., line, word_no, text, confidence) -> (by..., seg_no, text, conf, n_words): OCR lines to ingredient segments.

    A word ending in '-' at the end of a line takes the next line's first word.  Commas and semicolons outside parentheses
    end a segment; the bracket depth runs over the words of a photo.  Text up to an INGREDIENTS label among the first five
    words of the first segment is dropped.
    """
    w = Window.partitionBy(*by).orderBy("line", "word_no")
    line_end = F.coalesce(F.lead("line").over(w) != F.col("line"), F.lit(False))
    hyph = line_end & F.col("text").rlike("[A-Za-z]-$")
    d = words.withColumn("h", hyph).withColumn("nt", F.lead("text").over(w)).withColumn("taken", F.coalesce(F.lag("h").over(w), F.lit(False)))
    # a word that was taken by the line above gives its text away (and passes on what it takes itself)
    d = d.withColumn("t", F.when(F.col("taken"), "").when(F.col("h"), F.concat(F.expr("substr(text, 1, length(text) - 1)"), F.col("nt"))).otherwise(F.col("text"))).where("t <> ''")
    runs = F.regexp_extract_all("t", F.lit(r"([^(),;]+|[(),;])"), 1)
    d = d.select(*by, "line", "word_no", "confidence", F.posexplode(runs).alias("pos", "run"))
    o = Window.partitionBy(*by).orderBy("line", "word_no", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("run") == "(", 1).when(F.col("run") == ")", -1).otherwise(0)
    d = d.withColumn("s", F.sum(step).over(o)).withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(o)))
    sep = F.col("run").isin(",", ";") & (F.col("depth") == 0)
    d = d.withColumn("cut", sep).withColumn("seg", F.sum(sep.cast("int")).over(o)).where(~F.col("cut"))
    word = d.groupBy(*by, "seg", "line", "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "run"))), lambda x: x["run"]), "").alias("text"), F.max("confidence").alias("confidence"))
    # leading label of the first segment
    first = Window.partitionBy(*by)
    word = word.withColumn("first_seg", F.min("seg").over(first))
    ow = Window.partitionBy(*by, "seg").orderBy("line", "word_no")
    word = word.withColumn("wi", F.row_number().over(ow) - 1)
    is_label = (F.col("seg") == F.col("first_seg")) & (F.col("wi") <= 4) & F.col("text").rlike("(?i)^ingredients?:?$")
    word = word.withColumn("label_at", F.min(F.when(is_label, F.col("wi"))).over(Window.partitionBy(*by, "seg"))).where("label_at IS NULL OR wi > label_at")
    seg = word.groupBy(*by, "seg").agg(F.array_sort(F.collect_list(F.struct("wi", "text", "confidence"))).alias("ws"), F.avg("confidence").alias("conf"), F.count("*").alias("n_words"))
    seg = seg.select(*by, "seg", F.trim(F.regexp_replace(F.array_join(F.col("ws.text"), " "), r"\s+", " ")).alias("text"), "conf", "n_words").where("text <> ''")
    return seg.withColumn("seg_no", F.row_number().over(Window.partitionBy(*by).orderBy("seg")) - 1).drop("seg")


def trim_junk_prefix(segments: DataFrame, names: DataFrame) -> DataFrame:
    """segments(seg_id, words array<struct<text,confidence>>) -> (seg_id, dropped, text): leading unsure words that look like no name are
    dropped (at most eight, never all) when the rest reads clearly better.
    """
    s = segments.withColumn("n", F.size("words"))
    lead = s.select("seg_id", "n", F.posexplode(F.slice("words", 1, 8)).alias("i", "w")).where(F.col("i") < F.least(F.lit(8), F.col("n") - 1))
    near = nearest_name(lead.select(F.col("w.text").alias("text")).distinct(), names, 0.6).where("name IS NOT NULL").select("text", F.lit(True).alias("near"))
    lead = lead.select("seg_id", "i", F.col("w.text").alias("text"), F.col("w.confidence").alias("c")).join(near, "text", "left")
    stop = lead.where((F.col("c") >= JUNK_CONF) | F.col("near").isNotNull()).groupBy("seg_id").agg(F.min("i").alias("stop"))
    s = s.join(stop, "seg_id", "left").withColumn("k", F.coalesce("stop", F.greatest(F.lit(0), F.least(F.lit(8), F.col("n") - 1))).cast("int"))
    text = lambda ws: F.trim(F.regexp_replace(F.array_join(F.transform(ws, lambda w: w["text"]), " "), r"\s+", " "))
    s = s.withColumn("full", text(F.col("words"))).withColumn("rest", text(F.slice("words", F.col("k") + 1, F.greatest(F.col("n"), F.lit(1)))))
    s = durable(s.select("seg_id", "k", "full", "rest"))  # read three times below, and made from three readings of the segments
    both = s.where("k > 0").select(F.explode(F.array("full", "rest")).alias("text")).distinct()
    sims = nearest_name(both, names, 0.55).select("text", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    s = s.join(sims.select(F.col("text").alias("full"), F.col("sim").alias("before")), "full", "left").join(sims.select(F.col("text").alias("rest"), F.col("sim").alias("after")), "rest", "left")
    ok = (F.col("k") > 0) & (F.col("after") >= 0.8) & (F.col("after") > F.col("before"))
    return s.select("seg_id", F.when(ok, F.col("k")).otherwise(0).alias("dropped"), F.when(ok, F.col("rest")).otherwise(F.col("full")).alias("text"))


# ---------------------------------------------------------------------------------------------------
# Consensus of passes over one photo

def greedy_keep(pairs: DataFrame, by: list[str], most: int = 1 << 17) -> DataFrame:
    """pairs(by, better, worse) of one photo's keys, ``better`` before ``worse`` in the keys' order -> (by, worse, better): each key that goes,
    with the first kept key that takes it.

    Only a kept key takes another.  A photo's pairs are read in the order of ``worse``, so whether a better key is kept is known when it is
    asked; a task remembers the keys of one photo that go.  Photos of more than ``most`` pairs are settled by rounds of joins.
    """
    pairs = durable(pairs.select(*by, "better", "worse").distinct().withColumn("n", F.count("*").over(Window.partitionBy(*by))))
    few, many = pairs.where(F.col("n") <= most).drop("n"), pairs.where(F.col("n") > most).drop("n")
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        photo, gone = None, set()
        for b in batches:
            at, taker = [], []
            for i, (*key, better, worse) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if key != photo:
                    photo, gone = key, set()
                if worse not in gone and better not in gone:
                    gone.add(worse)
                    at.append(i)
                    taker.append(better)
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:k], rows.column(k + 1), pa.array(taker, b.schema.field(k).type)], [*by, "worse", "better"])
    kind = {f.name: f.dataType.simpleString() for f in few.schema}
    # the first kept key in the order of ``better`` is the best one; a key is settled before it is asked, since it is smaller
    settled = few.repartition(*by).sortWithinPartitions(*by, "worse", "better").mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in (*by, "worse", "better")))
    return settled if many.isEmpty() else settled.unionByName(greedy_rounds(many, by))


def greedy_rounds(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``greedy_keep`` by joins: a round keeps the keys that no open key is better than and takes what they are better than; rounds end when no
    pair is open, as many as the longest chain of keys."""
    # an identity map: a checkpoint passes on what Spark inferred about columns that are no longer there, and a union of such tables fails
    pairs = durable(pairs.mapInArrow(lambda batches: batches, pairs.schema))
    open_, gone = pairs, None
    while not open_.isEmpty():
        beaten = open_.select(*by, F.col("worse").alias("better")).distinct()
        out = durable(open_.join(shuffled(beaten), [*by, "better"], "left_anti").select(*by, "worse").distinct())
        gone = out if gone is None else gone.unionByName(out)
        open_ = durable(open_.join(shuffled(out), [*by, "worse"], "left_anti").join(shuffled(out.withColumnRenamed("worse", "better")), [*by, "better"], "left_anti"))
    if gone is None:
        return pairs.select(*by, "worse", "better")
    # which kept key takes it is only known once all are decided
    kept = pairs.join(shuffled(gone.withColumnRenamed("worse", "better")), [*by, "better"], "left_anti")
    return kept.join(shuffled(gone), [*by, "worse"], "left_semi").groupBy(*by, "worse").agg(F.min("better").alias("better"))


def cluster_readings(readings: DataFrame, raw_sim: float = RAW_SIM) -> DataFrame:
    """readings(photo_id, pass_id, idx, text, conf, name, sim) -> the same with ``cluster``.

    The k-th reading of a name in each pass joins cluster (name, k).  Unnamed readings join the smallest similar text that is a
    cluster's own, compared once per distinct text key of a photo by the segment join; the k-th reading of one cluster in a pass
    opens occurrence k, so a pass votes once per cluster.
    """
    named = readings.where("name IS NOT NULL").withColumn("base", F.concat(F.lit("n:"), "name"))
    raw = readings.where("name IS NULL").withColumn("k", plain_key(F.col("text")))
    keys = raw.where("k <> ''").select("photo_id", "k").distinct()
    pairs = similar_pairs(keys, keys, raw_sim, ["photo_id"]).where("left_key < right_key")
    near = greedy_keep(pairs.select("photo_id", F.col("left_key").alias("better"), F.col("right_key").alias("worse")), ["photo_id"]).select("photo_id", F.col("worse").alias("k"), F.col("better").alias("root"))
    raw = raw.join(shuffled(near), ["photo_id", "k"], "left").withColumn("base", F.concat(F.lit("r:"), F.coalesce("root", F.when(F.col("k") != "", F.col("k")), F.col("text")))).drop("k", "root")
    every = named.unionByName(raw)
    occ = F.row_number().over(Window.partitionBy("photo_id", "pass_id", "base").orderBy("idx"))
    return every.withColumn("cluster", F.concat("base", F.lit("#"), occ.cast("string"))).drop("base")


def base_pass(clustered: DataFrame) -> DataFrame:
    """(photo_id, pass_id): the pass with the most named clusters, then the higher mean confidence."""
    s = clustered.groupBy("photo_id", "pass_id").agg(F.count_distinct(F.when(F.col("name").isNotNull(), F.col("cluster"))).alias("named"), F.avg("conf").alias("conf"))
    s = s.withColumn("score", F.col("named") * 1000 + F.col("conf")).where("score IS NOT NULL")
    return s.groupBy("photo_id").agg(F.min_by("pass_id", F.struct(-F.col("score"), "pass_id")).alias("base_pass"))


def consensus(readings: DataFrame) -> DataFrame:
    """(photo_id, cluster, text, name, sim, conf, votes, from_, pos) kept items of each photo's consensus.

    The base pass leads; its reading stays when named, seen by three passes, or by two and read well; a reading of another
    pass that is clearly closer to a name replaces it; names (or three-vote texts) the base missed are added.  Items are
    placed by relative position, one per name, fragments inside longer kept readings and near-duplicates are dropped.
    """
    c = durable(cluster_readings(readings))
    n_in_pass = F.count("*").over(Window.partitionBy("photo_id", "pass_id"))
    c = c.withColumn("n", n_in_pass).withColumn("pos", F.when(F.col("n") > 1, F.col("idx") / (F.col("n") - 1)).otherwise(0.5))
    c = c.join(shuffled(base_pass(c)), "photo_id").withColumn("mine", F.col("pass_id") == F.col("base_pass"))
    row = F.struct("text", "conf", "name", "sim", "pass_id", "idx")
    best = F.min_by(row, F.struct((-F.col("sim")).alias("a"), (-F.col("conf")).alias("b"), F.col("pass_id"), F.col("idx")))
    g = c.groupBy("photo_id", "cluster").agg(
        F.count_distinct("pass_id").alias("votes"), best.alias("best"), F.max(F.when(F.col("mine"), row)).alias("own"),
        F.max(F.when(F.col("mine"), F.col("pos"))).alias("own_pos"), F.avg("pos").alias("avg_pos"))
    own, b = F.col("own"), F.col("best")
    keep = (own["sim"] >= NAME_SIM) | (F.col("votes") >= 3) | ((F.col("votes") >= 2) & (own["conf"] >= 55))
    better = (b["sim"] >= own["sim"] + BETTER_BY)
    named = F.col("cluster").startswith("n:")
    base_items = g.where(own.isNotNull() & keep).select("photo_id", "cluster", "votes", F.when(better, b).otherwise(own).alias("r"), F.when(better, "better").otherwise("base").alias("from_"), F.col("own_pos").alias("pos"))
    added = g.where(own.isNull() & (named | (F.col("votes") >= 3))).select("photo_id", "cluster", "votes", b.alias("r"), F.lit("added").alias("from_"), F.col("avg_pos").alias("pos"))
    have = base_items.where("r.name IS NOT NULL").select("photo_id", F.col("r.name").alias("hn")).distinct()
    added = added.join(shuffled(have), (added["photo_id"] == have["photo_id"]) & (F.col("r.name") == have["hn"]), "left_anti")
    it = base_items.unionByName(added).select("photo_id", "cluster", "votes", "from_", "pos", "r.text", "r.name", "r.sim", "r.conf")
    w = Window.partitionBy("photo_id", "name").orderBy(F.desc("sim"), F.desc("votes"), "pos")
    it = durable(it.withColumn("rn", F.row_number().over(w)).where("name IS NULL OR rn = 1").drop("rn").withColumn("k", plain_key(F.col("text"))))
    # an unnamed fragment inside a longer kept reading; in a photo of very many readings they share the fragment's first four characters, then
    # the reading contains it
    grams = lambda c, n: F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array(c))
    lone = it.where("name IS NULL AND k <> ''").select("photo_id", "k").distinct()
    within = (F.length("wk") > F.length("k")) & F.contains("wk", F.col("k"))
    dense, frag, whole = block_pairs(lone.withColumnRenamed("k", "a"), it.select("photo_id", F.col("k").alias("b")).distinct(), ["photo_id"])
    frag, whole = frag.select("photo_id", F.col("a").alias("k"), F.substring("a", 1, 4).alias("g")), whole.withColumnRenamed("b", "wk")
    posts = whole.select("photo_id", "wk", F.explode(grams(F.col("wk"), 4)).alias("g")).distinct()
    short = whole.select("photo_id", "wk", F.explode(F.array_distinct(F.concat(*[grams(F.col("wk"), n) for n in (1, 2, 3)]))).alias("g")).distinct()
    met = frag.where(F.length("k") >= 4).join(shuffled(posts), ["photo_id", "g"]).unionByName(frag.where(F.length("k") < 4).join(shuffled(short), ["photo_id", "g"])).select("photo_id", "k", "wk")
    inside = dense.select("photo_id", F.col("a").alias("k"), F.col("b").alias("wk")).unionByName(met).where(within).select("photo_id", "k").distinct()
    open_ = it.where("name IS NULL AND (k IS NULL OR k <> '')").join(shuffled(inside), ["photo_id", "k"], "left_anti")
    it = it.where("name IS NOT NULL").unionByName(open_)
    return drop_near_duplicates(durable(it))


def drop_near_duplicates(items: DataFrame) -> DataFrame:
    """Keep the better of two similar readings of one photo; only a reading that stays can drop another.

    Texts of one key are ranked first, so only distinct keys meet.
    """
    rank = [F.desc("sim"), F.desc("votes"), F.desc("conf"), F.col("pos"), F.col("cluster")]
    it = items.withColumn("q", F.row_number().over(Window.partitionBy("photo_id").orderBy(*rank)))
    keys = durable(it.groupBy("photo_id", "k").agg(F.min("q").alias("q"), F.min_by("name", "q").alias("name")).where("k <> ''"))
    ks = keys.select("photo_id", "k")
    pairs = similar_pairs(ks, ks, 0.72, ["photo_id"]).where("left_key <> right_key")
    side = lambda s: keys.select("photo_id", F.col("k").alias(f"{s}_key"), F.col("q").alias(f"{s}_q"), F.col("name").alias(f"{s}_name"))
    p = pairs.join(shuffled(side("left")), ["photo_id", "left_key"]).join(shuffled(side("right")), ["photo_id", "right_key"])
    different = F.col("left_name").isNotNull() & F.col("right_name").isNotNull() & (F.col("left_name") != F.col("right_name"))
    lost = p.where(((F.col("sim") >= 0.85) | ~different) & (F.col("left_q") > F.col("right_q"))).select("photo_id", F.col("right_q").alias("better"), F.col("left_q").alias("worse"))
    # one inside the other (six or more characters)
    six = keys.where(F.length("k") >= 6).select("photo_id", F.struct("k", "q", "name").alias("a"))
    dense, some, whole = block_pairs(six, six.withColumnRenamed("a", "b"), ["photo_id"])
    posts = whole.select("photo_id", "b", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("b.k") - 5), lambda i: F.substr("b.k", i, F.lit(6))))).alias("g"))
    met = some.withColumn("g", F.substring("a.k", 1, 6)).join(shuffled(posts), ["photo_id", "g"]).select("photo_id", "a", "b")
    apart = F.coalesce(F.col("a.name") != F.col("b.name"), F.lit(False))
    con = dense.unionByName(met).where((F.col("a.k") != F.col("b.k")) & F.contains("b.k", F.col("a.k")) & ~apart)
    lost2 = con.select("photo_id", F.least("a.q", "b.q").alias("better"), F.greatest("a.q", "b.q").alias("worse"))
    same = it.join(shuffled(keys.select("photo_id", "k", F.col("q").alias("kq"))), ["photo_id", "k"], "left").where("kq IS NULL OR q = kq").drop("kq")
    gone = greedy_keep(lost.unionByName(lost2), ["photo_id"]).select("photo_id", F.col("worse").alias("q"))
    return same.join(shuffled(gone), ["photo_id", "q"], "left_anti").drop("q", "k")


def fuse_passes(readings: DataFrame, min_sim: float = 0.7, drop_below: float = 45, min_votes: int = 2) -> DataFrame:
    """Consensus that knows no names: clusters by similarity, best-read text represents, unsure single readings are dropped."""
    r = readings.select("photo_id", "pass_id", "idx", "text", "conf").withColumn("name", F.lit(None).cast("string")).withColumn("sim", F.lit(0.0))
    c = cluster_readings(r, min_sim)
    n = F.count("*").over(Window.partitionBy("photo_id", "pass_id"))
    c = c.withColumn("n", n).withColumn("pos", F.when(F.col("n") > 1, F.col("idx") / (F.col("n") - 1)).otherwise(0.5))
    quality = F.col("conf") * F.least(F.lit(1.0), F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / 6)
    g = c.withColumn("quality", quality).groupBy("photo_id", "cluster").agg(
        F.min_by(F.struct("text", "conf"), F.struct((-F.col("quality")).alias("a"), "pass_id", "idx")).alias("rep"), F.count("*").alias("votes"), F.avg("pos").alias("pos"),
        (F.count_distinct("text") > 1).alias("conflict"))
    return g.where((F.col("rep.conf") >= drop_below) | (F.col("votes") >= min_votes)).select("photo_id", "cluster", "rep.text", "rep.conf", "votes", "pos", "conflict")


# ---------------------------------------------------------------------------------------------------
# Stitching photos that overlap

def rising_chain(matches) -> list[tuple[int, int]]:
    """Longest chain of a pair's matches (i, j) that rises in both lists, from its end; of equal chains the one that ends earliest."""
    m = sorted(set(matches))
    best: list[tuple[int, int]] = []  # length of the best chain that ends here, match before
    for n, (i, j) in enumerate(m):
        length, before = max(((best[p][0], -p) for p in range(n) if m[p][0] < i and m[p][1] < j), default=(0, 1))
        best.append((length + 1, -before))
    at = max(range(len(m)), key=lambda n: (best[n][0], -n), default=-1)
    out = []
    while at >= 0:
        out.append(m[at])
        at = best[at][1]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))
def longest_chain(matches: pd.Series) -> pd.Series:
    """``rising_chain`` of each row's matches."""
    return matches.map(lambda pairs: [{"i": i, "j": j} for i, j in rising_chain((p["i"], p["j"]) for p in pairs)])


def _joined(a: list[tuple], b: list[tuple], like) -> tuple[list[tuple[int, str]], bool]:
    """Two lists of (row, i, key, text, conf) in their order -> (row whose text and confidence stand, side) in the joined order, overlap."""
    def places(rows):
        out: dict[str, list[int]] = {}
        for _, i, k, *_ in rows:
            if k:
                out.setdefault(k, []).append(i)
        return out
    # one place per key and occurrence on each side keeps repeated names from multiplying
    other = places(b)
    m = {p for x, at in places(a).items() for y, to in other.items() if like(x, y) is not None for p in zip(at, to)}
    overlap = any((i + 1, j + 1) in m for i, j in m)
    chain = rising_chain(m) if overlap else []
    to_b, to_a = dict(chain), {j: i for i, j in chain}
    read = {j: (row, conf) for row, j, _, _, conf in b}
    out = []
    for row, i, _, text, conf in a:
        both = read[to_b[i]] if i in to_b else None
        surer = both is not None and both[1] is not None and conf is not None and both[1] > conf
        out.append((float(i), -1, text is not None, text, both[0] if surer else row, "a" if both is None else "both"))
    last, behind = max((i for _, i, *_ in a), default=-1), None
    for row, j, _, text, _ in b:
        if j in to_a:
            behind = to_a[j] if behind is None else max(behind, to_a[j])
            continue
        place = last + 1.0 if not overlap else -0.5 if behind is None else behind + 0.5
        out.append((place, j, text is not None, text, row, "b"))
    return [(x[4], x[5]) for x in sorted(out)], overlap


def stitch_overlaps(a: DataFrame, b: DataFrame, by: str = "product_id", most: int = DENSE_PAIRS) -> DataFrame:
    """a, b(by, i, text, conf) -> (by, ord, text, conf, side, overlap): two readings of one list joined at their overlap.

    A run of two or more matches (similarity >= .75) in a row accepts the overlap; then the longest chain of matches that
    rises in both lists is joined, so an item that one photo missed leaves no gap.  Matched places keep the better-read text; what
    only the second list has follows the match before it.  Without such a run the second list simply follows the first.
    One shuffle brings a product's two lists together and a task joins them as they pass; lists of more than ``most`` pairs or
    items are joined by ``stitch_wide`` instead.
    """
    from .stitch import similarity
    side = lambda d, n: d.select(by, F.lit(n).alias("s"), "i", "text", "conf")
    both = side(a, 0).unionByName(side(b, 1))
    large = both.groupBy(by).agg(F.count("*").alias("n"), F.sum("s").alias("nb")).where((F.col("n") > most) | (F.col("nb") * (F.col("n") - F.col("nb")) > most) | F.col(by).isNull()).select(by)
    few, wide = both, None
    if not large.isEmpty():
        few = both.where(F.col(by).isNotNull()).join(shuffled(large), by, "left_anti")
        wide = durable(both.join(shuffled(large), by, "left_semi").unionByName(both.where(F.col(by).isNull())))
    listed = few.repartition(by).sortWithinPartitions(by, "s", "i").select(by, "s", "i", "text", "conf", plain_key(F.col("text")).alias("k"))
    kind = {f.name: f.dataType.simpleString() for f in listed.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            key, s, i, text, conf, k = (c.to_pylist() for c in t.columns)
            rows = list(zip(range(len(key)), i, k, text, conf))
            at, number, sides, overlaps, first = [], [], [], [], 0
            while first < len(key):
                stop = first
                while stop < len(key) and key[stop] == key[first]:
                    stop += 1
                cut = first + sum(x == 0 for x in s[first:stop])
                out, overlap = _joined(rows[first:cut], rows[cut:stop], similarity)
                at += [row for row, _ in out]
                sides += [x for _, x in out]
                number += range(len(out))
                overlaps += [overlap] * len(out)
                first = stop
            t = t.take(pa.array(at, pa.int64())).combine_chunks()
            column = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)
            return pa.RecordBatch.from_arrays([column(by), pa.array(number, pa.int32()), column("text"), column("conf"), pa.array(sides, pa.string()), pa.array(overlaps, pa.bool_())],
                                              [by, "ord", "text", "conf", "side", "overlap"])
        held = None  # the last product of a batch may go on in the next
        for b in filter(len, batches):
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = t[by].to_pylist()
            cut = len(key) - 1
            while cut and key[cut - 1] == key[-1]:
                cut -= 1
            held = t.slice(cut)
            if cut:
                yield joined(t.slice(0, cut))
        if held is not None:
            yield joined(held)
    done = listed.mapInArrow(run, f"`{by}` {kind[by]}, ord int, text {kind['text']}, conf {kind['conf']}, side string, overlap boolean")
    return done if wide is None else done.unionByName(stitch_wide(wide.where("s = 0").drop("s"), wide.where("s = 1").drop("s"), by))


def stitch_wide(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """``stitch_overlaps`` by joins, for lists of very many items; a product's chain is worked out over its matches only."""
    ka, kb = a.withColumn("k", plain_key(F.col("text"))), b.withColumn("k", plain_key(F.col("text")))
    sim = similar_pairs(ka.where("k <> ''").select(by, "k").distinct(), kb.where("k <> ''").select(by, "k").distinct(), MATCH_SIM, [by])
    # one place per key and occurrence on each side keeps repeated names from multiplying
    occ = lambda d, s: d.withColumn("o", F.row_number().over(Window.partitionBy(by, "k").orderBy("i"))).select(by, F.col("k").alias(f"{s}_key"), F.col("i").alias(f"{s}_i"), "o")
    m = sim.join(occ(ka, "left"), [by, "left_key"]).join(occ(kb, "right"), [by, "right_key", "o"]).select(by, F.col("left_i").alias("i"), F.col("right_i").alias("j"))
    m = durable(m)
    run = m.withColumn("dg", F.col("i") - F.col("j")).withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(by, "dg").orderBy("i")))
    best = durable(run.groupBy(by, "dg", "run").agg(F.count("*").alias("n")).where(f"n >= {MIN_RUN}").select(by).distinct().withColumn("overlap", F.lit(True)))

    lists = m.join(best, by, "left_semi").groupBy(by).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("m"))
    pairs = durable(lists.select(by, F.explode(longest_chain("m")).alias("c")).select(by, "c.i", "c.j"))
    la = a.groupBy(by).agg(F.max("i").alias("last_a"))
    right = b.select(by, F.col("i").alias("j"), F.col("text").alias("tb"), F.col("conf").alias("cb")).join(pairs.withColumnRenamed("i", "at"), [by, "j"], "left")
    left = a.select(by, "i", F.col("text").alias("ta"), F.col("conf").alias("ca")).join(pairs, [by, "i"], "left").join(right.where("at IS NOT NULL").select(by, "j", "tb", "cb"), [by, "j"], "left")
    use_b = F.col("tb").isNotNull() & (F.col("cb") > F.col("ca"))
    out_a = left.select(by, F.col("i").cast("double").alias("place"), F.lit(-1).alias("t"), F.when(use_b, F.col("tb")).otherwise(F.col("ta")).alias("text"), F.when(use_b, F.col("cb")).otherwise(F.col("ca")).alias("conf"),
                        F.when(F.col("tb").isNotNull(), "both").otherwise("a").alias("side"))
    behind = F.max("at").over(Window.partitionBy(by).orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    only_b = right.withColumn("behind", behind).where("at IS NULL").join(best, by, "left").join(la, by, "left")
    place = F.when(F.col("overlap"), F.coalesce(F.col("behind") + 0.5, F.lit(-0.5))).otherwise(F.coalesce("last_a", F.lit(-1)) + 1.0)
    out_b = only_b.select(by, place.alias("place"), F.col("j").alias("t"), F.col("tb").alias("text"), F.col("cb").alias("conf"), F.lit("b").alias("side"))
    out = out_a.unionByName(out_b).join(best, by, "left")
    return out.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("place", "t", "text")) - 1).alias("ord"), "text", "conf", "side", F.coalesce("overlap", F.lit(False)).alias("overlap"))


def segment_provenance(segments: DataFrame, by: list[str]) -> DataFrame:
    """Contributing photos of a merged segment, whether readings conflict, whether its confidence is low (< 70)."""
    return segments.groupBy(*by).agg(F.count_distinct("photo_id").alias("n_photos"), (F.count_distinct("text") > 1).alias("conflict"), (F.max("conf") < 70).alias("low_confidence"))


def photo_confidence(words: DataFrame, by: list[str]) -> DataFrame:
    """Mean word confidence and the lowest confidence of a word holding a digit."""
    return words.groupBy(*by).agg(F.avg("confidence").alias("mean_conf"), F.min(F.when(F.col("text").rlike(r"\d"), F.col("confidence"))).alias("min_digit_conf"))
