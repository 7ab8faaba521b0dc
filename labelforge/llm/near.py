"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Fingerprints at most ``radius`` bits apart agree on at least ``bands - radius`` of ``bands`` bands, so every pair meets in some bucket keyed
by that many bands. The fingerprints of a bucket are a shard (a large bucket is several): its members form a BK-tree whose
children are keyed by integer Hamming distance to the parent, and a search follows only edges within the radius of the query's
distance. A shard joins what it finds into local groups and sends one link per member, never all pairs; the links of all shards then
become components by alternating large-star and small-star rounds. Shard trees travel in the shuffle to the tasks that search them:
they grow with the corpus, so no broadcast of them has a proven bound.

Defined cases: a null text or one without words has fingerprint zero and is linked like any other; rows without an id take no part in
links and have no component; rows that share an id count as one document; an empty table gives an empty result; other columns
are never read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch, durable, map_texts

WORDS = 4
RADIUS = 4
BANDS = 6
#: Members of one shard tree.
SHARD = 4_096
#: From this many members on the tree is searched for many queries at a time.
_SMALL = 32
_SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash as a signed number: a bit is set if more than half of the shingle hashes have it."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z and the ASCII blanks
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    n = max(1, len(w) - words + 1)
    starts = np.append(0, ends[:n - 1] + 1).tolist()
    stops = (ends[words - 1:] if len(w) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for c in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:z], _SEED) for a, z in zip(starts[c:c + _CHUNK], stops[c:c + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) of every row. A map without a shuffle."""
    def make():
        def step(b):
            return batch(id=b.column(0), fp=pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64()))
        return step
    return map_texts(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ["id", "text"], "text", make, "id long, fp long")


class Groups:
    """Union-find over numbers."""

    def __init__(self):
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


class BKTree:
    """Nodes with children by Hamming distance."""

    def __init__(self):
        self.fp: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> int:
        node = len(self.fp)
        self.fp.append(fp)
        self.children.append({})
        at = 0
        while at != node:
            at = self.children[at].setdefault((self.fp[at] ^ fp).bit_count(), node)
        return node

    def near(self, fp: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        out, stack = [], [0] if self.fp else []
        while stack:
            at = stack.pop()
            d = (self.fp[at] ^ fp).bit_count()
            if d <= radius:
                out.append(at)
            stack += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return out

    def near_many(self, fps: np.ndarray, radius: int):
        """Yields (node, numbers of the queries within the radius); each node is met once, with the queries that reach it."""
        stack = [(0, np.arange(len(fps)))] if self.fp else []
        while stack:
            at, who = stack.pop()
            d = np.bitwise_count(fps[who] ^ np.uint64(self.fp[at]))
            hit = who[d <= radius]
            if len(hit):
                yield at, hit
            for k, c in self.children[at].items():
                more = who[(d >= max(0, k - radius)) & (d <= k + radius)]
                if len(more):
                    stack.append((c, more))


def shard_links(fps: np.ndarray, reps: np.ndarray, members: int, radius: int) -> list[tuple[int, int]]:
    """Links (id, id) that join what belongs together in one shard: the first ``members`` rows form the tree, all rows are queries."""
    tree, groups = BKTree(), Groups()
    for fp in fps.tolist():
        groups.add()
    if len(fps) <= _SMALL:
        for i, fp in enumerate(fps.tolist()):
            for node in tree.near(fp, radius):
                groups.join(node, i)
            if i < members:
                tree.add(fp)
    else:
        for fp in fps[:members].tolist():
            tree.add(fp)
        label = np.arange(len(fps))
        for node, hit in tree.near_many(fps, radius):
            found = label[hit]
            lowest = min(int(found.min()), int(label[node]))
            other = np.unique(np.append(found, label[node]))
            if len(other) > 1:
                # whole groups change, so a label always names its group
                label[np.isin(label, other)] = lowest
        groups.up = label.tolist()
    tops = [groups.top(i) for i in range(len(fps))]
    ids = reps.tolist()
    return [(max(ids[i], ids[t]), min(ids[i], ids[t])) for i, t in enumerate(tops) if i != t and ids[i] != ids[t]]


def _buckets(fp, bands: int, radius: int):
    """Array of the bucket keys of a fingerprint: which bands, and their bits."""
    edge = [64 * k // bands for k in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1)) for k in range(bands)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), bands - radius)):
        key = F.lit(number).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edge[k + 1] - edge[k]).bitwiseOR(part[k])
        keys.append(key)
    return F.array(*keys)


def links(classes: DataFrame, radius: int = RADIUS, bands: int = BANDS, shard: int = SHARD) -> DataFrame:
    """(u, v), u > v: links between class ids that have the components of all pairs within the radius. ``classes`` has distinct ``fp`` and ``rep``."""
    rows = classes.select("fp", "rep", F.explode(_buckets(F.col("fp"), bands, radius)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    met = rows.join(counts, "bucket")
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    # a row is a member of its own shard and asks the later ones, so that each pair of shards meets once
    dealt = met.select("bucket", "fp", "rep", own.alias("own"), F.explode(F.sequence(own, F.col("shards") - 1)).alias("shard"))
    dealt = dealt.select("bucket", "shard", (F.col("own") != F.col("shard")).alias("guest"), "fp", "rep")

    def search(batches):
        def groups():
            """Rows of whole shards: members and their guests; guests of a full shard come in further pieces after the members."""
            key, fps, reps, members = None, [], [], 0
            for b in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                change = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
                for a, z in zip(change, np.append(change[1:], b.num_rows)):
                    if (cols[0][a], cols[1][a]) != key:
                        if key is not None:
                            yield np.concatenate(fps), np.concatenate(reps), members
                        key, fps, reps, members = (cols[0][a], cols[1][a]), [], [], 0
                    fps.append(cols[3][a:z].view(np.uint64))
                    reps.append(cols[4][a:z])
                    members += int((~cols[2][a:z]).sum())
                    if members and sum(map(len, fps)) - members > 8 * shard:
                        f, r = np.concatenate(fps), np.concatenate(reps)
                        yield f, r, members
                        fps, reps = [f[:members]], [r[:members]]
            if key is not None:
                yield np.concatenate(fps), np.concatenate(reps), members
        u, v = [], []
        for fps, reps, members in groups():
            for a, b in shard_links(fps, reps, members, radius):
                u.append(a)
                v.append(b)
            if len(u) > 100_000:
                yield batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))
                u, v = [], []
        if u:
            yield batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))
    placed = dealt.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", "guest", "fp")
    return placed.mapInArrow(search, "u long, v long").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (u, v), u > v, but the components themselves: the smallest id reachable. Large-star and small-star rounds until nothing
    changes; each round halves paths, and no row gathers a node's neighbours."""
    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def distinct(e):
        return e.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
    e = durable(edges)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = distinct(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select("u", "v", "m")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        e = durable(distinct(small))
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """One row per document: the id, ``fp`` and ``component`` (smallest id reachable over links of at most ``radius`` differing bits)."""
    prints = durable(fingerprints(df, id_col, text_col, words))
    # copies become one class first, so a group of thousands of copies is one fingerprint
    classes = durable(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    # rows that share an id bind their classes
    same = prints.filter("id is not null").groupBy("id", "fp").agg(F.lit(1).alias("one")).groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    shared = prints.join(same.select("id"), "id", "left_semi").join(classes, "fp").groupBy("id", "rep").agg(F.lit(1).alias("one"))
    bound = shared.select(F.greatest("id", "rep").alias("u"), F.least("id", "rep").alias("v")).filter("u <> v")
    found = components(links(classes, radius, bands).unionByName(bound).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
    placed = classes.join(found, classes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(placed, "fp", "left").select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
