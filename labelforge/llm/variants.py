"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's path is its length and its counts of sixteen letter groups. Two words are near if they differ by exactly one inserted, deleted or
replaced code point; then their paths differ by at most one surplus and one deficit. The words are arranged in a trie by path. A
depth-first search for a word follows the children of its own count and, while the budget of one surplus and one deficit is unspent, of
the counts one above and one below; the words of the leaves reached are verified letter by letter.

The trie is cut into shards at its upper levels: a shard is a node with at most ``SHARD`` words below it, so nodes with more are cut
deeper. Spark carries the search through the upper levels (a word is sent to the shards that its budget can reach); below, a task
holds one shard and steps all its words through a level at a time. A node at full depth that is still too large is dealt by hash.
Each pair is looked for from one side only: from the shorter word, or from the word of the smaller path.

Defined cases: a null text has no words; only runs of A-Z, a-z and U+00C0 to U+00FF are words and only A-Z is lower-cased; repeated rows
count each; an empty table gives an empty result; columns other than id and text are never read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, durable

LEAST = 7
#: A form is this many times as frequent as its variant.
RATIO = 10
#: Words below a node from which on it is cut a level deeper.
SHARD = 40_000
#: Levels of the trie that every path is cut at, besides the length.
TOP = 3
#: Letter groups: code point modulo sixteen, the most telling ones first.
GROUPS = (5, 1, 4, 14, 9, 15, 2, 3, 12, 8, 13, 0, 7, 6, 11, 10)
#: Distinct words that a task counts before it hands them on.
_HELD = 300_000
#: Words that step through the trie at a time, and letters that are compared at a time.
_STEP, _LETTERS = 8_192, 1 << 22
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_LEVELS = len(GROUPS)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words in Latin-1; every other character, also those beyond Latin-1, separates."""
    return text.encode("latin-1", "replace").translate(_PLAIN).split()


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, slip: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(word, n) of the words of ``least`` letters and more; ``slip`` may change the words of a document (given its id) first."""
    def run(batches):
        seen = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    ws = words_of(t)
                    seen.update(w for w in (slip(i, ws) if slip else ws) if len(w) >= least)
            if len(seen) >= _HELD:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)
    part = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return batch(word=pa.array([w.decode("latin-1") for w in seen], pa.string()), n=pa.array(list(seen.values()), pa.int64()))


def paths(words: list[bytes]) -> np.ndarray:
    """Counts of the letter groups, a row a word; counts beyond 255 are 255."""
    lengths = np.array([len(w) for w in words], np.int64)
    place = np.empty(16, np.int64)
    place[list(GROUPS)] = np.arange(16)
    group = place[np.frombuffer(b"".join(words), np.uint8) & 15]
    at = np.repeat(np.arange(len(words)), lengths) * _LEVELS + group
    return np.minimum(np.bincount(at, minlength=len(words) * _LEVELS), 255).astype(np.uint8).reshape(-1, _LEVELS)


def _node(length: int, prefix: np.ndarray) -> bytes:
    return length.to_bytes(4, "big") + prefix.tobytes()


def add_paths(words: DataFrame) -> DataFrame:
    """``path``: length (four bytes) and counts (a byte each) of every word."""
    def run(batches):
        for b in batches:
            ws = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            yield batch(word=b.column("word"), n=b.column("n"), path=pa.array([_node(len(w), p) for w, p in zip(ws, paths(ws))], pa.binary()))
    return words.mapInArrow(run, "word string, n long, path binary")


def heavy_nodes(pathed: DataFrame, shard: int = SHARD) -> dict[bytes, int]:
    """Words below each node that has too many, from level TOP down. At each level fewer than words / shard nodes can be heavy."""
    heavy: dict[bytes, int] = {}
    leaves = pathed.groupBy("path").agg(F.count("*").alias("n"))
    for depth in range(TOP, _LEVELS + 1):
        nodes = leaves.groupBy(F.substring("path", 1, 4 + depth).alias("node")).agg(F.sum("n").alias("n")).filter(F.col("n") > shard)
        here = {bytes(r["node"]): r["n"] for r in nodes.toLocalIterator()}
        if not here:
            break
        heavy |= here
    return heavy


def reach(length: int, counts: np.ndarray, heavy: dict[bytes, int], longer: bool) -> tuple[np.ndarray, list[bytes]]:
    """(row, shard node) for the shards in which words of one length look for near words: those one letter longer, or those of their own
    length whose path is not smaller."""
    rows, prefix = np.arange(len(counts)), np.zeros((len(counts), 0), np.uint8)
    up = np.zeros(len(rows), bool)
    down = np.zeros(len(rows), bool) | longer
    out_rows, out_nodes = [], []
    for depth in range(_LEVELS + 1):
        if depth >= TOP:
            nodes = [_node(length + longer, p) for p in prefix]
            go = np.array([k in heavy for k in nodes], bool) if heavy and depth < _LEVELS else np.zeros(len(rows), bool)
            out_rows.append(rows[~go])
            out_nodes += [k for k, g in zip(nodes, go.tolist()) if not g]
            rows, prefix, up, down = rows[go], prefix[go], up[go], down[go]
        if depth == _LEVELS or not len(rows):
            break
        c = counts[rows, depth].astype(np.int64)
        more = np.flatnonzero(~up & (c < 255))
        less = np.flatnonzero(~down & (c > 0) & up)  # a smaller path is not looked for, so the surplus comes first
        take = np.concatenate((np.arange(len(rows)), more, less))
        value = np.concatenate((c, c[more] + 1, c[less] - 1)).astype(np.uint8)
        a, z = len(rows), len(rows) + len(more)
        rows, prefix, up, down = rows[take], np.column_stack((prefix[take], value)), up[take], down[take]
        up[a:z] = True
        down[z:] = True
    return np.concatenate(out_rows) if out_rows else rows, out_nodes


def _salt(word: str, shards: int) -> int:
    return sum((i + 1) * ord(c) for i, c in enumerate(word)) % shards


def place(pathed: DataFrame, heavy: dict[bytes, int], shard: int = SHARD) -> DataFrame:
    """(node, salt, asks, word, n): every word in its own shard, and as a question in every shard that it can reach."""
    def run(batches):
        for b in batches:
            words, ns = b.column("word").to_pylist(), b.column("n").to_pylist()
            raw = [w.encode("latin-1") for w in words]
            counts = paths(raw)
            lengths = np.array([len(w) for w in raw])
            rows, nodes, asks = [], [], []
            for i, p in enumerate(b.column("path").to_pylist()):
                depth = 4 + TOP
                while depth < len(p) and p[:depth] in heavy:
                    depth += 1
                rows.append(i)
                nodes.append(p[:depth])
                asks.append(False)
            for length in np.unique(lengths).tolist():
                who = np.flatnonzero(lengths == length)
                for longer in (False, True):
                    r, k = reach(length, counts[who], heavy, longer)
                    rows += who[r].tolist()
                    nodes += k
                    asks += [True] * len(k)
            parts = [-(-heavy[k] // shard) if len(k) == 4 + _LEVELS and k in heavy else 1 for k in nodes]
            flat = [(k, s, a, words[i], ns[i]) for i, k, a, m in zip(rows, nodes, asks, parts) for s in (range(m) if a else (_salt(words[i], m),))]
            for at in range(0, len(flat), 50_000):
                k, s, a, w, n = zip(*flat[at:at + 50_000])
                yield batch(node=pa.array(k, pa.binary()), salt=pa.array(s, pa.int32()), asks=pa.array(a, pa.bool_()), word=pa.array(w, pa.string()), n=pa.array(n, pa.int64()))
    return pathed.mapInArrow(run, "node binary, salt int, asks boolean, word string, n long")


class Trie:
    """Words of one length by their letter-group counts."""

    def __init__(self, words: list[bytes]):
        counts = paths(words)
        order = np.lexsort(counts.T[::-1])
        counts = counts[order]
        self.words = [words[i] for i in order]
        self.letters = np.frombuffer(b"".join(self.words), np.uint8).reshape(len(words), -1)
        self.order = order
        self.children, node, new = [], np.zeros(len(words), np.int64), np.append(True, np.zeros(len(words) - 1, bool))
        for level in range(_LEVELS):
            new = new | np.append(True, counts[1:, level] != counts[:-1, level])
            self.children.append((node * 256 + counts[:, level])[new])
            node = np.cumsum(new) - 1
        self.leaves = np.append(np.flatnonzero(new), len(words))

    def search(self, counts: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(question, word) pairs whose paths are within the budget: one surplus, and one deficit unless the words are longer."""
        asks, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        up = np.zeros(len(asks), bool)
        down = np.zeros(len(asks), bool) | longer
        for level, children in enumerate(self.children):
            c = counts[asks, level].astype(np.int64)
            more, less = np.flatnonzero(~up & (c < 255)), np.flatnonzero(~down & (c > 0))
            take = np.concatenate((np.arange(len(asks)), more, less))
            want = np.concatenate((c, c[more] + 1, c[less] - 1)) + node[take] * 256
            child = np.searchsorted(children, want)
            ok = np.append(children, -1)[child] == want
            a, z = len(asks), len(asks) + len(more)
            asks, up, down = asks[take], up[take], down[take]
            up[a:z] = True
            down[z:] = True
            asks, node, up, down = asks[ok], child[ok], up[ok], down[ok]
        size = self.leaves[node + 1] - self.leaves[node]
        row = np.repeat(np.arange(len(asks)), size)
        return asks[row], self.leaves[node][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or (b a letter wider) by one inserted one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    same, back = a == b[:, :n], (a == b[:, 1:])[:, ::-1]
    head = np.where(same.all(axis=1), n, same.argmin(axis=1))
    tail = np.where(back.all(axis=1), n, back.argmin(axis=1))
    return head + tail >= n


def near_pairs(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(question, word) pairs that are near; words are of one length, that of the trie's or one less. Of pairs of one length that could be
    met from both sides only those whose question is the smaller, by path and letters, are given."""
    longer = trie.letters.shape[1] > len(words[0])
    out = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(words), _STEP):
        some = words[at:at + _STEP]
        counts = paths(some)
        letters = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)
        q, w = trie.search(counts, longer)
        step = max(1, _LETTERS // letters.shape[1])
        for k in range(0, len(q), step):
            x, y = q[k:k + step], w[k:k + step]
            ok = one_edit(letters[x], trie.letters[y])
            out.append(np.stack((x[ok] + at, y[ok])))
    q, w = np.concatenate(out, axis=1)
    if not longer and len(q):
        mine, theirs = np.flatnonzero(np.bincount(q)), np.flatnonzero(np.bincount(w))
        key = {i: (paths([words[i]]).tobytes(), words[i]) for i in mine.tolist()}
        other = {i: (paths([trie.words[i]]).tobytes(), trie.words[i]) for i in theirs.tolist()}
        ok = np.array([key[x] < other[y] for x, y in zip(q.tolist(), w.tolist())], bool)
        q, w = q[ok], w[ok]
    return q, w


def _answers(members: tuple[list[bytes], list[int]], asked: tuple[list[bytes], list[int]]) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of one shard's pairs, in both directions."""
    trie = Trie(members[0])
    size = trie.letters.shape[1]
    rows = []
    for length in (size, size - 1):
        at = [i for i, w in enumerate(asked[0]) if len(w) == length]
        if at:
            q, w = near_pairs(trie, [asked[0][i] for i in at])
            rows.append(np.stack((np.array(at)[q], trie.order[w])))
    q, w = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.int64)
    if not len(q):
        return None
    words = np.array([x.decode("latin-1") for x in asked[0] + members[0]], object)
    ns = np.array(asked[1] + members[1], np.int64)
    w = w + len(asked[0])
    a, b = np.append(q, w), np.append(w, q)
    names, number = np.unique(words, return_inverse=True)
    order = np.lexsort((number[b], -ns[b], number[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, number[a][1:] != number[a][:-1]))
    return batch(word=pa.array(words[a[first]], pa.string()), n_near=pa.array(np.diff(np.append(first, len(a)))), best_n=pa.array(ns[b[first]]), best=pa.array(words[b[first]], pa.string()))


def search_shards(placed: DataFrame) -> DataFrame:
    """Pairs of every shard; a task holds one shard at a time."""
    def run(batches):
        at, held = None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("node", "salt", "asks", "word", "n")]
            for node, salt, asks, word, n in zip(*cols):
                if (node, salt) != at:
                    if at is not None and held[0][0] and (out := _answers(*held)) is not None:
                        yield out
                    at, held = (node, salt), (([], []), ([], []))
                held[asks][0].append(word.encode("latin-1"))
                held[asks][1].append(n)
        if at is not None and held[0][0] and (out := _answers(*held)) is not None:
            yield out
    ordered = placed.repartition("node", "salt").sortWithinPartitions("node", "salt")
    return ordered.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near_n, near): how many words of the table (word, n) are one edit away, and the most frequent of them (ties: the smallest)."""
    pathed = durable(add_paths(words))
    found = search_shards(place(pathed, heavy_nodes(pathed, shard), shard))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("word"))).alias("best")
    g = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return g.select("word", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.word").alias("near"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of the table (word, n); words are distinct.

    ``form`` is the most frequent near word if it is ``ratio`` (two or more) times as frequent; ``root`` is the last word that forms lead
    to. Counts grow by the ratio along a chain, so its length is at most the logarithm of the largest count and doubling the links
    needs the logarithm of that many rounds.
    """
    words = durable(words)
    found = near_words(words, shard)
    form = F.col("near_n") >= ratio * F.col("n")
    j = words.join(found, "word", "left")
    out = durable(j.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")))
    links = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top, steps = out.agg(F.max("n")).first()[0] or 1, 1
    while ratio ** steps <= top:
        steps += 1
    for _ in range(steps.bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
