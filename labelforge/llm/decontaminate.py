"""Benchmark decontamination by suffix arrays over the training text.

The documents of a task's slice are one shard: their words become the numbers of the test vocabulary (0 for a word no test item has,
which also ends a document), and the start positions are sorted into a suffix array. A start is left out only where no test window
can match, because a foreign word comes first. Every test suffix is binary-searched, cut to its window: 13 words, or the whole item
where it is shorter. Neighbouring windows on one diagonal join to the longest verbatim matches and their places.

Defined cases: a null text or one without words has no words, no hits and is not contaminated; items without words never match; an
empty table gives an empty result; repeated documents are judged each on its own; repeated item ids count as one item; other columns
are never read. The test set is broadcast in slices of checked size; a set of several slices passes the documents through one map each.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, map_texts

WINDOW = 13
#: Text bytes of test items that one map carries.
TEST_BYTES = 32 << 20
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCHES = "array<struct<item:string,doc_start:long,item_start:long,words:long>>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other non-ASCII characters."""
    return text.encode().translate(_KEEP).split() if text else []


class TestSet:
    """Distinct windows of the test items, as packed rows of word numbers, and where in which item each stands."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        self.window = window
        rows: dict[tuple[int, ...], int] = {}
        at = set()
        for name, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            n = min(window, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                at.add((rows.setdefault(tuple(w[s:s + n]), len(rows)), number[name], s))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.bits = max(1, len(self.vocab).bit_length())
        top = (1 << self.bits) - 1
        self.low = self.pack(np.array([[*r, *[0] * (window - len(r))] for r in rows], np.uint64).reshape(-1, window))
        self.high = self.pack(np.array([[*r, *[top] * (window - len(r))] for r in rows], np.uint64).reshape(-1, window))
        self.places = np.array(sorted(at), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.places[:, 0], np.arange(len(rows) + 1))

    def pack(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Columns of 64-bit keys whose order is the order of the rows."""
        per = 63 // self.bits
        out = []
        for s in range(0, self.window, per):
            key = np.zeros(len(matrix), np.uint64)
            for c in range(s, min(s + per, self.window)):
                key = key << np.uint64(self.bits) | matrix[:, c]
            out.append(key)
        return out


def _bound(keys: list[np.ndarray], want: list[np.ndarray], after_equal: bool) -> np.ndarray:
    """For each wanted row the number of sorted rows before it (and equal to it, if asked), by binary search."""
    lo = np.zeros(len(want[0]), np.int64)
    hi = np.full(len(want[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, w in zip(keys, want):
            v = k[mid]
            less |= same & (v < w)
            same &= v == w
        go = open_ & (less | same if after_equal else less)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def shard_matches(numbers: np.ndarray, t: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Positions and window numbers of all occurrences in one shard (word numbers, each document ended by a 0)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(t.lengths) or not len(numbers):
        return none
    n = len(numbers)
    stop = np.where(numbers == 0, np.arange(n), n)
    run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
    starts = np.flatnonzero(run >= t.lengths.min())
    if not len(starts):
        return none
    padded = np.append(numbers, np.zeros(t.window, np.int64)).astype(np.uint64)
    keys = t.pack(np.stack([padded[starts + c] for c in range(t.window)], axis=1))
    order = np.lexsort(keys[::-1])
    suffixes, keys = starts[order], [k[order] for k in keys]
    left, right = _bound(keys, t.low, False), _bound(keys, t.high, True)
    count = right - left
    window = np.repeat(np.arange(len(count)), count)
    return suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + left[window]], window


def longest_matches(pos: np.ndarray, window: np.ndarray, t: TestSet) -> np.ndarray:
    """Rows (position, item, item position, words): occurrences on one diagonal joined to verbatim matches that cannot grow."""
    if not len(pos):
        return np.zeros((0, 4), np.int64)
    count = t.first[window + 1] - t.first[window]
    row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(t.first[window], count)
    p, w = np.repeat(pos, count), np.repeat(window, count)
    item, at = t.places[row, 1], t.places[row, 2]
    order = np.lexsort((p, p - at, item))
    p, w, item, at = p[order], w[order], item[order], at[order]
    new = np.append(True, (item[1:] != item[:-1]) | (p[1:] - at[1:] != p[:-1] - at[:-1]) | (p[1:] != p[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    return np.stack((p[head], item[head], at[head], p[tail] - p[head] + t.lengths[w[tail]]), axis=1)


def _slices(items: DataFrame, item_col: str, text_col: str, size: int) -> list[list[tuple[str, str | None]]]:
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // size) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n)) if n > 1 else F.lit(0)
    return [[tuple(r) for r in rows.filter(part == k).collect()] for k in range(n)]


def find_contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, share: int = 20, test_bytes: int = TEST_BYTES) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_hit`` (words inside an occurrence of a test window), ``n_items``, ``items`` (ids of the
    items that occur, sorted as strings), ``matches`` (longest verbatim matches with item, places in words, and length) and ``contaminated``:
    at least one word of ``share`` is hit. A map without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = _slices(items, item_col, item_text, test_bytes)
    for k, part in enumerate(parts):
        out = _search(out, TestSet(part, window), k == len(parts) - 1, share, kind)
    return out.withColumnRenamed("id", id_col)


def _search(df: DataFrame, t: TestSet, last: bool, share: int, kind: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(t)
    carried = "hits" in df.columns

    def make():
        t = shared.value
        number = t.vocab.get

        def step(b):
            texts = b.column(1).to_pylist()
            docs = [words(x) for x in texts]
            sizes = np.array([len(d) for d in docs], np.int64)
            ends = np.cumsum(sizes + 1)
            begins = ends - sizes - 1
            numbers = np.fromiter((number(w, 0) for d in docs for w in (*d, b"")), np.int64, int(sizes.sum()) + len(docs))
            pos, window = shard_matches(numbers, t)
            mark = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(mark, pos, 1)
            np.add.at(mark, pos + t.lengths[window], -1)
            hit = np.cumsum(mark[:-1]) > 0
            found: list[list] = [[] for _ in docs]
            rows = longest_matches(pos, window, t)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            for (p, item, at, n), d in zip(rows.tolist(), np.searchsorted(begins, rows[:, 0], "right").tolist()):
                found[d - 1].append({"item": t.names[item], "doc_start": p - int(begins[d - 1]), "item_start": at, "words": n})
            if carried:
                for d, (old, more) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    hit[int(begins[d]) + np.array(old, np.int64)] = True
                    found[d] = sorted([*more, *found[d]], key=lambda m: (m["doc_start"], m["item"], m["item_start"]))
            matches = pa.array(found, _MATCHES)
            if not last:
                hits = [np.flatnonzero(hit[s:s + n]) for s, n in zip(begins.tolist(), sizes.tolist())]
                return batch(id=b.column(0), text=b.column(1), hits=pa.array(hits, pa.list_(pa.int64())), matches=matches)
            total = np.append(0, np.cumsum(hit))
            n_hit = total[begins + sizes] - total[begins]
            names = [sorted({m["item"] for m in f}) for f in found]
            return batch(id=b.column(0), n_words=pa.array(sizes), n_hit=pa.array(n_hit.astype(np.int64)), n_items=pa.array([len(x) for x in names], pa.int64()),
                         items=pa.array(names, pa.list_(pa.string())), matches=matches, contaminated=pa.array((n_hit > 0) & (share * n_hit >= sizes)))
        return step
    schema = (f"id {kind}, n_words long, n_hit long, n_items long, items array<string>, matches {MATCHES}, contaminated boolean" if last
              else f"id {kind}, text string, hits array<long>, matches {MATCHES}")
    return map_texts(df, df.columns, "text", make, schema)


_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))
