"""Substring de-duplication by repeated-phrase automata.

A window is 13 consecutive words. Each window is represented by its anchor, the word 6-gram of smallest hash in it; equal windows
have equal anchors, so only windows whose anchor is met in two documents can repeat. Their text goes to the shard of the anchor, in the
order of the documents. There the windows met in two documents are confirmed as recurring by their hashes, those alone are compiled
into an Aho-Corasick automaton over word numbers, with the smallest document of each, and the shard's text of all documents streams
through it; the places where it finds a phrase of a smaller document are removed. A shard is worked on a bounded number of rows at a
time; of an anchor that goes on, the hashes met so far and their smallest documents are carried along, not its rows.

Heavy anchors: a mergeable counter sketch finds every anchor with more than 2/HEAVY of all occurrences (a task names only anchors that are
frequent in it). They count as recurring, and their windows are dealt by whole-window hash instead; equal text within a slice is
sent once, for its smallest document, and its other documents are settled on the spot. So no task gathers a hot passage.

Defined cases: a null text has no words; texts of fewer than 13 words lose nothing; occurrences in the same document never remove each
other; rows that share an id are one document for the comparison and keep their own places; rows without an id keep all words; an empty
table gives an empty result; other columns are never read.
"""
from __future__ import annotations

from collections import defaultdict
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import batch, map_texts, slices

WINDOW = 13
GRAM = 6
#: An anchor is heavy from 2/HEAVY of all occurrences on; a task counts four times as many anchors.
HEAVY = 1 << 14
#: A task names no anchor that it has met more rarely than this.
NAMED = 64
#: Rows whose recurring windows share one automaton.
AUTOMATON_ROWS = 8_192
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        g = (g ^ (g >> np.uint64(31))) * _A + h[j:j + len(g)]
    return (g ^ (g >> np.uint64(29))) * _B


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, base)), dtype=np.uint64)


class Windows:
    """Windows of a slice of texts: the words' places and hashes, and the first word, document and anchor of each window."""

    def __init__(self, texts: list[bytes]):
        self.raw = (b" ".join(texts) + b" ").translate(_BLANKS)
        chars = np.frombuffer(self.raw, np.uint8)
        blank = np.concatenate(([True], chars == 32))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.head, self.tail = edge[::2], edge[1::2]
        n = len(self.head)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, self.head, "right")
        self.begin = np.searchsorted(doc, np.arange(len(texts)))
        sums = np.append(np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, len(chars))[:-1], dtype=np.uint64))
        h = (sums[self.tail] - sums[self.head]) * _powers(_A, len(chars))[self.head]
        self.hash = (h ^ (h >> np.uint64(32))) * _B
        if n < WINDOW:
            self.start = self.doc = self.value = np.zeros(0, np.int64)
            return
        low = _grams(self.hash, GRAM)
        for step in (1, 2, 4):  # the smallest of the eight grams of a window
            low = np.minimum(low[:-step], low[step:])
        self.start = np.flatnonzero(doc[:n - WINDOW + 1] == doc[WINDOW - 1:])
        self.doc = doc[self.start]
        self.value = low[self.start].view(np.int64)

    def text(self, first: int, last: int) -> bytes:
        """The words from one to another, as they stand."""
        return self.raw[self.head[first]:self.tail[last]]


def heavy_anchors(docs: DataFrame, size: int = HEAVY, least: int = NAMED) -> np.ndarray:
    """Every anchor with more than 2/size of all occurrences (and ``least`` in each task), sorted; at most 8/7 size anchors.

    A task keeps 4 size counters, which are too low by at most 1/(4 size) of its occurrences, and names those above 3/(4 size) of them;
    so an anchor's named counts lack at most 1/size of all occurrences.
    """
    def sketch(batches):
        keys, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in slices(batches, "text"):
            value = _doc_values(Windows(_bytes(b)))[1]
            total += len(value)
            new, times = np.unique(value, return_counts=True)
            keys, inverse = np.unique(np.append(keys, new), return_inverse=True)
            counts = np.bincount(inverse, np.append(counts, times), len(keys)).astype(np.int64)
            if len(keys) > 4 * size:  # as many are taken from each counter as the next one has
                counts -= np.partition(counts, len(counts) - 4 * size - 1)[len(counts) - 4 * size - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        named = counts >= max(least, 3 * total / (4 * size))
        # an empty task still tells its total, under the key 0
        yield batch(h=pa.array(np.append(keys[named], 0)), n=pa.array(np.append(counts[named], 0)), total=pa.array(np.append(np.zeros(named.sum(), np.int64), total)))
    got = docs.mapInArrow(sketch, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # the total stands in one row, which comes first; of the others no more than this can pass the limit
    top = got.orderBy(F.col("total").desc(), F.col("n").desc()).limit(8 * size // 7 + 2).toPandas()
    rows = top[top["n"] * size > 7 * top["total"].sum() / 8]
    return np.sort(rows["h"].to_numpy(np.int64))


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]


def _doc_values(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, anchor hash) pairs."""
    if not len(w.doc):
        return w.doc, w.value
    new = np.append(True, (w.doc[1:] != w.doc[:-1]) | (w.value[1:] != w.value[:-1]))  # neighbours mostly share their anchor
    doc, value = w.doc[new], w.value[new]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))
    return doc[new], value[new]


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def anchor_rows(docs: DataFrame, heavy) -> DataFrame:
    """(h, id) once per document for every anchor that is not heavy."""
    def make():
        def step(b):
            doc, value = _doc_values(Windows(_bytes(b)))
            light = ~_member(value, heavy.value)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            return batch(h=pa.array(value[light]), id=pa.array(ids[doc[light]].astype(np.int64)))
        return step
    return map_texts(docs, ["id", "text"], "text", make, "h long, id long")


def _print(text: bytes) -> int:
    """Tells rows that share an id apart."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def passages(docs: DataFrame, heavy) -> DataFrame:
    """Rows (key, text, id, print, starts, n): candidate text of ``n`` windows for the shard ``key``, standing at ``starts`` of the document.
    A null text says that the windows at ``starts`` are known to repeat."""
    def make():
        def step(b):
            texts = _bytes(b)
            w = Windows(texts)
            ids = pa.compute.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            hot = _member(w.value, heavy.value)
            use = hot.copy()
            edges = np.searchsorted(w.doc, np.arange(b.num_rows + 1))
            for d, known in enumerate(b.column(2)):
                known = known.values
                if known is not None and len(known):
                    a, z = edges[d], edges[d + 1]
                    use[a:z] |= _member(w.value[a:z], np.sort(known.to_numpy()))
            use &= b.column(0).is_valid().to_numpy(zero_copy_only=False)[w.doc]
            at = np.flatnonzero(use)
            whole = _grams(w.hash, WINDOW).view(np.int64)
            # neighbouring windows of one anchor go together; each hot window stands alone
            new = np.append(True, (w.value[at[1:]] != w.value[at[:-1]]) | (w.start[at[1:]] != w.start[at[:-1]] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]]) | hot[at[1:]])[:len(at)]
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(at)))
            first, doc = w.start[at[head]], w.doc[at[head]]
            key = np.where(hot[at[head]], whole[first], w.value[at[head]]) if len(head) else first
            seen: dict[tuple[int, int, bytes], dict[int, list[int]]] = {}
            for k, c, t, d, s in zip(key.tolist(), n.tolist(), (w.raw[a:z] for a, z in zip(w.head[first].tolist(), w.tail[first + n + WINDOW - 2].tolist())), doc.tolist(), (first - w.begin[doc]).tolist()):
                seen.setdefault((k, c, t), {}).setdefault(d, []).append(s)
            rows = []
            prints: dict[int, int] = {}
            settled: dict[tuple[int, int], list[int]] = {}
            for (k, c, t), where in seen.items():
                low = min(int(ids[d]) for d in where)
                for d, starts in where.items():
                    if d not in prints:
                        prints[d] = _print(texts[d])
                    if ids[d] == low:
                        rows.append((k, t.decode(), low, prints[d], starts, c))
                    else:
                        settled.setdefault((d, c), []).extend(starts)
            rows += [(_print(b"%d" % ids[d]), None, int(ids[d]), prints[d], s, c) for (d, c), s in settled.items()]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32())
            return batch(**{name: pa.array(c, k) for name, c, k in zip(("key", "text", "id", "print", "starts", "n"), cols, kinds)})
        return step
    return map_texts(docs, ["id", "text", "known"], "text", make, "key long, text string, id long, print long, starts array<int>, n int")


def confirm(texts: list[bytes], ids: list[int], keys: list[int], carried: dict[int, int]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Recurring windows of some rows, sorted by key and id, as (row, window, smallest document), and what the last key carries on.

    ``carried`` has the hashes of the first key's windows in the rows before, with their smallest documents.
    """
    w = Windows(texts)
    h = _grams(w.hash, WINDOW)[w.start].view(np.int64) if len(w.start) else np.zeros(0, np.int64)
    doc = np.array(ids, np.int64)[w.doc]
    order = np.lexsort((doc, h))
    head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))[:len(h)]
    value, low, high = h[order][head], doc[order][head], doc[order][np.append(head[1:], len(order)) - 1]
    if carried:
        known, least = (np.array(c, np.int64) for c in zip(*sorted(carried.items())))
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        low = np.where(known[at] == value, np.minimum(low, least[at]), low)
    again = low < high
    place = order[head[again]]
    found = list(zip(w.doc[place].tolist(), (w.start[place] - w.begin[w.doc[place]]).tolist(), low[again].tolist()))
    last = np.array([k == keys[-1] for k in keys], bool)[w.doc[order][head]] if len(head) else np.zeros(0, bool)
    kept = carried if keys[0] == keys[-1] else {}
    return found, kept | dict(zip(value[last].tolist(), low[last].tolist()))


def locate(texts: list[bytes], ids: list[int], phrases: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Runs (first window, windows) in each row's words where a phrase (row, window, smallest document) of a smaller document stands."""
    number = defaultdict(count(1).__next__)
    words = [tuple(map(number.__getitem__, t.split())) for t in texts]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for row, at, low in phrases:
        automaton.add_word(words[row][at:at + WINDOW], low)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not phrases:
        return out
    automaton.make_automaton()
    for t, doc, runs in zip(words, ids, out):
        for end, low in automaton.iter(t):
            if low < doc:
                s = end - WINDOW + 1
                if runs and runs[-1][0] + runs[-1][1] == s:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((s, 1))
    return out


def repeats(rows: DataFrame) -> DataFrame:
    """(id, print, start, n): runs of windows to remove, from the routed passages."""
    def search(batches):
        carried: dict[int, int] = {}
        before = None
        for big in batches:
            for at in range(0, big.num_rows, AUTOMATON_ROWS):
                key, text, id_, print_, starts, n = (c.to_pylist() for c in big.slice(at, AUTOMATON_ROWS).columns)
                out: list[tuple[int, int, int, int]] = [(i, p, s, c) for t, i, p, ss, c in zip(text, id_, print_, starts, n) if t is None for s in ss]
                use = [k for k, t in enumerate(text) if t is not None]
                if use:
                    texts, ids, keys = [text[k].encode() for k in use], [id_[k] for k in use], [key[k] for k in use]
                    phrases, carried = confirm(texts, ids, keys, carried if keys[0] == before else {})
                    before = keys[-1]
                    for k, runs in zip(use, locate(texts, ids, phrases)):
                        out += [(id_[k], print_[k], s + first, c) for first, c in runs for s in starts[k]]
                if out:
                    i, p, s, c = zip(*out)
                    yield batch(id=pa.array(i, pa.int64()), print=pa.array(p, pa.int64()), start=pa.array(s, pa.int32()), n=pa.array(c, pa.int32()))
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(search, "id long, print long, start int, n int")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_removed`` and ``kept`` (kept words joined by a space)."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = docs.filter("id is not null and text is not null")
    heavy = df.sparkSession.sparkContext.broadcast(heavy_anchors(told))
    anchors = anchor_rows(told, heavy)
    # an anchor that is not heavy has a bounded share of the rows, which the sort of a window spills if it has to
    w = Window.partitionBy("h")
    known = anchors.select("h", "id", (F.min("id").over(w) < F.max("id").over(w)).alias("again")).filter("again").groupBy("id").agg(F.collect_list("h").alias("known"))
    # both joins take the documents dealt by id in the same form, so Spark shuffles them once
    gone = repeats(passages(docs.join(known, "id", "left"), heavy)).groupBy("id").agg(F.collect_list(F.struct("print", "start", "n")).alias("gone"))
    joined = docs.join(gone, "id", "left")

    def make():
        def step(b):
            words, removed, kept = [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode()
                w = raw.split()
                n = len(w)
                if runs:
                    own, hit = _print(raw), bytearray(n)
                    for r in runs:
                        if r["print"] == own:
                            s, z = r["start"], min(n, r["start"] + r["n"] + WINDOW - 1)
                            hit[s:z] = b"\1" * (z - s)
                    w = [x for x, h in zip(w, hit) if not h]
                words.append(n)
                removed.append(n - len(w))
                kept.append(b" ".join(w).decode())
            return batch(id=b.column(0), n_words=pa.array(words, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(kept, pa.string()))
        return step
    out = map_texts(joined.select("id", "text", "gone"), ["id", "text", "gone"], "text", make, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
