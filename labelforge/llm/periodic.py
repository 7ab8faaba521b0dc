"""Runs (maximal periodic stretches of words) of every text, found on a Re-Pair grammar of its word ids.

A run is a stretch of consecutive words of smallest period q, at least ``max(LEAST, 2 q)`` words long, that no neighbouring word extends.

1. In a run of twelve words and more every word lies under a window of six words that occurs twice in the text. Only such stretches are
   looked at further; they hold every run whole.
2. Re-Pair gives the stretches of a slice of texts one grammar: pairs of neighbouring symbols that occur twice are replaced, the most
   frequent first, in rounds that replace all pairs which no neighbouring pair outranks. What is left of a stretch is folded into a
   balanced tree of further symbols, so a stretch is derived from one symbol.
3. A run lies in the derivation of a lowest symbol and crosses the boundary of its two parts. Each symbol's runs across its boundary are
   computed once, on one of its occurrences: a period is proposed where a window near the boundary comes again inside the symbol, and
   its extent is found by binary search over prefix hashes.
4. The runs are translated to all places where their symbol is derived; of intervals with the same period those inside another are
   dropped. What remains is compared word by word (a hash clash would repeat the work with another base).

The sum of the symbols' lengths, which bounds the proposals, grows as n log n. A map without a shuffle; memory is bounded by a slice of
text, or one longer text, and proposals are made a chunk at a time.

Defined cases: a null text has no words; a text of fewer than twelve words has no run; repeated rows are each done on their own; an empty
table gives an empty result; other columns are never read.
"""
from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, batch, map_texts

#: Words of the shortest run.
LEAST = 12
#: Words of a window; half of LEAST, so that a run always holds a window and its repetition one period on.
GRAM = LEAST // 2
#: Proposed periods that are worked on at a time.
CHUNK = 1 << 19
#: Of a window's repetitions these are looked at before the others; what they find makes most others needless.
NEAREST = 16
_PRIMES = (2147483647, 2147483629)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of the window that starts at each place but the last ones; equal windows of equal salt have equal hashes."""
    n = max(0, len(words) - GRAM + 1)
    w, h = _mix(words), _mix(salt[:n])
    for k in range(GRAM):
        h = (h ^ w[k:n + k]) * _MIX
        h ^= h >> np.uint64(31)
    return h


def repeated_stretches(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of one owner, LEAST words or longer, whose words all lie under windows that the owner has twice."""
    n = len(words)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(words, owner)
    at = np.flatnonzero(owner[:len(h)] == owner[GRAM - 1:])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = order[(np.append(same, False) | np.append(False, same))[:len(order)]]
    step = np.zeros(n + 1, np.int64)
    step[twice] += 1
    step[twice + GRAM] -= 1  # places are distinct, so plain indexing adds once
    under = np.cumsum(step[:n]) > 0
    edge = np.append(True, owner[1:] != owner[:-1])
    first = np.flatnonzero(under & (edge | ~np.append(False, under[:-1])))
    last = np.flatnonzero(under & (np.append(edge[1:], True) | ~np.append(under[1:], False))) + 1
    long = last - first >= LEAST
    return first[long], last[long]


def _peaks(rank: np.ndarray) -> np.ndarray:
    """Places whose pair outranks both neighbouring pairs; of a row of overlapping equal pairs every other one, from the left."""
    start = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    value = rank[start]
    top = (value >= 0) & (value > np.append(-1, value[:-1])) & (value > np.append(value[1:], -1))
    length = np.diff(np.append(start, len(rank)))
    start, length = start[top], (length[top] + 1) // 2
    return np.repeat(start, length) + 2 * (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))


class Grammar:
    """Binary rules over word ids; rule ``k`` is symbol ``words + k``, and the parts of a rule have smaller numbers."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.base = int(words.max(initial=-1)) + 1
        self.left, self.right, self.at = (np.zeros(0, np.int64) for _ in range(3))
        self.size = np.ones(self.base, np.int64)
        self.rounds: list[tuple[int, int]] = []
        sym, own, pos = words.astype(np.int64), owner, np.arange(len(words))
        known, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(sym) > 1:
            key = np.where(own[1:] == own[:-1], sym[:-1] << 32 | sym[1:], -1)
            kinds, which, times = np.unique(key, return_inverse=True, return_counts=True)
            times[kinds < 0] = 0
            if times.max() < 2:
                break
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((_mix(kinds), times))] = np.arange(len(kinds))
            rank[times < 2] = -1
            pick = _peaks(rank[which])
            chosen, first, which = np.unique(key[pick], return_index=True, return_inverse=True)
            place = np.searchsorted(known, chosen)
            fresh = np.append(known, -1)[place] != chosen
            ids = np.append(number, -1)[place]
            ids[fresh] = len(self.size) + np.arange(fresh.sum())
            self._add(chosen[fresh] >> 32, chosen[fresh] & 0xFFFFFFFF, pos[pick[first]][fresh])
            known, number = np.insert(known, place[fresh], chosen[fresh]), np.insert(number, place[fresh], ids[fresh])
            sym, own, pos = self._replace(sym, own, pos, pick, ids[which])
        while True:
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            if len(start) == len(own):
                break
            within = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
            pick = np.flatnonzero((within[:-1] % 2 == 0) & (own[1:] == own[:-1]))
            ids = len(self.size) + np.arange(len(pick))
            self._add(sym[pick], sym[pick + 1], pos[pick])
            sym, own, pos = self._replace(sym, own, pos, pick, ids)
        self.roots, self.starts = sym, pos

    def _add(self, left, right, at):
        self.rounds.append((len(self.left), len(self.left) + len(left)))
        self.left, self.right, self.at = np.append(self.left, left), np.append(self.right, right), np.append(self.at, at)
        self.size = np.append(self.size, self.size[left] + self.size[right])

    @staticmethod
    def _replace(sym, own, pos, pick, ids):
        sym = sym.copy()
        sym[pick] = ids
        keep = np.ones(len(sym), bool)
        keep[pick + 1] = False
        return sym[keep], own[keep], pos[keep]


class Prefixes:
    """Prefix hashes of the words; tells how far two places agree."""

    def __init__(self, words: np.ndarray, seed: int):
        self.parts = []
        t = _mix(words + np.int64(seed))
        for k, p in enumerate(_PRIMES):
            b, power = 1_000_003 + 7919 * (seed + k), np.ones(1, np.int64)
            while len(power) <= len(words):
                power = np.append(power, power * (int(power[-1]) * b % p) % p)
            power = power[:len(words) + 1]
            value = (t >> np.uint64(17 * k)).astype(np.int64) % p
            self.parts.append((p, power, np.append(0, np.cumsum(value * power[:-1] % p)) % p))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a and from b (b > a) are the same."""
        ok = np.ones(len(a), bool)
        for p, power, h in self.parts:
            ok &= (h[a + n] - h[a]) % p * power[b - a] % p == (h[b + n] - h[b]) % p
        return ok

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
        """Largest number of words, at most ``limit``, that agree from a and b on (or up to a and b)."""
        got = np.zeros(len(a), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step := step >> 1:
            try_ = np.flatnonzero(got + step <= limit)
            x, y, g = a[try_], b[try_], got[try_]
            n = np.full(len(try_), step)
            ok = self.equal(x + g, y + g, n) if forward else self.equal(x - g - step, y - g - step, n)
            got[try_[ok]] += step
        return got


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within the row, for rows repeated ``counts`` times."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _proposals(g: Grammar, words: np.ndarray):
    """Yields (rule, place, period): a window at the place comes again one period on, inside an occurrence of the rule.

    Of a run that crosses the boundary m, one window among those that start at m - 11 .. m has its repetition one period on, or the window
    that ends at m has it one period before.
    """
    n = len(words)
    rule = np.flatnonzero(g.size[g.base:] >= LEAST)
    lo, size = g.at[rule], g.size[g.base + rule]
    hi, middle = lo + size, lo + g.size[g.left[rule]]
    gram = np.unique(gram_hashes(words, np.zeros(n, np.int64)), return_inverse=True)[1].astype(np.int64)
    order = np.argsort(gram, kind="stable")
    sorted_, rank = gram[order] * n + order, np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for d in range(-1, LEAST):
        at = middle - (GRAM if d < 0 else d)
        ok = np.flatnonzero((at >= lo) & (at + GRAM <= hi))
        i, half = at[ok], size[ok] // 2
        if d < 0:
            first, stop = np.searchsorted(sorted_, gram[i] * n + np.maximum(i - half, lo[ok])), rank[i]
        else:
            first, stop = rank[i] + 1, np.searchsorted(sorted_, gram[i] * n + np.minimum(i + half, hi[ok] - GRAM), "right")
        todo = np.cumsum(stop - first)
        a = 0
        while a < len(ok):
            z = max(a + 1, int(np.searchsorted(todo, (todo[a - 1] if a else 0) + CHUNK, "right")))
            most = int((stop[a:z] - first[a:z]).max(initial=0))
            for skip, n_ in ((0, NEAREST), *((k, CHUNK) for k in range(NEAREST, most, CHUNK))):
                row, k = _expand(np.clip(stop[a:z] - first[a:z] - skip, 0, n_))
                other = order[stop[a:z][row] - 1 - skip - k if d < 0 else first[a:z][row] + skip + k]
                here = i[a:z][row]
                yield rule[ok[a:z][row]], np.minimum(here, other), np.abs(other - here)
            a = z


def boundary_runs(g: Grammar, words: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the runs that cross a rule's boundary, places relative to the rule's first word.

    A proposal inside a run already found, at a multiple of its period, would only give that run again and is dropped.
    """
    n, found = len(words), [np.zeros((4, 0), np.int64)]
    main = np.zeros((3, len(g.left)), np.int64)  # each rule's longest run so far
    main[2] = 1
    for rule, at, period in _proposals(g, words):
        s, e, q = main[:, rule]
        new = np.flatnonzero((at < s) | (at + period + GRAM > e) | (period % q != 0))
        rule, at, period = rule[new], at[new], period[new]
        one = np.unique(rule * (n + 1) + period, return_index=True)[1]
        rule, at, period = rule[one], at[one], period[one]
        lo = g.at[rule]
        hi, middle = lo + g.size[g.base + rule], lo + g.size[g.left[rule]]
        end = at + period + prefixes.agree(at, at + period, hi - at - period, True)
        start = at - prefixes.agree(at, at + period, at - lo, False)
        ok = (start < middle) & (middle < end) & (end - start >= np.maximum(LEAST, 2 * period))
        found.append(np.stack((rule, start - lo, end - lo, period))[:, ok])
        order = np.flatnonzero(ok & (end - start > (main[1] - main[0])[rule]))
        order = order[np.lexsort((-period[order], (end - start)[order]))]  # the last one written stays
        main[:, rule[order]] = start[order], end[order], period[order]
        if len(found) > 64:
            found = [_shortest(np.concatenate(found, axis=1))]
    return tuple(_shortest(np.concatenate(found, axis=1)))


def _shortest(found: np.ndarray) -> np.ndarray:
    """Of equal intervals of a rule the one of the shortest period."""
    found = found[:, np.lexsort(found[::-1])]
    return found[:, np.append(True, (found[:3, 1:] != found[:3, :-1]).any(axis=0))[:found.shape[1]]]


def derive(g: Grammar, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(start, end, period) at every place where a rule with runs is derived."""
    rule, start, end, period = found
    runs = np.bincount(rule, minlength=len(g.left))
    first = np.cumsum(runs) - runs
    some = np.append(np.zeros(g.base, bool), runs > 0)
    for a, z in g.rounds:
        some[g.base + a:g.base + z] |= some[g.left[a:z]] | some[g.right[a:z]]
    out = [np.zeros((3, 0), np.int64)]
    sym, at = g.roots, g.starts
    while len(sym):
        sym, at = sym[some[sym]], at[some[sym]]
        k = sym - g.base
        row, nth = _expand(runs[k])
        hit = first[k][row] + nth
        out.append(np.stack((at[row] + start[hit], at[row] + end[hit], period[hit])))
        sym, at = np.append(g.left[k], g.right[k]), np.append(at, at + g.size[g.left[k]])
    return tuple(np.concatenate(out, axis=1))


def find_runs(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs, by start and period; a run lies within one owner."""
    begin, stop = repeated_stretches(words, owner)
    if not len(begin):
        return tuple(np.zeros((3, 0), np.int64))
    row, k = _expand(stop - begin)
    w, own = np.unique(words[begin[row] + k], return_inverse=True)[1].astype(np.int64), row
    g = Grammar(w, own)
    for seed in count():
        s, e, q = derive(g, boundary_runs(g, w, Prefixes(w, seed)))
        order = np.lexsort((-e, s, q))
        s, e, q = s[order], e[order], q[order]
        reach = np.maximum.accumulate(q * (len(w) + 1) + e)  # rows are by period, so a later period outweighs every earlier end
        whole = np.append(True, reach[:-1] < (q * (len(w) + 1) + e)[1:])[:len(s)]
        s, e, q = s[whole], e[whole], q[whole]
        if all(np.array_equal(w[a:z - p], w[a + p:z]) for a, z, p in zip(s.tolist(), e.tolist(), q.tolist())):
            break
    shift = (begin - (np.cumsum(stop - begin) - (stop - begin)))[own[s]]
    order = np.lexsort((q, s + shift))
    return (s + shift)[order], (e + shift)[order], q[order]


def _texts_runs(texts: list[bytes]):
    """Words of each text, and its runs as (offsets, start, end, period) with word numbers of the text."""
    number = defaultdict(count().__next__)
    split = [t.split() for t in texts]  # bytes: the ASCII blanks only
    lengths = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((i for s in split for i in map(number.__getitem__, s)), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(split)), lengths)
    s, e, q = find_runs(words, owner)
    offsets = np.searchsorted(owner[s], np.arange(len(split) + 1)) if len(s) else np.zeros(len(split) + 1, np.int64)
    base = (np.cumsum(lengths) - lengths)[owner[s]] if len(s) else s
    return split, offsets, s - base, e - base, q


def collapse(words: list[bytes], start, end, period) -> bytes:
    """The words joined by spaces, without those that a run repeats."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    return b" ".join(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text's words without
    those that some run holds after its first period."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def step(b):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            split, offsets, s, e, q = _texts_runs(texts)
            cut = offsets.tolist()
            kept = [b" ".join(w) if a == z else collapse(w, s[a:z], e[a:z], q[a:z]) for w, a, z in zip(split, cut[:-1], cut[1:])]
            rows = pa.StructArray.from_arrays([pa.array(s), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            return batch(id=b.column(0), n_words=pa.array([len(w) for w in split], pa.int64()), runs=runs, collapsed=pa.array(kept, pa.binary()).cast(pa.string()))
        return step
    named = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = map_texts(named, ["id", "text"], "text", make, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", 2 * SLICE_BYTES)
    return out.withColumnRenamed("id", id_col)
