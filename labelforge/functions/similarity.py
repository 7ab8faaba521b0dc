"""Similarity kernels for printed names: Indel ratio, glyph-aware edit cost, and the edits behind a match.

The kernels work on whole Arrow batches (NumPy over all pairs of a batch at once) and only score rows that
Spark has already selected, shuffled and de-duplicated.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Fixed values of the glyph model: pairs that look alike, two-for-one look-alikes, narrow glyphs, droppable last words, costs.
LOOK_ALIKE = [
    ("I", "L"), ("I", "1"), ("L", "1"), ("I", "J"), ("I", "T"), ("O", "0"), ("O", "Q"), ("O", "D"), ("O", "C"), ("C", "E"), ("C", "G"),
    ("C", "Q"), ("C", "D"), ("E", "F"), ("N", "U"), ("N", "M"), ("N", "H"), ("U", "V"), ("V", "Y"), ("V", "N"), ("B", "8"), ("S", "5"),
    ("Z", "2"), ("G", "6"), ("F", "P"), ("P", "R"), ("A", "O"), ("A", "E"), ("M", "W"), ("B", "H"), ("R", "K"), ("T", "Y"),
]
TWO_FOR_ONE = [("RN", "M"), ("CL", "D"), ("VV", "W")]
NARROW = "IL1JTFR"
GENERIC_SUFFIXES = ["OIL", "EXTRACT", "WATER", "BUTTER", "WAX", "JUICE", "POWDER", "ACID"]
COST_WILDCARD, COST_LOOK_ALIKE, COST_NARROW, COST_SUFFIX, COST_FULL = 0.1, 0.4, 0.6, 0.3, 1.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789?"
_PAD = len(ALPHABET)
PAIRS_PER_STEP = 400_000
LANE = 64  # a key shorter than this fits the bit-parallel lanes
_CODE = np.full(128, _PAD, dtype=np.uint8)
for _i, _ch in enumerate(ALPHABET):
    _CODE[ord(_ch)] = _i


def _cost_tables() -> tuple[np.ndarray, np.ndarray]:
    size = _PAD + 1
    sub = np.full((size, size), COST_FULL)
    for a, b in LOOK_ALIKE:
        x, y = ALPHABET.index(a), ALPHABET.index(b)
        sub[x, y] = sub[y, x] = COST_LOOK_ALIKE
    wild = ALPHABET.index("?")
    sub[wild, :] = sub[:, wild] = COST_WILDCARD
    np.fill_diagonal(sub, 0.0)
    indel = np.full(size, COST_FULL)
    for ch in NARROW:
        indel[ALPHABET.index(ch)] = COST_NARROW
    return sub, indel


_SUB, _INDEL = _cost_tables()
_PAIRS = [(ALPHABET.index(p[0]), ALPHABET.index(p[1]), ALPHABET.index(s)) for p, s in TWO_FOR_ONE]


def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code matrix (rows padded) and lengths of a list of keys."""
    lens = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    width = max(int(lens.max(initial=0)), 1)
    raw = np.array(keys, dtype=f"S{width}").view(np.uint8).reshape(len(keys), width) if len(keys) else np.zeros((0, 1), np.uint8)
    return _CODE[raw & 127], lens


# ---------------------------------------------------------------------------------------------------
# Indel ratio: 100 * 2*LCS / (m+n)

def letter_masks(codes: np.ndarray) -> np.ndarray:
    """For every key, one 64-bit mask per glyph with a bit at each place the glyph stands."""
    masks = np.zeros((len(codes), _PAD + 1), dtype=np.uint64)
    rows = np.arange(len(codes))
    for j in range(codes.shape[1]):
        masks[rows, codes[:, j]] |= np.uint64(1) << np.uint64(j)
    masks[:, _PAD] = 0
    return masks


def lcs_pairs(masks: np.ndarray, key_len: np.ndarray, ki: np.ndarray, right: np.ndarray, ni: np.ndarray) -> np.ndarray:
    """Longest common subsequence of (key ki, name ni) pairs, bit-parallel in 64-bit lanes (keys up to 63 characters)."""
    full = (np.uint64(1) << key_len[ki].astype(np.uint64)) - np.uint64(1)
    state = np.full(len(ki), ~np.uint64(0))
    flat, base = masks.ravel(), ki * (_PAD + 1)
    names = np.ascontiguousarray(right[ni].T)
    for j in range(len(names)):
        m = flat[base + names[j]]
        u = state & m
        state = (state + u) | (state - u)
    return np.bitwise_count(~state & full).astype(np.int64)


def indel_ratio_one(a: str, b: str) -> float:
    """Indel ratio of any two strings (arbitrary length, arbitrary alphabet)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    lcs = len(a) - s.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column form of the Indel ratio (0..100): lanes over the whole batch, whole-number subsequences for long or foreign strings."""
    out = np.full(len(a), np.nan)
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    (x, xs), (y, ys) = pd.factorize(a.to_numpy(object)[there]), pd.factorize(b.to_numpy(object)[there])
    known = set(ALPHABET)
    fits = lambda values, width: np.fromiter((0 < len(v) < width and known.issuperset(v) for v in values), bool, len(values))
    # only distinct strings are encoded; those that fit no lane stand as one blank there
    lane_x, lane_y = fits(xs, LANE), fits(ys, 4 * LANE)
    lane = lane_x[x] & lane_y[y]
    if lane.any():
        cx, lx = encode([v if ok else "" for v, ok in zip(xs, lane_x)])
        cy, ly = encode([v if ok else "" for v, ok in zip(ys, lane_y)])
        masks = letter_masks(cx)
        pairs = np.flatnonzero(lane)
        for at in range(0, len(pairs), PAIRS_PER_STEP):
            i = pairs[at:at + PAIRS_PER_STEP]
            out[there[i]] = 200.0 * lcs_pairs(masks, lx, x[i], cy, y[i]) / (lx[x[i]] + ly[y[i]])
    for i in np.flatnonzero(~lane):
        out[there[i]] = indel_ratio_one(xs[x[i]], ys[y[i]])
    return pd.Series(out).where(~np.isnan(out), None).astype("float64")


# ---------------------------------------------------------------------------------------------------
# Glyph-aware cost of turning a dictionary key into the printed key

_OPS = 5  # back pointers: two printed glyphs for one, one for two, substitute, extra, missing


def weighted_costs(tok: np.ndarray, tok_len: np.ndarray, cand: np.ndarray, cand_len: np.ndarray, trace: bool = False):
    """Cost for every row pair; with ``trace`` also the back-pointer cube (row, i, j)."""
    n, width_t, width_c = len(tok), int(tok_len.max(initial=0)), int(cand_len.max(initial=0))
    cost = np.full((width_t + 1, width_c + 1, n), np.inf)
    back = np.zeros((width_t + 1, width_c + 1, n), dtype=np.int8) if trace else None
    cost[0, 0] = 0.0
    t_ind, c_ind = _INDEL[tok], _INDEL[cand]
    two_t = [np.zeros((n, width_t + 1), bool) for _ in _PAIRS]
    two_c = [np.zeros((n, width_c + 1), bool) for _ in _PAIRS]
    for k, (a, b, _s) in enumerate(_PAIRS):
        if width_t > 1:
            two_t[k][:, 2:] = (tok[:, : width_t - 1] == a) & (tok[:, 1:width_t] == b)
        if width_c > 1:
            two_c[k][:, 2:] = (cand[:, : width_c - 1] == a) & (cand[:, 1:width_c] == b)
    at_t = [[np.flatnonzero(x[:, i]) for i in range(width_t + 1)] for x in two_t]
    at_c = [[np.flatnonzero(x[:, j]) for j in range(width_c + 1)] for x in two_c]
    sub = _SUB[tok.T[:, None, :], cand.T[None, :, :]] if n else None
    t_ind, c_ind = np.ascontiguousarray(t_ind.T), np.ascontiguousarray(c_ind.T)
    for i in range(width_t + 1):
        for j in range(width_c + 1):
            if i == 0 and j == 0:
                continue
            best = np.full(n, np.inf)
            op = np.zeros(n, dtype=np.int8) if trace else None

            def relax_some(rows, value, code):
                better = value < best[rows]
                best[rows[better]] = value[better]
                if trace:
                    op[rows[better]] = code

            def relax(value, code):
                if trace:
                    op[value < best] = code
                np.minimum(best, value, out=best)

            if i >= 2 and j >= 1:
                for k, (_a, _b, s) in enumerate(_PAIRS):
                    if len(at_t[k][i]):
                        rows = at_t[k][i][cand[at_t[k][i], j - 1] == s]
                        relax_some(rows, cost[i - 2, j - 1][rows] + COST_LOOK_ALIKE, 1)
            if i >= 1 and j >= 2:
                for k, (_a, _b, s) in enumerate(_PAIRS):
                    if len(at_c[k][j]):
                        rows = at_c[k][j][tok[at_c[k][j], i - 1] == s]
                        relax_some(rows, cost[i - 1, j - 2][rows] + COST_LOOK_ALIKE, 2)
            if i >= 1 and j >= 1:
                relax(cost[i - 1, j - 1] + sub[i - 1, j - 1], 3)
            if i >= 1:
                relax(cost[i - 1, j] + t_ind[i - 1], 4)
            if j >= 1:
                relax(cost[i, j - 1] + c_ind[j - 1], 5)
            cost[i, j] = best
            if trace:
                back[i, j] = op
    return cost[tok_len, cand_len, np.arange(n)], back


def _walk(tok: str, cand: str, back: np.ndarray) -> tuple[list[str], int]:
    """Edits (in reading order) and how many of them the glyph model does not explain."""
    i, j, edits, unexplained = len(tok), len(cand), [], 0
    while i or j:
        op = back[i, j]
        if op == 1:
            edits.append(f"{tok[i - 2:i]}→{cand[j - 1]} (look-alike glyphs)")
            i, j = i - 2, j - 1
        elif op == 2:
            edits.append(f"{tok[i - 1]}→{cand[j - 2:j]} (look-alike glyphs)")
            i, j = i - 1, j - 2
        elif op == 3:
            a, b = tok[i - 1], cand[j - 1]
            price = _SUB[ALPHABET.index(a), ALPHABET.index(b)]
            if a != b:
                why = {COST_WILDCARD: " (unreadable glyph)", COST_LOOK_ALIKE: " (look-alike glyphs)"}.get(float(price), "")
                edits.append(f"{a}→{b}{why}")
                unexplained += price >= COST_FULL
            i, j = i - 1, j - 1
        elif op == 4:
            edits.append(f"extra '{tok[i - 1]}'")
            unexplained += tok[i - 1] not in NARROW
            i -= 1
        else:
            edits.append(f"'{cand[j - 1]}' missing")
            unexplained += cand[j - 1] not in NARROW
            j -= 1
    return edits[::-1], int(unexplained)


def _batches(la: np.ndarray, lb: np.ndarray, budget: int = 600_000) -> Iterator[np.ndarray]:
    """Row index batches of similar size, so that padding stays small and the cost cube fits in memory."""
    side = np.maximum(la, lb) + 1
    order = np.argsort(side, kind="stable")
    sides, start = side[order], 0
    while start < len(order):
        widest = sides[start] + 3
        end = min(int(np.searchsorted(sides, widest, side="right")), start + max(1, budget // int(widest) ** 2))
        yield order[start:end]
        start = end


def _short_form(tok: str, cand: str) -> str | None:
    for s in GENERIC_SUFFIXES:
        if cand.endswith(s) and len(cand) > len(s) + 3 and not tok.endswith(s):
            return cand[: -len(s)]
    return None


def similarity_scores(tok: list[str], cand: list[str]) -> np.ndarray:
    """Best of the plain and the dropped-last-word similarity of every pair."""
    short = [_short_form(t, c) for t, c in zip(tok, cand)]
    at = [i for i, s in enumerate(short) if s is not None]
    all_t, all_c = tok + [tok[i] for i in at], cand + [short[i] for i in at]
    cost = np.zeros(len(all_t))
    (a, la), (b, lb) = encode(all_t), encode(all_c)
    for rows in _batches(la, lb):
        cost[rows], _ = weighted_costs(a[rows, : la[rows].max()], la[rows], b[rows, : lb[rows].max()], lb[rows])
    longest = np.maximum(np.maximum(la, lb), 1).astype(float)
    cost[len(tok):] += COST_SUFFIX
    sim = np.maximum(0.0, 1.0 - cost / longest)
    best = sim[: len(tok)].copy()
    np.maximum.at(best, np.array(at, dtype=int), sim[len(tok):])
    return best


def explain_pairs(tok: list[str], cand: list[str]) -> list[tuple[float, list[str], int]]:
    """(similarity, edits, unexplained edits) of every pair; the cheaper of plain and dropped-last-word wins."""
    short = [_short_form(t, c) for t, c in zip(tok, cand)]
    at = [i for i, s in enumerate(short) if s is not None]
    all_t, all_c = tok + [tok[i] for i in at], cand + [short[i] for i in at]
    cost, steps = np.zeros(len(all_t)), [None] * len(all_t)
    (a, la), (b, lb) = encode(all_t), encode(all_c)
    for rows in _batches(la, lb):
        cost[rows], back = weighted_costs(a[rows, : la[rows].max()], la[rows], b[rows, : lb[rows].max()], lb[rows], trace=True)
        for r, i in enumerate(rows):
            steps[i] = _walk(all_t[i], all_c[i], back[:, :, r])
    alt = {i: len(tok) + k for k, i in enumerate(at)}
    out = []
    for i in range(len(tok)):
        c, (edits, un), size = cost[i], steps[i], max(len(tok[i]), len(cand[i]), 1)
        k = alt.get(i)
        if k is not None and cost[k] + COST_SUFFIX < c:
            word = cand[i][len(short[i]):].title()
            c, size = cost[k] + COST_SUFFIX, max(len(tok[i]), len(short[i]), 1)
            edits, un = steps[k][0] + [f"'{word}' not visible"], steps[k][1]
        out.append((max(0.0, 1.0 - c / size), edits, un))
    return out


@F.pandas_udf(T.DoubleType())
def confusion_score(tok: pd.Series, cand: pd.Series) -> pd.Series:
    """Glyph-aware similarity (0..1) of a printed key to a dictionary key."""
    return pd.Series(similarity_scores(tok.tolist(), cand.tolist()), dtype="float64")


EXPLAINED = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("unexplained", T.IntegerType())])


@F.pandas_udf(EXPLAINED)
def confusion_explain(tok: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """Similarity (3 digits), readable edits and the number of unexplained edits."""
    rows = explain_pairs(tok.tolist(), cand.tolist())
    return pd.DataFrame({"score": [round(s, 3) for s, _e, _u in rows], "edits": [e for _s, e, _u in rows],
                         "unexplained": pd.Series([u for _s, _e, u in rows], dtype="int32")})
