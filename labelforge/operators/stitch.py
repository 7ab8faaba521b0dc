"""One ingredient list from any number of overlapping photos.

The photos of a product are folded in their order: the list so far and the next photo's list are aligned end to end with free ends, a match
scores twice its similarity, an unlike pair costs 1 and an item that only one list has costs a half. An overlap counts if two or more
matches stand in a row; otherwise the photo's items simply follow.

A product's photos, a handful of short lists, are gathered into one row by one shuffle; tasks align them. Most unlike pairs are told by
their lengths and letters alone.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .ocr import MATCH_SIM, MIN_RUN, plain_key

# Scores of an unlike pair and of an item without a partner; a match scores MATCH times its similarity.
MATCH, UNLIKE, ALONE = 2.0, -1.0, -0.5


@dataclass
class Item:
    """A read ingredient: its words with confidences, its key, the photos it was seen on, whether they disagree."""
    words: list[tuple[str, float]]
    key: str
    photos: list
    conflict: bool = False

    @property
    def conf(self) -> float:
        return sum(c for _, c in self.words) / max(1, len(self.words))


@lru_cache(maxsize=1 << 14)
def _letters(key: str) -> int:
    """A key's letter counts in one number: 64 bits for each letter (or two that share them), as many of them set as the key has of it."""
    n: dict[int, int] = {}
    for x in key:
        n[ord(x) & 63] = n.get(ord(x) & 63, 0) + 1
    return sum(((1 << c) - 1) << 64 * at for at, c in n.items())


def similarity(a: str, b: str, least: float = MATCH_SIM) -> float | None:
    """1 - edit distance / longer length of two keys, None where that is below ``least``."""
    longest = max(len(a), len(b))
    if a == b:
        return 1.0 if a else None
    # no more letters can stay than the shorter key has, nor than both have of a kind
    if 1 - (longest - min(len(a), len(b))) / longest < least:
        return None
    if longest <= 64 and 1 - (longest - (_letters(a) & _letters(b)).bit_count()) / longest < least:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    got = 1 - row[-1] / longest
    return got if got >= least else None


def align(n: int, m: int, like: Callable[[int, int], float | None]) -> list[tuple[int | None, int | None]]:
    """Best alignment with free ends as (place in the first, place in the second) steps; what lies before and after the overlap is not aligned,
    the first list's items before the second's. ``like`` gives a similarity, or None for an unlike pair."""
    gain = [[UNLIKE if (s := like(i, j)) is None else MATCH * s for j in range(m)] for i in range(n)]
    best = [[0.0] * (m + 1)]
    for i in range(n):
        row = [0.0]
        for j in range(m):
            row.append(max(best[i][j] + gain[i][j], best[i][j + 1] + ALONE, row[j] + ALONE))
        best.append(row)
    ends = [(i, m) for i in range(n + 1)] + [(n, j) for j in range(m + 1)]
    i, j = stop = max(ends, key=lambda e: best[e[0]][e[1]])  # the first of equal ends
    steps: list[tuple[int | None, int | None]] = []
    while i and j:
        if best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            steps.append((i, j))
        elif best[i][j] == best[i - 1][j] + ALONE:
            i -= 1
            steps.append((i, None))
        else:
            j -= 1
            steps.append((None, j))
    before = [(k, None) for k in range(i)] + [(None, k) for k in range(j)]
    after = [(k, None) for k in range(stop[0], n)] + [(None, k) for k in range(stop[1], m)]
    return before + steps[::-1] + after


def better_reading(a: Item, b: Item, key_of: Callable[[str], str]) -> Item:
    """Of two readings of one ingredient: the surer one if they agree; else word by word, or the surer whole if their words do not pair up."""
    photos = list(dict.fromkeys(a.photos + b.photos))
    surer = a if a.conf >= b.conf else b
    if a.key == b.key:
        return Item(surer.words, surer.key, photos, surer.conflict)
    words = [x if x[1] >= y[1] else y for x, y in zip(a.words, b.words)] if len(a.words) == len(b.words) else surer.words
    return Item(words, key_of(" ".join(w for w, _ in words)), photos, True)


def fold(lists: list[list[Item]], like: Callable[[str, str], float | None], key_of: Callable[[str], str]) -> tuple[list[Item], int, list[bool]]:
    """The merged list, the number of matches, and for each photo after the first whether it overlaps what came before."""
    merged, matched, overlaps = list(lists[0]) if lists else [], 0, []
    for other in lists[1:]:
        steps = align(len(merged), len(other), lambda i, j: like(merged[i].key, other[j].key))
        out, run, longest = [], 0, 0
        for i, j in steps:
            if i is not None and j is not None and like(merged[i].key, other[j].key) is not None:
                out.append(better_reading(merged[i], other[j], key_of))
                run += 1
                matched += 1
                longest = max(longest, run)
                continue
            run = 0
            out += [merged[i]] if i is not None else []
            out += [other[j]] if j is not None else []
        overlaps.append(longest >= MIN_RUN)
        merged = out if longest >= MIN_RUN else merged + list(other)
    return merged, matched, overlaps


def _key(text: str) -> str:
    return "".join(c for c in text.upper() if "A" <= c <= "Z" or "0" <= c <= "9")


def merge_photos(segments: DataFrame, by: str = "product_id") -> DataFrame:
    """segments(by, photo_id, idx, words array of (text, confidence)) -> (by, items, matched, overlaps): per product the merged list of
    (text, conf, photos, conflict) in reading order.

    Photos follow each other by id. Products of one photo keep its list; a product without a segment has no row.
    """
    w = F.transform("words", lambda x: F.named_struct(F.lit("text"), x["text"], F.lit("confidence"), x["confidence"].cast("double")))
    s = segments.select(by, "photo_id", F.col("idx").cast("int").alias("idx"), w.alias("words"), plain_key(F.array_join("words.text", " ")).alias("k"))
    lists = s.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("photo_id", "idx", "k", "words"))).alias("segs"))
    kind, photo = segments.schema[by].dataType.simpleString(), segments.schema["photo_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, matched, overlaps = [], [], []
            # the leaves are read as flat columns, many times faster than nested rows
            segs, cut = b.column(1).flatten(), np.append(0, np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))).tolist()
            photo, key, words = (segs.field(c) for c in ("photo_id", "k", "words"))
            leaves = words.flatten()
            read = [(t or "", c or 0.0) for t, c in zip(leaves.field("text").to_pylist(), leaves.field("confidence").to_pylist())]
            at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))).tolist()
            photo, key = photo.to_pylist(), key.to_pylist()
            for first, last in zip(cut[:-1], cut[1:]):
                like = cache(similarity)
                photos: dict = {}
                for i in range(first, last):
                    photos.setdefault(photo[i], []).append(Item(read[at[i]:at[i + 1]], key[i], [photo[i]]))
                merged, n, ok = fold(list(photos.values()), like, _key)
                items.append([{"text": " ".join(w for w, _ in m.words), "conf": m.conf, "photos": m.photos, "conflict": m.conflict} for m in merged])
                matched.append(n)
                overlaps.append(ok)
            kinds = pa.list_(pa.struct([("text", pa.string()), ("conf", pa.float64()), ("photos", pa.list_(b.schema.field(1).type.value_type.field("photo_id").type)), ("conflict", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, kinds), pa.array(matched, pa.int32()), pa.array(overlaps, pa.list_(pa.bool_()))], [by, "items", "matched", "overlaps"])
    return lists.mapInArrow(run, f"{by} {kind}, items array<struct<text:string,conf:double,photos:array<{photo}>,conflict:boolean>>, matched int, overlaps array<boolean>")
