"""Line de-duplication by overlapping three-line windows.

Every window of three consecutive lines is hashed (two 64-bit hashes), repeated windows are found over the whole corpus, and of each the
first occurrence, by id and place, stays: the lines that later occurrences cover are merged and removed.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; a text of fewer than three lines has no window;
windows of blank lines only do not count; rows that share an id and rows without one: occurrences at the same place of the same id are
one occurrence, rows without an id keep all lines; an empty table gives an empty result; other columns pass through untouched.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, map_texts

WINDOW = 3


def windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(h1, h2, id, pos) of every window, as expressions over the text's lines."""
    lines = F.split(F.col(text_col), "\n", -1)
    row = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lines.alias("l")).filter(F.size("l") >= window)

    def at(i):
        part = [F.get(F.col("l"), i + k) for k in range(window)]
        some = F.trim(F.concat(*part)) != ""
        return F.struct(i.alias("pos"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(window), *part).alias("h2"), some.alias("some"))
    placed = row.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - window), at)).alias("w"))
    return placed.select("id", "w.*").filter("some").drop("some")


def repeated(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(id, starts): places of the windows that occur earlier."""
    w = windows(df, id_col, text_col, window)
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = w.join(first, ["h1", "h2"]).filter(F.struct("id", "pos") > F.col("first"))
    return later.groupBy("id").agg(F.collect_list("pos").alias("starts"))


def cover(starts: list[int], window: int, n: int) -> bytearray:
    """1 for each line of ``n`` that a window from one of the starts covers."""
    hit = bytearray(n)
    for s in starts:
        hit[s:s + window] = b"\1" * window
    return hit


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``df`` with the text's repeated lines removed, and ``n_lines`` and ``n_removed`` added (replaced if there)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    plain = df.toDF(*names)
    rep = repeated(plain, at, text, window)
    joined = plain.join(rep, plain[at] == rep["id"], "left").select(*names, "starts")

    def make():
        def step(b):
            t = b.schema.get_field_index(text)
            texts, counts, gone = b.column(t).to_pylist(), [], []
            for i, starts in enumerate(b.column(len(names)).to_pylist()):
                lines = [] if texts[i] is None else texts[i].split("\n")
                hit = cover(starts or [], window, len(lines))
                counts.append(len(lines))
                gone.append(sum(hit[:len(lines)]))
                if starts:
                    texts[i] = "\n".join(x for x, h in zip(lines, hit) if not h)
            cols = {n: pa.array(texts, pa.string()) if n == text else b.column(k) for k, n in enumerate(names)}
            return batch(**cols, n_lines=pa.array(counts, pa.int64()), n_removed=pa.array(gone, pa.int64()))
        return step
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, df.columns))
    out = map_texts(joined, [*names, "starts"], text, make, f"{schema}, n_lines long, n_removed long")
    keep = [(n, c) for n, c in zip(names, df.columns) if c not in ("n_lines", "n_removed")]
    return out.select(*(F.col(n).alias(c) for n, c in keep), "n_lines", "n_removed")
