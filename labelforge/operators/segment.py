"""Label text to segments.

A label's whole text is handled inside its row: one linear pass marks the commas outside brackets, array expressions do the rest. Rows
multiply only at the final explode, so segmentation itself needs no shuffle.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X

# The printed list label, optional-section markers, blends, percentages, footnote marks, field labels.
LIST_LABEL = r"(?i)^\s*(?:ingredients?|ingredientes|inci)\s*(?:\(inci\))?\s*[:\-]?\s*"
MAY_CONTAIN = r"(?i)^\s*(?:may\s+contain|\+\s*/\s*-|\+/-|±)\s*[:\-]?\s*"
BLEND = r"(?i)\s*\(\s*and\s*\)\s*"
PERCENT = r"\s*[-–:]?\s*(\d+(?:\.\d+)?)\s*%\s*\**\s*$"
FOOTNOTE = r"\s*\*{1,3}\s*$"
SENTENCE = r"\.\s+(?=[A-Z+])"
FIELD_LABEL = r"(?i)^(?:MRP|M\.R\.P|B\.?\s?NO|BATCH|LOT|MFG|MFD|EXP|USE BEFORE|BEST BEFORE|PAO)\b"
NANO = r"(?i)\(\s*nano\s*\)"
REFERENCE_LABEL = r"(?i)^\s*(ingredients?\s*[:\-]\s*)"

_CUT = "\u0001"


def _mark(text: str, opens: str, closes: str) -> str:
    """The text with its commas and semicolons outside brackets replaced by cut marks: the depth at a place is the sum of the brackets
    before it, less the smallest such sum so far, since a closer without opener counts for nothing."""
    chars = np.array([text], dtype=f"<U{len(text)}").view(np.uint32)
    step = np.isin(chars, [ord(c) for c in opens]).astype(np.int32) - np.isin(chars, [ord(c) for c in closes])
    total = np.cumsum(step)
    cut = (total == np.minimum(np.minimum.accumulate(total), 0)) & ((chars == ord(",")) | (chars == ord(";")))
    chars[cut] = ord(_CUT)
    return chars.tobytes().decode("utf-32-le")


@F.pandas_udf(T.StringType())
def _mark_round(c: pd.Series) -> pd.Series:
    return c.map(lambda t: _mark(t, "(", ")"), na_action="ignore")


@F.pandas_udf(T.StringType())
def _mark_any(c: pd.Series) -> pd.Series:
    return c.map(lambda t: _mark(t, "([", ")]"), na_action="ignore")


def mark_top_level(c: Column, square_brackets: bool = True) -> Column:
    """Text with a cut mark for every comma and semicolon outside brackets. Only text with brackets is sent to Python, in batches."""
    mark, brackets = (_mark_any, "()[]") if square_brackets else (_mark_round, "()")
    bracketed = X.let(c, lambda x: F.when(reduce(or_, (F.contains(x, F.lit(b)) for b in brackets)), x))
    return F.coalesce(mark(bracketed), reduce(lambda t, x: F.replace(t, F.lit(x), F.lit(_CUT)), ",;", c))


def split_top_level(c: Column, square_brackets: bool = True) -> Column:
    """Array of the pieces between commas and semicolons outside brackets; a closer without opener is ignored. Not for use inside a lambda."""
    return F.split(mark_top_level(c, square_brackets), _CUT, -1)


def _trim_dots(c: Column) -> Column:
    c = X.strip(c)
    return X.let(c, lambda x: F.when(F.startswith(x, F.lit(".")) | F.endswith(x, F.lit(".")), X.strip(F.btrim(x, F.lit(".")))).otherwise(x))


def list_text(raw: Column) -> Column:
    """The printed list, cleaned and without its label, of one printed text that is already NFKC."""
    return F.regexp_replace(X.clean_text(raw, normalise=False), LIST_LABEL, "")


def segment_bodies(listed: Column) -> Column:
    """Array of (text, optional) of one ``list_text``, tags not yet taken off. It is asked more than once, so it should be a column of its own.

    From the first optional-section marker on, everything is optional; the marker itself goes.
    """
    def split(marked):
        pieces = F.flatten(F.transform(F.split(marked, _CUT, -1), lambda p: F.when(~F.contains(p, F.lit(".")) | X.strip(p).rlike(FIELD_LABEL), F.array(p)).otherwise(F.split(p, SENTENCE, -1))))
        parts = F.flatten(F.transform(pieces, lambda p: F.when(F.contains(p, F.lit("(")), F.split(p, BLEND, -1)).otherwise(F.array(p))))
        parts = F.filter(F.transform(parts, _trim_dots), lambda p: p != "")
        return F.transform(parts, lambda p: F.struct(p.alias("p"), p.rlike(MAY_CONTAIN).alias("m")))

    def flag(s):
        return F.transform(s["marked"], lambda x, i: F.struct(
            F.when(x["m"], X.strip(F.regexp_replace(x["p"], MAY_CONTAIN, ""))).otherwise(x["p"]).alias("b"),
            ((s["first"] > 0) & (i + 1 >= s["first"])).alias("o")))

    marked = X.let(mark_top_level(listed), split)
    both = X.let(marked, lambda m: F.struct(m.alias("marked"), F.array_position(F.transform(m, lambda x: x["m"]), F.lit(True)).alias("first")))
    return F.filter(X.let(both, flag), lambda x: x["b"] != "")


def take_tags(body: Column) -> tuple[Column, Column]:
    """Text without its printed percentage and footnote mark, and the array of tags."""
    has = lambda c, mark: F.contains(c, F.lit(mark))
    pct = F.when(has(body, "%"), F.regexp_extract(body, PERCENT, 1)).otherwise("")
    b = F.when(pct != "", X.strip(F.regexp_replace(body, PERCENT, ""))).otherwise(body)
    star = has(b, "*") & b.rlike(FOOTNOTE)
    tags = F.array_compact(F.array(F.when(has(body, "(") & body.rlike(NANO), F.lit("nano")), F.when(pct != "", F.concat(F.lit("label_percent="), pct)), F.when(star, F.lit("marker=*"))))
    return F.when(star, X.strip(F.regexp_replace(b, FOOTNOTE, ""))).otherwise(b), tags


def segment_labels(labels: DataFrame, one_source: bool = False) -> DataFrame:
    """labels(label_id, source_index, raw[, ocr_conf]) -> segments in printed order.

    ``one_source`` says each label is a single row: positions then need no window, hence no shuffle.
    """
    conf = F.col("ocr_conf").cast("double") if "ocr_conf" in labels.columns else F.lit(None).cast("double")
    rows = labels.withColumn("raw", X.nfkc(F.col("raw"))).withColumn("raw", list_text(F.col("raw")))
    rows = rows.select("label_id", F.col("source_index").cast("int").alias("source_index"), conf.alias("ocr_conf"), segment_bodies(F.col("raw")).alias("segs"))
    if one_source:
        rows = rows.withColumn("offset", F.lit(0))
    else:
        before = Window.partitionBy("label_id").orderBy("source_index").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("offset", F.coalesce(F.sum(F.size("segs")).over(before), F.lit(0)))
    # for a plain explode Spark infers a filter on the array's size, which would cut every label twice
    ex = rows.select("label_id", "source_index", "ocr_conf", "offset", F.posexplode_outer("segs").alias("i", "s")).where("i IS NOT NULL")
    text, tags = take_tags(F.col("s.b"))
    return ex.select("label_id", "source_index", (F.col("offset") + F.col("i")).cast("int").alias("position"), text.alias("raw"), F.col("s.o").alias("optional"), tags.alias("tags"), "ocr_conf")


def split_ingredients(labels: DataFrame, id_col: str = "label_id", raw_col: str = "raw") -> DataFrame:
    """Plain comma/semicolon list (parentheses respected): the simple reader used for a first look and as a fallback."""
    cleaned = F.regexp_replace(F.regexp_replace(F.col(raw_col), r"(?i)^\s*ingredients?\s*[:\-]?\s*", ""), r"\s+", " ")
    items = F.filter(F.transform(split_top_level(cleaned, square_brackets=False), X.strip), lambda p: p != "")
    return labels.select(id_col, F.posexplode(items).alias("idx", "raw"))


def reference_names(c: Column) -> Column:
    """Names of a reference ingredient text: parentheses dropped, split at , ; or '.'."""
    t = F.regexp_replace(c, r"\([^)]*\)", " ")
    parts = F.transform(F.split(t, r"[,;.]\s*", -1), lambda p: X.strip(F.regexp_replace(p, REFERENCE_LABEL, "")))
    return F.filter(parts, lambda p: F.length(p) > 1)


# How vitamins are written.
_VITAMINS = (r"(?i)\b(pro-?\s?)?vitamins?\s+([a-z]\d?)\b"
             r"((?:\s*(?:,|&|\+|\band\b)\s*(?:pro-?\s?vitamins?\s*)?[a-z]\d?\b)*)")
_VITAMIN_SEP = r"(?i)\s*(?:,|&|\+|\band\b)\s*"


def vitamin_codes(c: Column) -> Column:
    """Array of (ord, code, pro) named by 'Vitamin E & B3 and Pro-vitamin B5'-style lists."""
    t = F.regexp_replace(c, "[’`]", "'")
    groups = F.regexp_extract_all(t, F.lit("(" + _VITAMINS.replace("(?i)", "(?i:", 1) + "))"), 1)

    def members(g):
        lead = F.struct(F.upper(F.regexp_extract(g, _VITAMINS, 2)).alias("code"), (F.regexp_extract(g, _VITAMINS, 1) != "").alias("pro"))
        rest = F.filter(F.transform(F.split(F.regexp_extract(g, _VITAMINS, 3), _VITAMIN_SEP, -1), X.strip), lambda r: r != "")
        tail = F.transform(rest, lambda r: F.struct(
            F.upper(F.regexp_replace(r, r"(?i)^pro-?\s?vitamins?\s*", "")).alias("code"), r.rlike("(?i)^pro").alias("pro")))
        return F.filter(F.concat(F.array(lead), tail), lambda v: v["code"].rlike(r"^[A-Z]\d?$"))

    return F.flatten(F.transform(groups, members))


def window_texts(words: Column, lo: int, hi: int) -> Column:
    """Texts of the windows of lo..hi consecutive words (what ``word_windows`` gives with their places); each is made from the one a word shorter."""
    def every(ws):
        longer = lambda shorter, n: F.zip_with(shorter, F.slice(ws, n, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b))

        def upto(n, texts):  # past the end of the words a text is null
            of = [F.array_compact(texts)] if n >= lo else []
            return F.concat(*of, *([X.let(longer(texts, n + 1), lambda t: upto(n + 1, t))] if n < hi else []))
        return upto(1, ws)
    return X.let(words, every)


def word_windows(words: Column, lo: int, hi: int) -> Column:
    """Array of (n, i, text) windows of lo..hi consecutive words."""
    def every(ws):
        def of(n):
            starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice(ws, i + 1, n), " ").alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(lo), F.lit(hi)), of))
    return X.let(words, every)
