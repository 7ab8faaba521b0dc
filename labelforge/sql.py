"""Functions for SQL users: ``register(spark)`` adds match_key, title_case, indel_ratio, confusion_score and the table function segment_label.

The scalar string functions are SQL expressions that stay in the JVM; the similarities are Arrow functions; segment_label reads one printed
text and gives its segments as rows, as ``segment_labels`` does for a table.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from .functions import text as X
from .functions.similarity import confusion_score, indel_ratio
from .operators import segment as S
from .operators.segment import _CUT, _mark  # workers get these by value, without the module


def _compile(java: str) -> re.Pattern:
    """A pattern of the column functions; white space, digits and word ends are ASCII there."""
    return re.compile(java.replace(r"\z", r"\Z"), re.ASCII)


_LIST, _MAY, _BLEND, _PERCENT, _FOOT, _SENTENCE, _FIELD, _NANO = map(_compile, (S.LIST_LABEL, S.MAY_CONTAIN, S.BLEND, S.PERCENT, S.FOOTNOTE, S.SENTENCE, S.FIELD_LABEL, S.NANO))
_EDGE, _DOTS = _compile(r"^\s+|\s+\z"), _compile(r"^\s*\.*\s*|\s*\.*\s*\z")
_BREAK, _LINE, _GAP = _compile(r"-\s*\r?\n\s*"), _compile(r"\s*\r?\n\s*"), _compile(r"[ \t]+")


def segments(raw: str | None) -> Iterator[tuple[int, str, bool, list[str]]]:
    """(position, text, optional, tags) of one printed text."""
    if raw is None:
        return
    t = unicodedata.normalize("NFKC", raw).replace("­", "")
    t = _GAP.sub(" ", _LINE.sub(" ", _BREAK.sub("", t)).translate(str.maketrans("•·、", ",,,")))
    t = _LIST.sub("", _EDGE.sub("", t), count=1)
    pieces = _mark(t, "([", ")]").split(_CUT) if t else []
    parts = [b for p in pieces for s in ([p] if _FIELD.search(_EDGE.sub("", p)) else _SENTENCE.split(p)) for b in _BLEND.split(s)]
    position, optional = 0, False
    for body in filter(None, (_DOTS.sub("", p) for p in parts)):
        if _MAY.search(body):
            optional, body = True, _EDGE.sub("", _MAY.sub("", body))
        if not body:
            continue
        tags = ["nano"] if _NANO.search(body) else []
        if pct := _PERCENT.search(body):
            tags.append(f"label_percent={pct[1]}")
            body = _EDGE.sub("", _PERCENT.sub("", body))
        if _FOOT.search(body):
            tags.append("marker=*")
            body = _EDGE.sub("", _FOOT.sub("", body))
        yield position, body, optional, tags
        position += 1


class SegmentLabel:
    """Table function over one printed text."""
    COLUMNS = "position int, raw string, optional boolean, tags array<string>"

    def eval(self, raw: str):
        yield from segments(raw)


def register(spark: SparkSession) -> None:
    """Add the functions to the session, replacing older ones of the same name."""
    spark.udf.register("labelforge_nfkc", X._nfkc_batch)
    spark.udf.register("indel_ratio", indel_ratio)
    spark.udf.register("confusion_score", confusion_score)
    spark.udtf.register("segment_label", F.udtf(SegmentLabel, returnType=SegmentLabel.COLUMNS))
    may = X._MAY_CHANGE.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION match_key(s STRING) RETURNS STRING
        RETURN regexp_replace(upper(coalesce(labelforge_nfkc(CASE WHEN s RLIKE '{may}' THEN s END), s)), '[^A-Z0-9?]', '')""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION title_case(s STRING) RETURNS STRING
        RETURN translate(replace(initcap(regexp_replace(regexp_replace(lower(s), '([\\-/(\\t\\n\\r\\f\\x0B])', concat('$1', chr(1), ' ')), '(^|[ ])([^a-z ])', concat('$1', chr(2), '$2'))),
                                 concat(chr(1), ' '), ''), concat(chr(1), chr(2)), '')""")
