"""Secret scan by assignment-aware lexing.

Source and configuration text is read as name-literal pairs (``name = "x"``, ``"name": "x"``, ``export NAME=x``, ``name => 'x'``, also
``"a" + "b"`` and ``$NAME`` inside a value). Constants met earlier in the text are propagated into later values, and each literal is
scored by how sensitive its target name is and how random it looks. Three plain patterns (assign, access, hex) are always reported too.

Defined cases: a null text is the empty text and has no spans; repeated rows are scanned each on its own; a name assigned twice stands
for its latest value; an empty table gives an empty result; other columns are never read. Places count code points, ends are exclusive.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, map_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "named", "constant")
#: A literal is reported from this score on.
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_SEPARATOR = re.compile(r":=|=>|=(?!=)|:(?!:)")
#: A name of any length that ends before the separator, in the reversed text.
_EMAN = re.compile(r"""[ \t]*["'\]]{0,2}([\w$.\-]*[A-Za-z_$])""", re.A)
_VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|\$\{?([A-Za-z_]\w*)\}?|([A-Za-z0-9_$+/.=\-]+))""", re.A)
_PLUS = re.compile(r"[ \t]*\+(?=[ \t]*[\"'`$A-Za-z_])")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Fixed weights of the words of a name: how likely its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "key": 0.6,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "signature": 0.5, "salt": 0.5, "pin": 0.5,
}
#: Words that say the value is about a secret, not one.
HARMLESS = {"name", "path", "file", "url", "id", "length", "type", "count", "hint", "field", "public"}


def name_weight(name: str) -> float:
    """How sensitive a target name is, from 0 to 1, by its snake, kebab or camel parts."""
    parts = [w.lower() for w in _WORD.findall(name.rsplit(".", 1)[-1])]
    if parts and parts[-1] in HARMLESS:
        return 0.0
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    pairs = {a + b for a, b in zip(parts, parts[1:])}
    return 1.0 if pairs & {"apikey", "accesskey", "secretkey", "privatekey"} else best


def literal_weight(text: str) -> float:
    """How random a literal looks, from 0 to 1: length and entropy; placeholders and very short values score low."""
    return _weight(Counter(text), len(text))


def _weight(counts: dict, n: float) -> float:
    """``literal_weight`` of a text of these characters."""
    chars = "".join(counts)
    if n < 6 or len(counts) < 4 or chars.strip("xX*.<>-_ ") == "":
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    kinds = sum(map(bool, (re.search("[a-z]", chars), re.search("[A-Z]", chars), re.search("[0-9]", chars), re.search(r"[^A-Za-z0-9\s]", chars))))
    return min(1.0, 0.2 + 0.1 * kinds + min(entropy, 4.0) / 8 + (0.1 if n >= 16 else 0.0) - (0.3 if " " in counts else 0.0))


class _Value:
    """A value as its pieces in order: spans of the text, and the values of constants, which are shared and never copied."""

    __slots__ = ("parts", "counts", "reported")

    def __init__(self, parts: list):
        self.parts, self.counts, self.reported = parts, None, 0.0

    def weigh(self, text: str) -> float:
        """``literal_weight`` of the joined pieces. Counts are (character to count, length, power of two): a value may double on every line."""
        todo = [self]
        while todo:
            v = todo[-1]
            inner = [p for p in v.parts if isinstance(p, _Value) and p.counts is None] if v.counts is None else []
            if inner:
                todo += inner
                continue
            todo.pop()
            if v.counts is None:
                power = max([p.counts[2] for p in v.parts if isinstance(p, _Value)], default=0)
                all_, n = {}, 0.0
                for p in v.parts:
                    c, m, e = p.counts if isinstance(p, _Value) else (Counter(text[p[0]:p[1]]), p[1] - p[0], 0)
                    for k, x in c.items():
                        all_[k] = all_.get(k, 0.0) + math.ldexp(x, e - power)
                    n += math.ldexp(m, e - power)
                while n > 2.0 ** 50:
                    all_, n, power = {k: x / 2.0 ** 25 for k, x in all_.items()}, n / 2.0 ** 25, power + 25
                v.counts = all_, n, power
        return _weight(*self.counts[:2])

    def report(self, score: float, name: str, out: dict) -> None:
        """Record every span once under its best score; values all of whose spans have this score already are passed over."""
        todo, seen = [self], {id(self)}
        while todo:
            v = todo.pop()
            if v.reported >= score:
                continue
            v.reported = round(score, 4)
            for p in v.parts:
                if isinstance(p, _Value):
                    if id(p) not in seen:
                        seen.add(id(p))
                        todo.append(p)
                elif p[1] > p[0] and (p not in out or out[p][3] < score):
                    out[p] = ("named" if v is self else "constant", *p, round(score, 4), name)


def _value(text: str, at: int, known: dict) -> list:
    """Pieces of the value that begins at ``at``: spans, and values of constants."""
    out = []
    while m := _VALUE.match(text, at):
        k = m.lastindex
        name = m[k]
        if k == 4 or k == 5 and name in known:
            out += [known[name]] if name in known else []
        elif k == 5 and "." in name and not any(c.isdigit() for c in name):
            pass  # an attribute or a file name, no literal
        else:
            out.append(m.span(k))
        more = _PLUS.match(text, m.end())
        if not more:
            break
        at = more.end()
    return out


def assignments(text: str) -> list[tuple[str, int, int, float, str]]:
    """Spans (kind, start, end, score, name) of the literals that sensitive names get, directly or through constants."""
    known: dict[str, _Value] = {}
    out: dict[tuple[int, int], tuple[str, int, int, float, str]] = {}
    back = text[::-1]
    for sep in _SEPARATOR.finditer(text):
        m = _EMAN.match(back, len(text) - sep.start())
        if not m:
            continue
        pieces = _value(text, sep.end(), known)
        if not pieces:
            continue
        name = m[1][::-1]
        value = known[name] = _Value(pieces)
        weight = name_weight(name)
        if not weight:
            continue
        score = weight * value.weigh(text)
        if score >= THRESHOLD:
            value.report(score, name, out)
    return list(out.values())


def scan(text: str | None) -> list[tuple[str, int, int, float, str]]:
    """All spans of one text, by start, then kind."""
    if not text:
        return []
    out = []
    assigned = "=" in text or ":" in text
    if assigned:
        out += [("assign", *m.span(), 1.0, m[1]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += assignments(text)
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0, "") for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), 1.0, "") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``spans`` (kind, start, end, score, name) by start, then kind. A map without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def step(b):
            rows = [[dict(zip(("kind", "start", "end", "score", "name"), s)) for s in scan(t)] for t in b.column(1).to_pylist()]
            return batch(id=b.column(0), spans=pa.array(rows, _SPANS))
        return step
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(named, ["id", "text"], "text", make, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double,name:string>>").withColumnRenamed("id", id_col)


def span_text(spans):
    """Column: kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
