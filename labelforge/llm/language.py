"""Language identification by multilingual mixture inference.

Learning counts character trigrams (hashed, lower-cased, non-letters as one blank) per language over all usable rows. A document is a
mixture of languages: expectation-maximisation estimates the proportions from the trigram likelihoods, and the set of languages is the
one of best penalised likelihood among the nested sets of the most likely languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned; ties go to the
alphabetically first language; repeated rows are judged each on its own; rows without a language are not learned from; an empty
table gives an empty result; other columns are never read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TooLarge, batch, map_texts, slices

BUCKETS = 1 << 15
#: Most languages a model may have; bounds the counts that reach the driver and the broadcast model.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
STEPS = 15
#: Text bytes that are counted or judged at a time; the arrays of a slice take about fifty times as much.
SLICE = 512 << 10
#: Penalty per further language, times the logarithm of the number of trigrams; overlapping trigrams are no independent draws.
PENALTY = 3.0
#: A language whose estimated proportion is below this is never added.
LEAST_SHARE = 0.02
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every trigram whose middle is a letter."""
    low = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[points]
    c = np.where(letter, points, 32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)
    middle = np.flatnonzero(letter[1:-1])
    ends = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    return np.searchsorted(ends, middle, "right"), h[middle].astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams per language in each task, add the counts up, and keep smoothed log probabilities."""
    def count(batches):
        seen: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield batch(lang=pa.array([lang] * len(at), pa.string()), bucket=pa.array(at.astype(np.int32)), n=pa.array(n[at]))
            seen.clear()
        for b in slices(batches, "text", SLICE):
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            doc, bucket = trigrams(b.column(1).to_pylist())
            n = np.bincount(number[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for k, lang in enumerate(names):
                seen[lang] = seen[lang] + n[k] if lang in seen else n[k]
            if len(seen) > MAX_LANGUAGES:
                yield from rows()
        yield from rows()
    used = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = used.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    at_most = MAX_LANGUAGES * BUCKETS
    got = counts.filter("n > 0").limit(at_most + 1).toPandas()
    languages = sorted(got["lang"].unique())
    if len(languages) > MAX_LANGUAGES or len(got) > at_most:
        raise TooLarge(f"more than {MAX_LANGUAGES} languages")
    n = np.zeros((BUCKETS, len(languages)))
    n[got["bucket"].to_numpy(), np.searchsorted(languages, got["lang"])] = got["n"]
    return LanguageModel(list(languages), np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * BUCKETS)))


def _em(p, doc_row, starts, count, total, allowed, steps=STEPS):
    """Proportions per document over its allowed languages, and the log likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        r = p * share[doc_row]
        s = r.sum(axis=1)
        share = np.add.reduceat(r * (count / s)[:, None], starts, axis=0) / total[:, None]
    s = (p * share[doc_row]).sum(axis=1)
    return share, np.add.reduceat(count * np.log(np.maximum(s, 1e-300)), starts)


def infer(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of texts with letters, and their proportions over the languages of the selected set (0 elsewhere)."""
    doc, bucket = trigrams(texts)
    width = len(model.languages)
    if not len(doc) or not width:
        return np.zeros(0, np.int64), np.zeros((0, width))
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    rows, at = np.unique(key // BUCKETS, return_index=True)
    row = np.repeat(np.arange(len(rows)), np.diff(np.append(at, len(key))))
    logs = model.log_p[key % BUCKETS]
    p = np.exp(logs)
    total = np.add.reduceat(count, at).astype(float)
    single = np.add.reduceat(logs * count[:, None], at, axis=0)
    full, _ = _em(p, row, at, count, total, np.ones((len(rows), width)))
    best = np.zeros((len(rows), width))
    best[np.arange(len(rows)), single.argmax(axis=1)] = 1.0
    value = single.max(axis=1)
    order = np.argsort(-full, axis=1, kind="stable")
    live = np.arange(len(rows))
    for size in range(2, width + 1):
        live = live[full[live, order[live, size - 1]] >= LEAST_SHARE]
        if not len(live):
            break
        use = np.flatnonzero(np.isin(row, live))
        sub = np.searchsorted(live, row[use])
        begin = np.searchsorted(sub, np.arange(len(live)))
        allowed = np.zeros((len(live), width))
        np.put_along_axis(allowed, order[live, :size], 1.0, axis=1)
        share, ll = _em(p[use], sub, begin, count[use], total[live], allowed)
        ll = ll - PENALTY * (size - 1) * np.log(total[live] + 1)
        better = ll > value[live]
        best[live[better]], value[live[better]] = share[better], ll[better]
        live = live[better]
    # a share of one among few trigrams is less sure than among many
    return rows, np.where(best > 0, (best * total[:, None] + 1 / width) / (total[:, None] + 1), 0.0)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``lang_pred`` (largest proportion of the selected set), ``score`` (that proportion) and ``mixture``
    (language to proportion). A map without a shuffle; the model's size is bounded by MAX_LANGUAGES x BUCKETS."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(b):
            rows, share = infer(b.column(1).to_pylist(), model)
            pred, score, mixture = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows, [[] for _ in range(b.num_rows)]
            for i, top, values in zip(rows.tolist(), share.argmax(axis=1).tolist() if len(rows) else [], share.tolist()):
                pred[i], score[i] = model.languages[top], values[top]
                mixture[i] = [(m, v) for m, v in zip(model.languages, values) if v > 0]
            return batch(id=b.column(0), lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()), mixture=pa.array(mixture, pa.map_(pa.string(), pa.float64())))
        return step
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(named, ["id", "text"], "text", make, f"id {kind}, lang_pred string, score double, mixture map<string,double>", SLICE).withColumnRenamed("id", id_col)
