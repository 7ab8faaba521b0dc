"""Exact top-k inner-product search by block-at-a-time pruning.

Rows are dealt evenly into shards; inside a shard they are put in the order of their strongest component and cut into document-range
blocks. A block keeps its forward index (the vectors) and the largest and smallest value of every component, the block's term maxima. For a
query the summed maxima bound every score in a block: blocks are taken in falling order of that bound, scored through the forward index,
until the next bound is below the k-th best score. The shards' lists are merged by rank.

Queries are a stated set: they are packed in blocks, and each block meets each shard once. Nothing is broadcast or collected.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a shorter vector is filled up with zeros; rows
with the query's own id are no candidates; of several query rows with one id the smallest vector is the query, repeated candidate rows
count each; ties go to the smaller id; an empty table gives an empty result. Scores are exact while they stay below 2**53.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024
BLOCK_ROWS = 64


def quantise(vector, scale: float):
    """floor(scale * x) of every component, x as double; null where the vector takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ok, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")))


def _pack(df: DataFrame, key: str) -> DataFrame:
    """One row per key value: ids and matrix as bytes, and the width."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["v"]))
        m = np.zeros((len(pdf), width))
        for i, v in enumerate(pdf["v"]):
            m[i, :len(v)] = v
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()], "width": [width]})
    return df.groupBy(key).applyInPandas(pack, f"{key} long, ids binary, matrix binary, width int")


def block_order(m: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by strongest component, and per block the largest and smallest value of every component."""
    top = np.abs(m).argmax(axis=1) if m.shape[1] else np.zeros(len(m), int)
    value = m[np.arange(len(m)), top] if m.shape[1] else np.zeros(len(m))
    order = np.lexsort((value, top))
    at = np.arange(0, len(m), block)
    return order, np.maximum.reduceat(m[order], at, axis=0), np.minimum.reduceat(m[order], at, axis=0)


def search_shard(ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK_ROWS):
    """Best k rows of the shard for each query: lists of (query id, id, score)."""
    order, most, least = block_order(m, block)
    ids, m = ids[order], m[order]
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    out = []
    for qid, q, bound in zip(query_ids.tolist(), queries, bounds):
        ranked = np.argsort(-bound, kind="stable")
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        done, step = 0, 2
        while done < len(ranked) and (len(best_s) < k or bound[ranked[done]] >= best_s[-1]):
            take = ranked[done:done + step]
            rows = (take[:, None] * block + np.arange(block)).ravel()
            rows = rows[rows < len(m)]
            rows = rows[ids[rows] != qid]
            s, i = np.concatenate((best_s, m[rows] @ q)), np.concatenate((best_i, ids[rows]))
            keep = np.lexsort((i, -s))[:k]
            best_s, best_i = s[keep], i[keep]
            done, step = done + step, step * 2
        out.append((np.full(len(best_i), qid), best_i, best_s.astype(np.int64)))
    return out


def exact_top_k(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
                shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's id and ``score`` for every row that satisfies ``is_query``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("v"), is_query.alias("is_query")).filter("v is not null and id is not null")
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    # dealt by row, not by id, so that one repeated id cannot fill a shard
    docs = _pack(rows.select("id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard")), "shard")
    queries = rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v"))
    queries = _pack(queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks))), "part").select(
        F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                width = max(r.width, r.q_width)
                m, q = (np.pad(np.frombuffer(x).reshape(-1, w) if w else np.zeros((len(i) // 8, 0)), ((0, 0), (0, width - w))) for x, w, i in
                        ((r.matrix, r.width, r.ids), (r.q_matrix, r.q_width, r.q_ids)))
                found = search_shard(np.frombuffer(r.ids, np.int64), m, np.frombuffer(r.q_ids, np.int64), q, k)
                yield pd.DataFrame({c: np.concatenate([x[i] for x in found]) for i, c in enumerate(("query_id", "id", "score"))})
    pairs = docs.join(queries, "shard").repartition(min(shards * blocks, 4096))
    local = pairs.mapInPandas(search, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
