"""Exact search of the highest inner products: tiled matrix products, a partial selection per tile, a tree of merges.

Candidates lie in shards of a few MB, each read once by a task, past which all blocks of queries stream. A tile is the product
of some queries and a part of a shard; of each query it keeps the k best, so what leaves a shard is small, and lists of
shards are merged a few at a time. Components are made integers first, so products are exact and ties are real ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import LEAST_BYTES, SHARD_BYTES, TILE_BYTES, blocks, merged, met, opened, sound

#: Queries and candidates of one product.
STEP, PART = 512, 8192


#: Stands for a score that 64 bits don't hold: below and above all that they do.
UNDER, OVER = -(2**63), 2**63 - 1


def tile_top(queries: np.ndarray, q_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query index, shard index and score of each query's k best in the shard, and maybe more of rows that are apart; ids ascend,
    so ties go to the smaller.

    A candidate of the query's own id is no candidate. Sums below 2^53 are exact in doubles; larger ones use integers, and rows
    whose products 64 bits may not hold are multiplied by themselves in numbers of any length: their scores, where they don't
    fit, are UNDER or OVER."""
    of = lambda x: np.abs(x).max(axis=1, initial=0)
    most_q, most_s, width = of(queries), of(shard), max(1, queries.shape[1])
    # Components below the root leave every product within 63 bits; larger rows are apart.
    root = np.sqrt(2.0**62 / width)
    big_q, big_s = (np.flatnonzero(m >= root) for m in (most_q, most_s)) if most_q.max(initial=0) * most_s.max(initial=0) * width >= 2.0**62 else (np.zeros(0, int),) * 2
    out = []
    own_q, own_s = np.setdiff1d(np.arange(len(queries)), big_q), np.setdiff1d(np.arange(len(shard)), big_s)
    if len(own_q) and len(own_s):
        out.append(_best(queries[own_q], q_ids[own_q], shard[own_s], ids[own_s], k, own_q, own_s))
    for rows, cols in ((big_q, np.arange(len(shard))), (own_q, big_s)):
        for r in rows.tolist() if len(cols) else ():
            out.append(_long(queries[r], q_ids[r], shard[cols], ids[cols], k, r, cols))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]).astype(np.int64) for x in zip(*out)) if out else (none,) * 3


def _best(queries, q_ids, shard, ids, k: int, rows_of: np.ndarray, cols_of: np.ndarray):
    bound = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * max(1, queries.shape[1])
    product = queries @ shard.T if bound < 2.0**53 else (queries.astype(np.int64) @ shard.astype(np.int64).T)
    low = np.array(-np.inf) if product.dtype.kind == "f" else np.iinfo(np.int64).min
    product[q_ids[:, None] == ids[None]] = low
    rows, cols, scores = [], [], []
    every = np.arange(len(queries))
    for _ in range(min(k, len(ids))):
        at = product.argmax(axis=1)  # the first of equals
        best = product[every, at]
        ok = best != low
        rows.append(rows_of[every[ok]]), cols.append(cols_of[at[ok]]), scores.append(best[ok])
        product[every, at] = low
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]).astype(np.int64) for x in (rows, cols, scores))


def _long(query: np.ndarray, q_id: int, shard: np.ndarray, ids: np.ndarray, k: int, row: int, cols_of: np.ndarray):
    """One query against some rows, in whole numbers of any length."""
    q = [int(x) for x in query.tolist()]
    found = [(-sum(a * int(b) for a, b in zip(q, r)), n) for n, (r, c) in enumerate(zip(shard.tolist(), ids.tolist())) if c != q_id]
    best = sorted(found)[:k]
    return np.full(len(best), row), cols_of[[n for _, n in best]] if best else np.zeros(0, np.int64), np.array([max(UNDER, min(OVER, -s)) for s, _ in best], np.int64)


def top_products(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector for which is_query (a Column) holds, the k others of the highest
    inner product of floor(scale * component), ties to the smaller vec_id.

    Vectors null, with a null id or holding null or non-finite components take no part. Vectors meet those of their own
    dimension only. Of several rows of one vec_id, that of the smallest embedding counts. Products of any size are compared;
    a wanted score that 64 bits don't hold is an error. No rows: no rows; other columns don't matter.
    """
    # From 2^53 on doubles are whole numbers.
    whole = "transform(embedding, x -> if(abs({0}D * x) < 9007199254740992D, cast(floor({0}D * x) as double), {0}D * x))"
    v = materialize(sound(vectors).withColumn("embedding", F.expr(whole.format(repr(scale)))), "topk-vectors")
    shards = materialize(blocks(v, "shard", SHARD_BYTES, LEAST_BYTES), "topk-shards")
    tiles = materialize(blocks(v.filter(is_query), "tile", TILE_BYTES), "topk-tiles")
    form = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64()), ("shards", pa.int64())])

    def prepare(r):
        return r["block"], *opened(r["ids"], r["body"], r["dim"])

    def answer(shard, q_ids, q):
        block, ids, body = shard
        for a in range(0, len(q), STEP):
            found = []
            for b in range(0, len(ids), PART):
                i, j, s = tile_top(q[a : a + STEP], q_ids[a : a + STEP], body[b : b + PART], ids[b : b + PART], k)
                found.append((i, ids[b + j], s))
            i, at, s = map(np.concatenate, zip(*found))
            order = np.lexsort((at, ~s, i))  # the k best of all parts; ~s falls as s grows, at every size
            i, at, s = i[order], at[order], s[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, at, s = i[best], at[best], s[best]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + i]), pa.array(at), pa.array(s), pa.array(np.full(len(i), block)), pa.array(np.full(len(i), block + 1))], schema=form)

    found = materialize(met(shards, tiles, prepare, answer, "query_id long, vec_id long, score long, shard long, shards long"), "topk-found")
    order = "CASE WHEN x.score > y.score THEN -1 WHEN x.score < y.score THEN 1 WHEN x.vec_id < y.vec_id THEN -1 WHEN x.vec_id > y.vec_id THEN 1 ELSE 0 END"
    fits = F.col("score").between(UNDER + 1, OVER - 1)
    return merged(found, k, order).withColumn("score", F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("a score exceeds 64-bit integers; use a smaller scale")).cast("long")))
