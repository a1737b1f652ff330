"""Approximate nearest neighbours by collision-counting hashing (query-aware: Huang et al., 2015).

Every shard of vectors is indexed by sorted arrays of its projections on random directions. A query opens a window around
its own projection in each array and widens all windows by virtual rehashing, round after round; a vector inside the window
in enough arrays is verified by its true distance. Rounds end when the k-th distance found is within the radius that the
windows stand for. Nothing caps candidates: whatever crosses the collision threshold is verified. Every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import LEAST_BYTES, TILE_BYTES, blocks, merged, met, opened, sound

#: Bytes of a shard's vectors; its index takes about as much again for each 21 components.
SHARD_BYTES = 1 << 24
PROJECTIONS = 32
#: A window reaches this many radii to each side of the query; a vector within the radius is in it with a chance of 0.83.
REACH = 1.36
#: Share of the windows in which a vector must lie to be verified.
COLLISIONS = 0.72
GROWTH = 1.2
#: The first radius is this share of the usual distance of a k-th neighbour, told by so many vectors of the shard.
START, PROBES = 0.8, 16
INDEX = "block long, dim int, ids binary, body binary, sorted binary, place binary, radius double"


def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((PROJECTIONS, dim))


def usual_radius(body: np.ndarray, k: int) -> float:
    """START times the median distance of the k-th neighbour of a few vectors spread over the shard."""
    found = []
    for x in body[:: max(1, len(body) // PROBES)]:
        far = ((body - x) ** 2).sum(axis=1)
        found.append(np.sqrt(np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]))
    return max(START * float(np.median(found)), 1e-9 * float(np.abs(body).max()), 1e-300)


def nearest(q: np.ndarray, own: int, ids: np.ndarray, body: np.ndarray, projected: np.ndarray, heights: np.ndarray, place: np.ndarray, k: int, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and distances of the k nearest found (more where distances tie), with own no candidate."""
    n, need = len(ids), COLLISIONS * PROJECTIONS
    counts = np.zeros(n, np.int32)
    lo = hi = [-1] * PROJECTIONS
    done = ids == own
    most = n - int(done.sum())
    at, far = np.zeros(0, np.int64), np.zeros(0)
    radius = start
    while len(at) < most:
        a = [h.searchsorted(p - REACH * radius) for h, p in zip(heights, projected)]
        b = [h.searchsorted(p + REACH * radius, "right") for h, p in zip(heights, projected)]
        wider = [p[x:y] for p, x, y in zip(place, a, b)] if lo[0] < 0 else [p[s:t] for p, x, y, u, v in zip(place, a, b, lo, hi) for s, t in ((x, u), (v, y)) if s < t]
        counts += np.bincount(np.concatenate(wider), minlength=n) if wider else 0
        lo, hi = a, b
        new = np.flatnonzero((counts >= need) & ~done)
        if len(new):
            done[new] = True
            gap = body[new] - q
            at, far = np.concatenate([at, new]), np.concatenate([far, np.sqrt((gap * gap).sum(axis=1))])
        if len(at) >= min(k, most) and np.partition(far, min(k, most) - 1)[min(k, most) - 1] <= radius:
            break
        radius *= GROWTH
    if len(at) > k:
        keep = far <= np.partition(far, k - 1)[k - 1]
        at, far = at[keep], far[keep]
    order = np.lexsort((ids[at], far))[:k]
    return at[order], far[order]


def search(vectors: DataFrame, is_query, k: int = 10, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance, smallest first, ties to the smaller vec_id) of the k nearest found
    for each vector for which is_query (a Column) holds, itself excepted; all others, if there are fewer.

    Vectors null, zero, empty, with a null id or holding null or non-finite components take no part. Vectors meet those of
    their own dimension only. Of several rows of one vec_id, that of the smallest embedding counts. No rows: no rows;
    other columns don't matter.
    """
    v = materialize(sound(vectors, zero=False), "ann-vectors")
    form = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "body", "sorted", "place")), ("radius", pa.float64())])

    def index(batches):
        for b in batches:
            for r in b.to_pylist():
                _, body = opened(r["ids"], r["body"], r["dim"])
                heights = directions(r["dim"], seed) @ body.T
                place = np.argsort(heights, axis=1, kind="stable")
                yield pa.RecordBatch.from_pylist([r | {"sorted": np.take_along_axis(heights, place, axis=1).tobytes(), "place": place.astype("<i4").tobytes(), "radius": usual_radius(body, k)}], schema=form)

    shards = materialize(blocks(v, "shard", SHARD_BYTES, LEAST_BYTES).mapInArrow(index, INDEX), "ann-index")
    tiles = materialize(blocks(v.filter(is_query), "tile", TILE_BYTES), "ann-tiles")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("shard", pa.int64()), ("shards", pa.int64())])

    def prepare(r):
        ids, body = opened(r["ids"], r["body"], r["dim"])
        heights = np.frombuffer(r["sorted"], "<f8").reshape(PROJECTIONS, len(ids))
        place = np.frombuffer(r["place"], "<i4").reshape(PROJECTIONS, len(ids))
        return r["block"], ids, body, heights, place, r["radius"], directions(r["dim"], seed)

    def answer(shard, q_ids, q):
        block, ids, body, heights, place, radius, along = shard
        cols = [[], [], []]
        for x, own, p in zip(q, q_ids, q @ along.T):
            at, far = nearest(x, own, ids, body, p, heights, place, k, radius)
            cols[0].append(np.full(len(at), own)), cols[1].append(ids[at]), cols[2].append(far)
        if cols[0]:
            i, j, s = map(np.concatenate, cols)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s), pa.array(np.full(len(i), block)), pa.array(np.full(len(i), block + 1))], schema=out)

    found = materialize(met(shards, tiles, prepare, answer, "query_id long, vec_id long, score double, shard long, shards long"), "ann-found")
    order = "CASE WHEN x.score < y.score THEN -1 WHEN x.score > y.score THEN 1 WHEN x.vec_id < y.vec_id THEN -1 WHEN x.vec_id > y.vec_id THEN 1 ELSE 0 END"
    return merged(found, k, order)
