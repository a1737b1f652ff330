"""Vectors in blocks: what the searches over vectors share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Bytes of a shard where there are enough of them to go round, and the least.
SHARD_BYTES, LEAST_BYTES = 1 << 26, 1 << 20
#: Bytes of a query tile, which each shard's task reads after its shard.
TILE_BYTES = 1 << 20
BLOCK = "block long, dim int, ids binary, body binary"


def sound(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id and embedding (doubles) of what takes part: no null, no null or non-finite component, no null id; no vector
    without a component other than zero, unless ``zero`` says so.

    Of several rows of one vec_id, that of the smallest embedding counts."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    v = v if zero else v.filter("exists(embedding, x -> x <> 0)")
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def blocks(v: DataFrame, salt: str, most: int, least: int | None = None) -> DataFrame:
    """Vectors of one dimension dealt by hash into blocks: block, dim, ids (int64), body (float64 rows in order of vec_id).

    A block has about ``most`` bytes; with ``least`` it has fewer where that gives all cores a block, but about so many."""
    v = v.select("vec_id", "embedding", F.size("embedding").alias("dim"))
    size = F.count(F.lit(1)) * 8 * F.greatest(F.lit(1), F.col("dim"))
    go_round = F.least(F.lit(v.sparkSession.sparkContext.defaultParallelism), F.ceil(size / (least or most)))
    n = v.groupBy("dim").agg(F.greatest(F.ceil(size / most), go_round if least else F.lit(1)).cast("long").alias("blocks"))
    dealt = v.join(F.broadcast(n) if _few(n) else n, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col("blocks")))

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy().astype("<i8")
        dim = t.column("dim")[0].as_py()
        body = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8") if dim else np.zeros(0)
        return pa.table([pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([body.tobytes()], pa.binary())], names=["block", "dim", "ids", "body"])

    return dealt.groupBy("block", "dim").applyInArrow(gather, BLOCK)


def _few(n: DataFrame) -> bool:
    """A row for each dimension, few enough of them to send to all tasks."""
    return n.limit(1001).count() <= 1000


def opened(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(body, "<f8").reshape(len(i), dim)


def met(shards: DataFrame, tiles: DataFrame, prepare, answer, schema: str) -> DataFrame:
    """What ``answer`` makes of every query tile and every shard of its dimension.

    A shard goes to one task, once, as its first row; the tiles, a small share of all vectors, are copied to every shard and
    stream past it. ``prepare`` gets a shard's row as a dict, ``answer`` what it made and a tile's ids and rows, and yields
    record batches of ``schema``."""
    n = shards.groupBy("dim").agg((F.max("block") + 1).alias("shards"))
    n = F.broadcast(n) if _few(n) else n
    more = [c for c in shards.columns if c not in ("block", "dim", "ids", "body")]
    of = {f.name: f.dataType for f in shards.schema.fields}
    first = shards.select("block", "dim", F.lit(0).alias("tile"), "ids", "body", *more)
    copies = tiles.join(n, "dim").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("block"), "dim", F.lit(1).alias("tile"), "ids", "body", *(F.lit(None).cast(of[c]).alias(c) for c in more))

    def run(batches):
        key, shard = None, None
        for b in batches:
            for k in range(len(b)):
                r = b.slice(k, 1).to_pylist()[0]
                if not r["tile"]:
                    key, shard = (r["block"], r["dim"]), prepare(r)
                elif key == (r["block"], r["dim"]):
                    ids, body = opened(r["ids"], r["body"], r["dim"])
                    yield from answer(shard, ids, body)
        shard = None
        release()

    parts = max(1, shards.count())
    return first.unionByName(copies).repartitionById(parts, F.col("block").cast("int")).sortWithinPartitions("block", "dim", "tile").mapInArrow(run, schema)


def merged(found: DataFrame, k: int, best_first, fan_in: int = 16) -> DataFrame:
    """The k best rows of each query, merged in a tree: lists of up to fan_in shards at a time, until one is left.

    found: query_id, vec_id, score, shard, shards (their number). best_first: an SQL order of x and y in lists of score, vec_id."""
    many = found.agg(F.max("shards")).first()[0] or 1
    for level in range(max(1, math.ceil(math.log(max(2, many), fan_in)))):
        found = found.withColumn("shard", F.floor(F.col("shard") / fan_in))
        lists = found.groupBy("query_id", "shard").agg(F.expr(f"slice(array_sort(collect_list(struct(score, vec_id)), (x, y) -> {best_first}), 1, {k})").alias("top"))
        found = lists.select("query_id", "shard", F.inline("top"))
    return lists.select("query_id", F.posexplode("top").alias("n", "x")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
