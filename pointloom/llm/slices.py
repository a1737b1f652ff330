"""Adding up arrays of fixed size that tasks have made, in slices and in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 64
#: The most arrays that one task adds up.
FAN_IN = 128
SCHEMA = "slice int, body binary"
FORM = pa.schema([("slice", pa.int32()), ("body", pa.binary())])


def sliced(array: np.ndarray) -> Iterator[dict]:
    """Rows of an array's parts that hold anything, compressed. Its length is a multiple of SLICES."""
    codec = pa.Codec("zstd", 1)
    for k, part in enumerate(np.split(array, SLICES)):
        if part.any():
            yield {"slice": k, "body": codec.compress(part.tobytes(), asbytes=True)}


def saturating(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """Sums of unsigned counts that stay at the largest number rather than begin again."""
    total = a + b
    total[total < a] = np.iinfo(total.dtype).max
    out[:] = total


def added(rows: DataFrame, size: int, kind: str, combine=np.add, finish=lambda x: x) -> np.ndarray:
    """All tasks' arrays combined, then finished slice by slice: what reaches the driver has one size whatever the input.

    rows is read twice, so it should be a table."""
    dtype, each = np.dtype(kind), size // SLICES

    def merge(last: bool):
        def run(t: pa.Table) -> pa.Table:
            codec, total = pa.Codec("zstd", 1), np.zeros(each, dtype)
            for body in t.column("body"):
                combine(total, np.frombuffer(codec.decompress(body.as_py(), each * dtype.itemsize), dtype), out=total)
            body = finish(total).tobytes() if last else codec.compress(total.tobytes(), asbytes=True)
            return pa.table([t.column("slice").slice(0, 1), pa.array([body], pa.binary())], names=["slice", "body"])

        return run

    tasks = rows.groupBy("slice").count().agg(F.max("count")).first()[0] or 0
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(tasks))).groupBy("slice", "part").applyInArrow(merge(False), SCHEMA)
    empty = finish(np.zeros(each, dtype))
    out = [empty] * SLICES
    whole = np.concatenate(out)
    for r in rows.groupBy("slice").applyInArrow(merge(True), SCHEMA).toLocalIterator():
        k = r["slice"] * len(empty)
        whole[k : k + len(empty)] = np.frombuffer(r["body"], empty.dtype)
    return whole
