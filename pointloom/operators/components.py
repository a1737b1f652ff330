"""Connected components of an undirected graph by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation with map-side combine and a join on nodes, which adaptive execution can split, so a node with a
large share of all edges costs no task more than others. Rounds end when the edges stop changing, after a number of rounds
that grows with the logarithm of the graph. Where few edges are left, at the start or after some rounds, one task settles them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize


#: Edges that one task settles: 16 MB.
FEW = 1 << 20


def settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the smallest node that each hangs together with: roots are hooked under smaller ones and paths halved
    until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        found = settled(t.column("u").to_numpy(), t.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).repartition(1).mapInArrow(run, "node long, component long")


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """node and component (its smallest node) for each node of an edge between two different nodes; nulls are no nodes.

    few: with so many edges or fewer left, at most FEW, and nodes that are whole numbers, one task does the rest."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "components")
    seen = None
    while True:
        checked = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if checked == seen or not checked[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if checked[0] <= few:
            return materialize(_in_one_task(e), "components")
        seen = checked
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_lowest(both), F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        small = large.join(_lowest(large), F.col("u") == F.col("node"))
        small = small.select(F.col("u"), F.col("low").alias("v")).unionByName(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
        e = materialize(small.distinct(), "components")
