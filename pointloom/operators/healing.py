"""Healing: fragments whose points come close are one object; gaps between them are filled with points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize

from .components import FEW, connected_components
from .distance import nearest_of_others
from .util import one_row


def slabs(points: DataFrame, gap: float, n: int) -> DataFrame:
    """points with each slab they belong to and its far boundary: n slabs along x, each reaching a gap into the next."""
    edges = one_row(points, F.min("x").alias("x0"), F.max("x").alias("x1"))
    wide = points.crossJoin(edges).withColumn("width", (F.col("x1") - F.col("x0")) / n)
    slot = lambda x: F.floor((x - F.col("x0")) / F.col("width"))
    low = F.greatest(F.lit(0), slot(F.col("x") - gap) - 1)
    high = F.least(F.lit(n - 1), slot(F.col("x")) + 1)
    wide = wide.filter("width > 0").withColumn("slab", F.explode(F.sequence(low, F.greatest(low, high)))).withColumn("start", F.col("x0") + F.col("slab") * F.col("width"))
    ends = F.col("start") + F.col("width") + F.lit(gap)
    return wide.filter((F.col("x") >= F.col("start")) & (F.col("x") < ends)).withColumn("boundary", F.col("start") + F.col("width")).drop("x0", "x1", "width", "start")


def connections(points: DataFrame, gap: float, n_slabs: int = 10) -> DataFrame:
    """slab, a, b, d2, src, dst: for each point of a fragment and each higher-numbered fragment, its nearest point of that within
    the gap, slab by slab (J09, F13). Ties go to the smaller point_id.

    A nearest point within the gap is the nearest at all, so candidates beyond it need not be seen, and of those within it only
    points of leaves that may hold the nearest are."""
    best = nearest_of_others(slabs(points, gap, n_slabs), gap, "fragment", "slab", "boundary")
    return best.filter("xa <= boundary OR xb <= boundary").select("slab", "a", "b", "d2", "src", "dst")


def fillers(links: DataFrame, points: DataFrame, resolution: float) -> DataFrame:
    """src, dst, a, b, step, x, y, z, r, g, b_: points evenly between the ends of each connection."""
    end = lambda p: points.select(F.col("point_id").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("x", "y", "z", "red", "green", "blue")])
    n = F.floor(F.sqrt("d2") / F.lit(resolution)).cast("int")
    rows = links.withColumn("steps", n).filter("steps > 0").join(end("a"), "a").join(end("b"), "b")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps")))).withColumn("ratio", F.col("step") / (F.col("steps") + 1))
    mixed = lambda c: ((1 - F.col("ratio")) * F.col(f"{c}_a") + F.col("ratio") * F.col(f"{c}_b")).alias(c)
    return rows.select("slab", "src", "dst", "a", "b", "step", *map(mixed, ("x", "y", "z", "red", "green", "blue")))


def groups(points: DataFrame, links: DataFrame) -> DataFrame:
    """fragment, group_root, n_fragments and name: fragments that connections hold together (G03); lone ones are isolated."""
    all_ = points.select("fragment").distinct()
    found = connected_components(links.select("src", "dst").distinct(), "src", "dst", FEW)
    rooted = all_.join(found, F.col("fragment") == F.col("node"), "left").select("fragment", F.coalesce("component", "fragment").alias("group_root"))
    sizes = rooted.groupBy("group_root").agg(F.count(F.lit(1)).alias("n_fragments"))
    name = F.when(F.col("n_fragments") > 1, F.concat(F.lit("merged_group_"), "group_root")).otherwise(F.concat(F.lit("isolated_"), "fragment"))
    return rooted.join(sizes, "group_root").withColumn("name", name)


def healed(points: DataFrame, gap: float, resolution: float, n_slabs: int = 10) -> DataFrame:
    """name, filler, x, y, z, red, green, blue: all points by healed object, fillers with them."""
    links = materialize(connections(points, gap, n_slabs), "links")
    g = groups(points, links).select("fragment", "name")
    cols = ["name", "filler", "x", "y", "z", "red", "green", "blue"]
    own = points.join(g, "fragment").withColumn("filler", F.lit(False)).select(*cols)
    new = fillers(links, points, resolution).join(g, F.col("src") == F.col("fragment")).withColumn("filler", F.lit(True)).select(*cols)
    return own.unionByName(new)
