"""Voxel grids, connected components of point clouds, and filters by component size."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize

from .components import FEW, connected_components
from .util import one_row, scalars

#: One of each two opposite neighbours of a voxel.
HALF = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def voxel_size(points: DataFrame, level: int) -> DataFrame:
    """One row: origin (ox, oy, oz) and edge length of a cube of 2^level voxels a side around all points."""
    lows = [F.min(c).alias(f"lo_{c}") for c in "xyz"] + [F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("most")]
    pad = F.col("most") * 0.001
    return F.broadcast(points.agg(*lows).select(*[(F.col(f"lo_{c}") - pad).alias(f"o{c}") for c in "xyz"], ((F.col("most") + 2 * pad) / (1 << level)).alias("voxel")))


def voxelize(points: DataFrame, level: int) -> DataFrame:
    """points with i, j, k, their voxel. All points at one place share voxel 0."""
    index = lambda c: F.when(F.col("voxel") > 0, F.floor((F.col(c) - F.col(f"o{c}")) / F.col("voxel"))).otherwise(0).cast("long")
    grid = points.crossJoin(voxel_size(points, level))
    return grid.withColumns({"i": index("x"), "j": index("y"), "k": index("z")}).drop("ox", "oy", "oz", "voxel")


def voxel_edges(voxels: DataFrame) -> DataFrame:
    """a, b: ids (vid) of occupied voxels that touch by a face, an edge or a corner."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip(d, ("di", "dj", "dk"))]) for d in HALF])).alias("d")
    near = voxels.select(F.col("vid").alias("a"), "i", "j", "k", steps).select("a", (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), (F.col("k") + F.col("d.dk")).alias("k"))
    return near.join(voxels.select(F.col("vid").alias("b"), "i", "j", "k"), ["i", "j", "k"]).select("a", "b")


def octree_components(points: DataFrame, level: int) -> DataFrame:
    """point_id and root: the smallest point_id among points whose voxels hang together (G01). The graph is one of voxels."""
    grid = voxelize(points, level)
    voxels = grid.groupBy("i", "j", "k").agg(F.min("point_id").alias("vid"))
    found = connected_components(voxel_edges(voxels), few=FEW)
    rooted = voxels.join(found, F.col("vid") == F.col("node"), "left").select("i", "j", "k", F.coalesce("component", "vid").alias("root"))
    return grid.join(rooted, ["i", "j", "k"]).select("point_id", "root")


def eps_of(points: DataFrame, level: int | None = None, eps: float | None = None) -> float:
    """The longest side over 2^level unless given."""
    if eps is None:
        side = scalars(points, F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]))[0] or 0.0
        eps = side / (1 << (level or 0))
    return eps


def dbscan_components(points: DataFrame, level: int | None = None, eps: float | None = None) -> DataFrame:
    """point_id and root of points that steps of at most eps connect; eps is the longest side over 2^level unless given.

    Points of a cell whose diagonal is shorter than eps hang together, so the smallest point_id of a cell stands for all and the
    graph is one of cells. Points without a place, or at none that is finite, are by themselves."""
    eps = eps_of(points, level, eps)
    placed = points.select("point_id", *"xyz").filter(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    side = eps / 3**0.5 * (1 - 1e-6)
    placed = placed.withColumns({n: F.floor(F.col(c) / F.lit(side)) if side > 0 else F.col(c) for n, c in zip("ijk", "xyz")})
    low = placed.groupBy("i", "j", "k").agg(F.min("point_id").alias("cell"))
    tagged = materialize(placed.join(low, ["i", "j", "k"]).select("point_id", "cell", *"ijk", *"xyz"), "eps-cells")
    found = connected_components(_near_cells(tagged, eps, side) if side > 0 else tagged.select(F.col("cell").alias("a"), F.col("cell").alias("b")).limit(0), few=FEW)
    rooted = tagged.select("point_id", "cell").join(found, F.col("cell") == F.col("node"), "left").select("point_id", F.coalesce("component", "cell").alias("root"))
    return points.select("point_id").join(rooted, "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("root"))


#: Pairs of points that one pair of boxes is compared by; boxes of more are divided.
BOX_PAIRS = 4096


def _boxes(tagged: DataFrame, side: float, depth: int) -> DataFrame:
    """Occupied boxes of a depth below the cells (sides halve from depth to depth): which cell they are in, their place and the one
    of the box above, what they span and how many points they have."""
    width = F.lit(side / 2**depth)
    rows = tagged.select("cell", *[F.floor(F.col(c) / width).alias(f"{n}0") for n, c in zip("ijk", "xyz")], *"xyz")
    spans = [f(c).alias(f"{e}_{c}") for e, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    own = rows.groupBy("cell", "i0", "j0", "k0").agg(*spans, F.count(F.lit(1)).alias("n"))
    return own.withColumn("above", F.struct(*[F.floor(F.col(f"{n}0") / 2).alias(n) for n in "ijk"])).withColumn("box", F.struct(*[F.col(f"{n}0").alias(n) for n in "ijk"])).drop("i0", "j0", "k0")


def apart(pairs: DataFrame) -> DataFrame:
    """pairs of boxes a and b with near2 and far2: squares of the least and greatest distance that their points can have."""
    axis = lambda e, c, s: F.col(f"{s}.{e}_{c}")
    gaps = [F.greatest(F.lit(0.0), axis("lo", c, "b") - axis("hi", c, "a"), axis("lo", c, "a") - axis("hi", c, "b")) for c in "xyz"]
    spans = [F.greatest(axis("hi", c, "b") - axis("lo", c, "a"), axis("hi", c, "a") - axis("lo", c, "b")) for c in "xyz"]
    square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    return pairs.withColumn("near2", square(gaps)).withColumn("far2", square(spans))


def _near_cells(tagged: DataFrame, eps: float, side: float) -> DataFrame:
    """a, b: cells with points at most eps from each other. One verdict a pair of cells: what its boxes span mostly tells; of those
    left, boxes of few points are compared point by point, and the others divided into eight, until all are decided. A pair
    goes no further once any of its boxes is near. Rows grow with cells and with points along their borders."""
    reach2 = F.lit(eps * eps)
    steps = [d for d in product((-2, -1, 0, 1, 2), repeat=3) if d > (0, 0, 0)]
    cells = materialize(_boxes(tagged, side, 0), "eps-boxes")
    body = lambda s: F.struct(*[c for c in cells.columns if c != "above"]).alias(s)
    around = F.explode(F.array(*[F.struct(*[(F.col(f"box.{n}") + d).alias(n) for n, d in zip("ijk", step)]) for step in steps])).alias("at")
    met = cells.select(body("a"), around).join(cells.select(body("b"), F.col("box").alias("at")), "at").drop("at")
    links, depth = [], 0
    todo = materialize(apart(met).filter(F.col("near2") <= reach2), "eps-pairs")
    while True:
        ids = [F.col("a.cell").alias("a"), F.col("b.cell").alias("b")]
        sure = todo.filter(F.col("far2") <= reach2).select(*ids)
        few = F.col("a.n") * F.col("b.n") <= BOX_PAIRS
        open_ = todo.filter(F.col("far2") > reach2)
        width = F.lit(side / 2**depth)
        own = tagged.select("cell", F.struct(*[F.floor(F.col(c) / width).alias(n) for n, c in zip("ijk", "xyz")]).alias("box"), F.struct(*"xyz").alias("p"))
        of = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns])
        pick = open_.filter(few).select(*ids, F.col("a.box").alias("at_a"), F.col("b.box").alias("at_b"))
        both = pick.join(of("a"), (F.col("a") == F.col("cell_a")) & (F.col("at_a") == F.col("box_a"))).join(of("b"), (F.col("b") == F.col("cell_b")) & (F.col("at_b") == F.col("box_b")))
        gap = lambda c: F.col(f"p_a.{c}") - F.col(f"p_b.{c}")
        near = both.filter(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z") <= reach2).select("a", "b")
        links.append(materialize(sure.unionByName(near).distinct(), "eps-links"))
        many = open_.filter(~few).join(links[-1].select(F.col("a").alias("near_a"), F.col("b").alias("near_b")), (F.col("a.cell") == F.col("near_a")) & (F.col("b.cell") == F.col("near_b")), "left_anti")
        many = materialize(many.select(*ids, F.col("a.box").alias("above_a"), F.col("b.box").alias("above_b")), "eps-open")
        if many.isEmpty():
            break
        depth += 1
        inner = materialize(_boxes(tagged.join(many.select(F.explode(F.array("a", "b")).alias("cell")).distinct(), "cell", "left_semi"), side, depth), "eps-boxes")
        parts = lambda s: inner.select(F.col("cell").alias(s), F.col("above").alias(f"above_{s}"), body(f"box_{s}"))
        todo = many.join(parts("a"), ["a", "above_a"]).join(parts("b"), ["b", "above_b"]).select(F.col("box_a").alias("a"), F.col("box_b").alias("b"))
        todo = materialize(apart(todo).filter(F.col("near2") <= reach2), "eps-pairs")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("root").agg(F.count(F.lit(1)).alias("n_points"))


def keep_components(labels: DataFrame, min_points: int) -> DataFrame:
    """point_id and component_id (0, 1, ... in order of root) of components that are large enough.

    Numbering sorts one row a kept component."""
    kept = component_sizes(labels).filter(F.col("n_points") >= min_points)
    named = kept.select("root", (F.row_number().over(W.orderBy("root")) - 1).alias("component_id"))
    return labels.join(named, "root").select("point_id", "component_id")


def largest_components(labels: DataFrame, min_points: int, n: int = 10) -> DataFrame:
    """The n largest, ties to the smaller root, and whether they are kept."""
    return component_sizes(labels).orderBy(F.desc("n_points"), "root").limit(n).withColumn("kept", F.col("n_points") >= min_points)


def filtering_stats(labels: DataFrame, min_points: int, voxel_size: float | None = None, eps: float | None = None) -> DataFrame:
    """One row of counts, the sizes of the 50 largest components and what they were found with."""
    largest = largest_components(labels, min_points, 50).agg(F.sort_array(F.collect_list("n_points"), asc=False).alias("largest_sizes"))
    kept = F.col("n_points") >= min_points
    counts = component_sizes(labels).agg(F.sum("n_points").alias("input_points"), F.sum(F.when(kept, F.col("n_points")).otherwise(0)).alias("output_points"), F.count(F.lit(1)).alias("components_found"), F.count(F.when(kept, 1)).alias("components_kept"), F.count(F.when(~kept, 1)).alias("components_removed"))
    found = counts.crossJoin(F.broadcast(largest))
    return found.withColumns({n: F.lit(v).cast("double") for n, v in (("voxel_size", voxel_size), ("eps", eps))})
