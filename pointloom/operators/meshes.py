"""Triangle meshes as two relations: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, a, b, c)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize

from .util import dealt

# A box's corner is numbered 4 for far x, 2 for far y, 1 for far z; its faces look outward.
BOX_FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def _literal_rows(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def boxes(df: DataFrame, key: str = "mesh_id", inward: bool = False) -> tuple[DataFrame, DataFrame]:
    """A box mesh for each row of key and lo_*, hi_* (X04 with inward faces). With a column part, boxes of a key are parts of one
    mesh, numbered from 0."""
    part = F.col("part") if "part" in df.columns else F.lit(0)
    corners = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner")
    v = df.select(F.col(key).alias("mesh_id"), part.alias("part"), corners, *[f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"])
    pick = lambda c, bit: F.when(F.col("corner").bitwiseAND(bit) != 0, F.col(f"hi_{c}")).otherwise(F.col(f"lo_{c}")).alias(c)
    vertices = v.select("mesh_id", (F.col("part") * 8 + F.col("corner")).cast("int").alias("vid"), pick("x", 4), pick("y", 2), pick("z", 1))
    rows = [(n, a, c, b) if inward else (n, a, b, c) for n, (a, b, c) in enumerate(BOX_FACES)]
    f = df.select(F.col(key).alias("mesh_id"), part.alias("part"), F.inline(_literal_rows(rows, ("f", "a", "b", "c"))))
    faces = f.select("mesh_id", (F.col("part") * 12 + F.col("f")).cast("int").alias("fid"), *[(F.col("part") * 8 + F.col(c)).cast("int").alias(c) for c in "abc"])
    return vertices, faces


def table_parts(df: DataFrame, thickness: float | Column = 0.03, leg: float | Column = 0.05, inset: float | Column = 0.02) -> DataFrame:
    """mesh_id, part and box of each table's top and legs, from mesh_id, width, depth, height; centred, standing on z = 0.

    Legs only where the height leaves room under the top; they never cross the middle."""
    half, foot = (lambda c: F.col(c) / 2), F.lit(leg) / 2
    off = lambda c: F.greatest(F.lit(0.0), half(c) - foot - inset)
    box = lambda n, cx, cy, hx, hy, z0, z1: F.struct(F.lit(n).alias("part"), (cx - hx).alias("lo_x"), (cy - hy).alias("lo_y"), z0.alias("lo_z"), (cx + hx).alias("hi_x"), (cy + hy).alias("hi_y"), z1.alias("hi_z"))
    zero, under = F.lit(0.0), F.col("height") - thickness
    top = box(0, zero, zero, half("width"), half("depth"), under, F.col("height"))
    legs = [box(n + 1, sx * off("width"), sy * off("depth"), foot, foot, zero, under) for n, (sx, sy) in enumerate(((1, 1), (-1, 1), (1, -1), (-1, -1)))]
    parts = F.when(under > 0, F.array(top, *legs)).otherwise(F.array(top))
    return df.select("mesh_id", F.inline(parts))


def turn(vertices: DataFrame, radians: Column, about: tuple[Column, Column]) -> dict[str, Column]:
    """x and y of vertices turned about a vertical axis."""
    dx, dy = F.col("x") - about[0], F.col("y") - about[1]
    return {"x": dx * F.cos(radians) - dy * F.sin(radians) + about[0], "y": dx * F.sin(radians) + dy * F.cos(radians) + about[1]}


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with ax, ay, az ... cz, by joins on mesh and vertex."""
    out = faces
    for p in "abc":
        v = vertices.select("mesh_id", F.col("vid").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
        out = out.join(dealt(v), ["mesh_id", p])
    return out


def _cross() -> tuple[Column, Column, Column]:
    e = lambda p, c: F.col(f"{p}{c}") - F.col(f"a{c}")
    return (e("b", "y") * e("c", "z") - e("b", "z") * e("c", "y"), e("b", "z") * e("c", "x") - e("b", "x") * e("c", "z"), e("b", "x") * e("c", "y") - e("b", "y") * e("c", "x"))


def centroid(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Of each mesh: area and centre of its surface, and its bounds; the template's part of a fit (P10)."""
    n = _cross()
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    t = corners(vertices, faces).withColumn("area", area)
    mean = lambda c: (F.sum(F.col("area") * (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3) / F.sum("area")).alias(f"centroid_{c}")
    surface = t.groupBy("mesh_id").agg(F.sum("area").alias("area"), *map(mean, "xyz"))
    box = vertices.groupBy("mesh_id").agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"size_{c}") for c in "xyz"])
    return surface.join(dealt(box), "mesh_id")


def merge_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of a mesh at exactly one place become one, that of the smallest vid."""
    root = vertices.withColumn("root", F.min("vid").over(W.partitionBy("mesh_id", "x", "y", "z")))
    for p in "abc":
        faces = faces.join(dealt(root.select("mesh_id", F.col("vid").alias(p), F.col("root").alias(f"root_{p}"))), ["mesh_id", p]).drop(p).withColumnRenamed(f"root_{p}", p)
    return root.filter("vid = root").drop("root"), faces.select("mesh_id", "fid", "a", "b", "c")


def quality(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Of each mesh: vertices, faces, open edges, edges of more than two faces, faces without area, volume, whether it is
    watertight (each edge once in either direction) and encloses a volume (A15)."""
    sides = F.array(*[F.struct(F.col(p).alias("s"), F.col(q).alias("t")) for p, q in ("ab", "bc", "ca")])
    edges = faces.select("mesh_id", F.inline(sides)).withColumn("forward", (F.col("s") < F.col("t")).cast("int"))
    edges = edges.groupBy("mesh_id", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.sum("forward").alias("forward"))
    by_edge = edges.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("n") == 1, 1)).alias("boundary_edges"), F.count(F.when(F.col("n") > 2, 1)).alias("non_manifold_edges"), F.bool_and((F.col("n") == 2) & (F.col("forward") == 1)).alias("is_watertight"))
    n = _cross()
    flat = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) < 1e-12
    volume = F.sum(F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")) + F.col("ay") * (F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz")) + F.col("az") * (F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"))) / 6
    by_face = corners(vertices, faces).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces"), F.count(F.when(flat, 1)).alias("degenerate_faces"), volume.alias("volume"))
    by_vertex = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"))
    out = by_vertex.join(dealt(by_face), "mesh_id").join(dealt(by_edge), "mesh_id")
    return out.withColumn("is_volume", F.col("is_watertight") & (F.col("volume") > 0))


def report(checked: DataFrame) -> DataFrame:
    """One row: how many meshes pass and fail."""
    return checked.agg(F.count(F.lit(1)).alias("meshes"), F.count(F.when(F.col("is_watertight"), 1)).alias("passed"), F.count(F.when(~F.col("is_watertight"), 1)).alias("failed"))


def place(template: DataFrame, where: DataFrame) -> DataFrame:
    """A vertex of the template (vid, x, y, z about its centroid) for each placement (mesh_id, place_*, scale, angle in degrees):
    scaled, turned, moved (P11)."""
    both = template.select("vid", *"xyz").crossJoin(where.select("mesh_id", "place_x", "place_y", "place_z", "scale", F.radians("angle").alias("r")))
    x, y, z = (F.col(c) * F.col("scale") for c in "xyz")
    return both.select("mesh_id", "vid", (x * F.cos("r") - y * F.sin("r") + F.col("place_x")).alias("x"), (x * F.sin("r") + y * F.cos("r") + F.col("place_y")).alias("y"), (z + F.col("place_z")).alias("z"))


def stand(vertices: DataFrame, where: DataFrame) -> DataFrame:
    """Each mesh's own vertices where it has a place (mesh_id, place_*, angle in degrees): turned about the vertical axis, moved."""
    spun = turn(vertices, F.radians("angle"), (F.lit(0.0), F.lit(0.0))) | {"z": F.col("z")}
    return vertices.join(dealt(where), "mesh_id").select("mesh_id", "vid", *[(spun[c] + F.col(f"place_{c}")).alias(c) for c in "xyz"])


def concatenate(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of meshes; (mesh_id, vid) stays the key."""
    return tuple(reduce(DataFrame.unionByName, parts) for parts in zip(*meshes))


def export(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union as one mesh: vertices numbered from 0 through all meshes in order of mesh_id, faces with those numbers.

    The running sum is made in ranges of meshes, then over the ranges: no task sees more than its range."""
    sizes = vertices.groupBy("mesh_id").agg((F.max("vid") + 1).cast("long").alias("n"))
    sizes = materialize(sizes.repartitionByRange("mesh_id").withColumn("span", F.spark_partition_id()), "mesh-sizes")
    spans = sizes.groupBy("span").agg(F.sum("n").alias("all")).select("span", (F.sum("all").over(W.orderBy("span")) - F.col("all")).alias("above"))
    own = F.sum("n").over(W.partitionBy("span").orderBy("mesh_id")) - F.col("n")
    start = sizes.withColumn("own", own).join(F.broadcast(spans), "span").select("mesh_id", (F.col("above") + F.col("own")).alias("start"))
    v = vertices.join(dealt(start), "mesh_id").select((F.col("start") + F.col("vid")).alias("vid"), *"xyz")
    return v, faces.join(dealt(start), "mesh_id").select("mesh_id", "fid", *[(F.col("start") + F.col(c)).alias(c) for c in "abc"])
