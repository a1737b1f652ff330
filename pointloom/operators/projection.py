"""Cameras and projections: rigid transforms and pinhole projection as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import small


@dataclass(frozen=True)
class Intrinsics:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


def rotate_z(x: Column, y: Column, radians: Column) -> tuple[Column, Column]:
    """x and y turned about the z axis."""
    return x * F.cos(radians) - y * F.sin(radians), x * F.sin(radians) + y * F.cos(radians)


def rotation_matrix(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """Rodrigues' rotation about any axis, as literals for a plan."""
    import math

    n = math.sqrt(sum(a * a for a in axis))
    if n == 0:
        raise ValueError("a rotation needs an axis")
    u, c, s = [a / n for a in axis], math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    skew = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    return [[c * (i == j) + (1 - c) * u[i] * u[j] + s * skew[i][j] for j in range(3)] for i in range(3)]


def transform(df: DataFrame, matrix: list[list[float]], shift=(0.0, 0.0, 0.0), about=(0.0, 0.0, 0.0)) -> DataFrame:
    """x, y, z turned by a 3x3 matrix of literals about a point, then shifted."""
    p = [F.col(c) - F.lit(a) for c, a in zip("xyz", about)]
    return df.withColumns({c: sum(F.lit(float(matrix[i][j])) * p[j] for j in range(3)) + F.lit(about[i] + shift[i]) for i, c in enumerate("xyz")})


def undo_dataparser(points: DataFrame, rotation: list[list[float]], translation: list[float], scale: float) -> DataFrame:
    """From the reconstruction's frame to the cameras': q = R^T (p / scale - t), then (x, y, z) to (x, z, -y)."""
    p = [F.col(c) / F.lit(scale) - F.lit(float(t)) for c, t in zip("xyz", translation)]
    q = [sum(F.lit(float(rotation[k][i])) * p[k] for k in range(3)) for i in range(3)]
    return points.withColumns({"x": q[0], "y": q[2], "z": -q[1]})


def world_to_camera(frames: DataFrame) -> DataFrame:
    """Adds w2c (12 numbers, row by row) from c2w (rows of a rigid camera-to-world matrix): its inverse, with the y and z
    axes turned from the graphics to the vision convention (P02)."""
    m = lambda i, j: F.col("c2w")[i][j]
    rows = []
    for i, sign in enumerate((1.0, -1.0, -1.0)):
        r = [F.lit(sign) * m(k, i) for k in range(3)]
        rows += [*r, -(r[0] * m(0, 3) + r[1] * m(1, 3) + r[2] * m(2, 3))]
    return frames.withColumn("w2c", F.array(*rows))


def resolve_frames(wanted: DataFrame, cameras: DataFrame) -> DataFrame:
    """wanted (frame) with c2w of cameras (frame_stem, frame_name, c2w): by stem, then by name with an image ending.

    Of repeated stems or names the last camera counts (pos). Frames without a pose keep a null c2w (F18 drops them)."""
    last = lambda key: cameras.groupBy(F.col(key).alias("key")).agg(F.max_by("c2w", "pos").alias("c2w"))
    by_stem = small(last("frame_stem")).withColumnRenamed("c2w", "by_stem").withColumnRenamed("key", "stem")
    out = wanted.join(by_stem, F.col("frame") == F.col("stem"), "left").drop("stem")
    found = F.col("by_stem")
    for n, ending in enumerate((".jpg", ".png", ".jpeg", ".JPG")):
        named = small(last("frame_name")).withColumnRenamed("c2w", f"by_name{n}").withColumnRenamed("key", f"name{n}")
        out = out.join(named, F.concat("frame", F.lit(ending)) == F.col(f"name{n}"), "left").drop(f"name{n}")
        found = F.coalesce(found, F.col(f"by_name{n}"))
    return out.withColumn("c2w", found).drop("by_stem", *[f"by_name{n}" for n in range(4)])


def project(points: DataFrame, frames: DataFrame, k: Intrinsics) -> DataFrame:
    """frame_id, point_id, u, v, z: where each point falls in each frame.

    Points not farther than 1 mm before a camera (F01) or outside its image (F02) drop out; pixels round half to even. Each
    point meets each frame, the question itself; frames are few and sent to the points' tasks if their count allows."""
    # Plain columns rather than array elements: the generated code stays small enough to be compiled.
    posed = small(world_to_camera(frames.filter("c2w IS NOT NULL")).select("frame_id", *[F.col("w2c")[i].alias(f"w{i}") for i in range(12)]))
    w = lambda i: F.col(f"w{i}")
    camera = {c: w(4 * i) * F.col("x") + w(4 * i + 1) * F.col("y") + w(4 * i + 2) * F.col("z") + w(4 * i + 3) for i, c in enumerate(("cam_x", "cam_y", "cam_z"))}
    seen = points.select("point_id", "x", "y", "z").crossJoin(posed).select("frame_id", "point_id", *[e.alias(c) for c, e in camera.items()]).filter("cam_z > 0.001")
    pixel = lambda c, f, o: F.rint(F.col(c) * F.lit(f) / F.col("cam_z") + F.lit(o)).cast("int")
    out = seen.select("frame_id", "point_id", pixel("cam_x", k.fx, k.cx).alias("u"), pixel("cam_y", k.fy, k.cy).alias("v"), F.col("cam_z").alias("z"))
    return out.filter((F.col("u") >= 0) & (F.col("u") < k.width) & (F.col("v") >= 0) & (F.col("v") < k.height))
