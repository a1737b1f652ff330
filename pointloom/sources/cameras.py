"""Camera frames, intrinsics and the dataparser's transform from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.projection import Intrinsics

_KEYS = "fl_x double, fl_y double, cx double, cy double, w double, h double"
CAMERAS = f"{_KEYS}, frames array<struct<file_path:string, transform_matrix:array<array<double>>, {_KEYS.replace(' double', ':double')}>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """pos, frame_name, frame_stem and c2w of each frame in order."""
    f = _document(spark, path, CAMERAS).select(F.posexplode("frames").alias("pos", "f"))
    name = F.element_at(F.split("f.file_path", "/"), -1)
    return f.select("pos", name.alias("frame_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("frame_stem"), F.col("f.transform_matrix").alias("c2w"))


def read_intrinsics(spark: SparkSession, path: str) -> Intrinsics:
    """The document's own, if it has a focal length, else those of its first frame."""
    d = _document(spark, path, CAMERAS)
    pick = [F.when(F.col("fl_x").isNotNull(), F.col(k)).otherwise(F.col("frames")[0][k]).alias(k) for k in ("fl_x", "fl_y", "cx", "cy", "w", "h")]
    r = d.select(*pick).first()
    if r is None or any(v is None for v in r):
        raise ValueError(f"no intrinsics in {path}")
    return Intrinsics(*r[:4], *map(int, r[4:]))


def read_dataparser(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float], float]:
    """Rotation, translation and scale."""
    r = _document(spark, path, "transform array<array<double>>, scale double").first()
    return [list(row[:3]) for row in r["transform"]], [row[3] for row in r["transform"]], r["scale"]
