"""A scene derived from the driver's tables by plain arithmetic, as DataFrames and as SQL for the checks.

Clouds, cameras, masks, fragments, objects and edits each come from one table, so that both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.projection import Intrinsics

CAMERA = Intrinsics(200.0, 200.0, 160.0, 120.0, 320, 240)


class Scene:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def points(self) -> DataFrame:
        e = F.expr
        return self.table("events").select(F.col("event_id").alias("point_id"), e("user_id / 150D").alias("x"), e("value / 500D").alias("y"), e("hour(ts) / 24D").alias("z"), F.col("event_type").alias("category"))

    def frames(self) -> DataFrame:
        k = "n_nationkey"
        c = F.expr(f"CASE {k} % 4 WHEN 0 THEN 1D WHEN 1 THEN 0.6D WHEN 2 THEN 0.8D ELSE -0.6D END")
        s = F.expr(f"CASE {k} % 4 WHEN 0 THEN 0D WHEN 1 THEN 0.8D WHEN 2 THEN 0.6D ELSE 0.8D END")
        o, i, h = F.lit(0.0), F.lit(1.0), F.lit(0.5)
        rows = F.array(F.array(c, -s, o, h), F.array(s, c, o, h), F.array(o, o, i, F.expr(f"2 + {k} * 0.1D")), F.array(o, o, o, i))
        return self.table("nation").select(F.col(k).alias("frame_id"), F.concat(F.lit("frame_"), k).alias("frame_stem"), F.concat(F.lit("frame_"), k, F.lit(".jpg")).alias("frame_name"), F.col(k).alias("pos"), rows.alias("c2w"))

    def mask_runs(self) -> DataFrame:
        k = F.col("s_suppkey")
        v0 = 40 + (k * 53) % 80
        rows = self.table("supplier").select(F.col("s_nationkey").alias("frame_id"), k.alias("mask_id"), (60 + (k * 37) % 100).cast("int").alias("u_start"), (100 + (k * 37) % 100 + k % 60).cast("int").alias("u_end"), F.explode(F.sequence(v0, v0 + 30 + (k * 7) % 50)).alias("v"))
        return rows.withColumn("v", F.col("v").cast("int"))

    def cloud(self) -> DataFrame:
        c = [F.col("embedding")[n].cast("double").alias(x) for n, x in enumerate("xyz")]
        rgb = [((F.col("vec_id") * m) % 256).cast("double").alias(n) for n, m in (("red", 7), ("green", 11), ("blue", 13))]
        return self.table("embeddings").select(F.col("vec_id").alias("point_id"), *c, F.col("label").alias("fragment"), *rgb)

    def objects(self) -> DataFrame:
        """Bounding boxes of objects: lo_x ... hi_z, footprint, point_count, source."""
        return self.spark.sql(OBJECTS_SPARK.format(part=f"parquet.`{self.dir}/part.parquet`"))

    def edits(self) -> DataFrame:
        """Edited placements of some objects, one for each order; object_0 isn't there."""
        return self.spark.sql(EDITS_SPARK.format(orders=f"parquet.`{self.dir}/orders.parquet`"))


_OBJECT_COLUMNS = """p_partkey AS object_id, concat('object_', p_partkey) AS source,
    (p_partkey % 40) * {d}0.5 AS lo_x, ((p_partkey * 7) % 60) * {d}0.4 AS lo_y, (p_partkey % 5) * {d}0.01 AS lo_z,
    {d}0.4 + p_size * {d}0.02 AS size_x, {d}0.3 + (p_partkey % 11) * {d}0.05 AS size_y, {d}0.8 + (p_size % 7) * {d}0.02 AS size_z,
    20 + (p_partkey * 37) % 400 AS point_count"""
_BOXES = """SELECT *, lo_x + size_x AS hi_x, lo_y + size_y AS hi_y, lo_z + size_z AS hi_z, size_x * size_y AS footprint FROM base"""
_EDIT_COLUMNS = """concat('object_', o_custkey % 97) AS source, o_orderkey AS edit_id, o_orderstatus = 'F' AS deleted,
    (o_orderkey % 7) * {d}0.1 AS dx, (o_orderkey % 5) * {d}0.1 AS dy, {d}0.0 AS dz, CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 0 ELSE 180 END * {d}1.0 AS turn"""


def _numbers(text: str, double: str) -> str:
    import re

    return re.sub(r"\{d\}([0-9.]+)", double, text)


OBJECTS_SPARK = "WITH base AS (SELECT " + _numbers(_OBJECT_COLUMNS, r"\1D") + " FROM {part}) " + _BOXES
EDITS_SPARK = "SELECT " + _numbers(_EDIT_COLUMNS, r"\1D") + " FROM {orders}"

#: The same scene in SQL of the checking engine.
SQL = {
    "points": "SELECT event_id AS point_id, user_id / 150::DOUBLE AS x, value / 500::DOUBLE AS y, hour(ts) / 24::DOUBLE AS z, event_type AS category FROM events",
    "frames": """SELECT n_nationkey AS frame_id, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE -0.6 END::DOUBLE AS c,
        CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.8 END::DOUBLE AS s, 2 + n_nationkey * 0.1::DOUBLE AS tz FROM nation""",
    "mask_runs": """SELECT s_nationkey AS frame_id, s_suppkey AS mask_id, 60 + (s_suppkey * 37) % 100 AS u_start, 100 + (s_suppkey * 37) % 100 + s_suppkey % 60 AS u_end,
        unnest(range(40 + (s_suppkey * 53) % 80, 71 + (s_suppkey * 53) % 80 + (s_suppkey * 7) % 50)) AS v FROM supplier""",
    "cloud": """SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS fragment,
        ((vec_id * 7) % 256)::DOUBLE AS red, ((vec_id * 11) % 256)::DOUBLE AS green, ((vec_id * 13) % 256)::DOUBLE AS blue FROM embeddings""",
    "objects": "WITH base AS (SELECT " + _numbers(_OBJECT_COLUMNS, r"\1::DOUBLE") + " FROM part) " + _BOXES,
    "edits": "SELECT " + _numbers(_EDIT_COLUMNS, r"\1::DOUBLE") + " FROM orders",
    "projected": """SELECT * FROM (SELECT frame_id, point_id, round_even((c * x + s * y + 0 * z + -(c * 0.5 + s * 0.5 + 0 * tz)) * 200 / cam_z + 160, 0)::INTEGER AS u,
        round_even((-1 * -s * x + -1 * c * y + -0.0::DOUBLE * z + -(-1 * -s * 0.5 + -1 * c * 0.5 + -0.0::DOUBLE * tz)) * 200 / cam_z + 120, 0)::INTEGER AS v, cam_z AS z
        FROM (SELECT f.*, p.*, (-0.0::DOUBLE * x + -0.0::DOUBLE * y + -1 * z + -(-0.0::DOUBLE * 0.5 + -0.0::DOUBLE * 0.5 + -1 * tz)) AS cam_z FROM points p, frames f) WHERE cam_z > 0.001)
        WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240""",
    "loose": "SELECT * FROM projected QUALIFY z <= min(z) OVER (PARTITION BY frame_id, u, v) + 0.5",
    "masked": "SELECT DISTINCT p.frame_id, mask_id, point_id, u, p.v, z FROM loose p JOIN mask_runs m ON p.frame_id = m.frame_id AND p.v = m.v AND u BETWEEN u_start AND u_end",
    "counts": "SELECT point_id, count(DISTINCT frame_id) AS n_views FROM masked GROUP BY point_id",
}


def with_views(*names: str, query: str, recursive: bool = False) -> str:
    """A query after the common tables it needs, in order."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query
