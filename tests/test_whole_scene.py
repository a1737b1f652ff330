"""Queries of the scene cover all rows of its tables."""

import os

import pytest

from pointloom.operators import distance, edits
from pointloom.plans import io_queries  # noqa: F401
from pointloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


def test_all_objects_are_reported(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    broken = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 20 = 10").count()
    r = QUERIES["a23_watertight_report"](spark, SF).first()
    assert broken > 0 and (r.meshes, r.passed, r.failed) == (n, n - broken, broken)


@pytest.mark.parametrize("name", ["a15_mesh_quality", "a15_open_meshes", "s12_stl_roundtrip", "s18_template_info", "w04_names"])
def test_every_object_has_a_row(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_zip_numbers_many_partitions(spark):
    left = spark.range(0, 5000, 1, 7).selectExpr("id * 7919 % 5000 AS a")
    right = spark.range(0, 6000, 1, 5).selectExpr("3 * (id * 7919 % 6000) AS b")
    assert {(r.a, r.b) for r in edits.zip_by_order(left, right, "a", "b").collect()} == {(n, 3 * n) for n in range(5000)}
    assert edits.zip_by_order(right, left, "b", "a").count() == 0


def test_neighbours_of_outliers_and_few_points(spark):
    xyz = "point_id long, x double, y double, z double"
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.01, 0.0, 0.0), (2, 50.0, 0.0, 0.0), (3, 51.0, 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("nan"), 0.0, 0.0)], xyz)
    got = {(r.a, r["rank"]): r.b for r in distance.nearest_neighbours(p, 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 3, (2, 2): 1, (3, 1): 2, (3, 2): 1}
    assert distance.nearest_neighbours(p, 9).count() == 12 and distance.nearest_neighbours(p.limit(1), 5).count() == 0
    assert distance.spacing(p.filter("point_id IN (0, 2)")) == 50


def test_neighbours_of_a_cloud_of_mixed_density(spark, monkeypatch):
    import random

    monkeypatch.setattr(distance, "LEAF_POINTS", 16)
    r = random.Random(5)
    pts = [tuple(r.gauss(0, 0.001) for _ in range(3)) for _ in range(150)] + [tuple(r.uniform(-9, 9) for _ in range(3)) for _ in range(120)]
    pts += [(1.0, 2.0, 3.0)] * 40 + [(float(x), float(y), 5.0) for x in range(6) for y in range(6)] + [(0.0, -0.0, 7.0), (-0.0, 0.0, 7.0), (1e6, 0.0, 0.0), (1e6, 1e-3, 0.0)]
    df = spark.createDataFrame([(n * 7 % 1009, *p) for n, p in enumerate(pts)], "point_id long, x double, y double, z double").repartition(5)
    places = {x.point_id: (x.x, x.y, x.z) for x in df.collect()}
    gap = lambda p, q: (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])
    for k in (1, 5):
        want = {(a, n): b for a, p in places.items() for n, (_, b) in enumerate(sorted((gap(p, q), b) for b, q in places.items() if b != a)[:k], 1)}
        assert {(x.a, x["rank"]): x.b for x in distance.nearest_neighbours(df, k).collect()} == want
