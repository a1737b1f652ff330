import json
import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import edits, meshes, rooms
from pointloom.plans import editor
from pointloom.sources import stl
from pointloom.sources.files import write_text


def test_artefacts_and_settings(spark, tmp_path):
    root = f"file://{tmp_path}"
    write_text(spark, f"{root}/room_config.json", json.dumps({"padding": 0.5}))
    write_text(spark, f"{root}/chair/scene_log_edited.json", "{}")
    assert len(editor.previous_edits(spark, root, ["chair"])) == 2
    assert editor.settings(spark, root, "room_config", {"padding": 0.1, "height": 3}) == {"padding": 0.5, "height": 3}
    with pytest.raises(PermissionError):
        editor.clean_previous_edits(spark, root, ["chair"])
    assert len(editor.clean_previous_edits(spark, root, ["chair"], confirmed=True)) == 2
    assert editor.previous_edits(spark, root, ["chair"]) == []


def test_templates_and_tables(spark, tmp_path):
    body = editor.table_stl(spark, {"width": 2.0})
    assert stl.parse_stl(body).shape == (60, 3, 3)
    (tmp_path / "table_2.stl").write_bytes(body)
    assert editor.templates(spark, f"file://{tmp_path}") == ["table_2.stl"]
    info = editor.template(spark, f"file://{tmp_path}", "table_2.stl").first()
    assert (info.faces, info.size_x, info.size_z) == (60, 2.0, 0.75)
    with pytest.raises(FileNotFoundError):
        editor.template(spark, f"file://{tmp_path}", "../x.stl")


def test_tilt_and_added_objects(spark):
    at = spark.createDataFrame([(0.0, float(y), 0.1 * y) for y in range(10)], "x double, y double, z double")
    assert abs(editor.floor_tilt(at, rooms.Room()) - 0.1) < 1e-9
    assert editor.floor_tilt(at.limit(0), rooms.Room()) == 0.0
    assert abs(editor.floor_tilt(at, rooms.Room(flat_depth=100.0)) - 0.1) < 1e-9
    v, _ = meshes.boxes(spark.createDataFrame([("m", 1.0, 1.0, 1.0, 3.0, 2.0, 2.0)], "mesh_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"))
    box = editor.added_object(v, (5.0, 6.0, 7.0), 2.0, 90.0).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("z"), F.max("z")).first()
    assert all(math.isclose(a, b) for a, b in zip(box, (4, 6, 4, 8, 6, 8)))
    assert editor.object_name({"individual_stl_path": "a/chair_4.stl"}) == "chair_4" and editor.object_name({}) == "object"


def test_regenerated_mannequins(spark):
    box = "mesh_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"
    t, _ = meshes.boxes(spark.createDataFrame([("t", 0.0, 0.0, 0.0, 1.0, 1.0, 2.0)], box))
    chairs = spark.createDataFrame([(f"c{n}", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0) for n in range(10)], box).withColumn("angle", F.lit(0.0))
    out = editor.regenerated_mannequins(t, chairs, {"scale_factor": 2.0}, {"scale_factor": 1.5, "occupancy_pct": 25, "occupancy_seed": 0, "offset_z": 1.0})
    assert {r.mesh_id for r in out.select("mesh_id").distinct().collect()} == {"c0", "c5"}
    z = out.agg(F.min("z"), F.max("z")).first()
    assert (z[0], z[1]) == (0.5 + 1.0 - 1.5, 0.5 + 1.0 + 1.5)


def test_added_objects_equal_one_added_object(spark):
    box = "mesh_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"
    v, _ = meshes.boxes(spark.createDataFrame([("m", 1.0, 1.0, 1.0, 3.0, 2.0, 2.0), ("other", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], box))
    added = spark.createDataFrame([("a", "m", 5.0, 6.0, 7.0, 2.0, 90.0), ("b", "m", 0.0, 0.0, 0.0, 1.0, 0.0), ("c", "none", 0.0, 0.0, 0.0, 1.0, 0.0)], "name string, mesh_id string, x double, y double, z double, scale double, rotation_degrees double")
    got = editor.added_objects(v, added)
    own = lambda df: [(r.vid, round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in df.orderBy("vid").collect()]
    assert {r.mesh_id for r in got.select("mesh_id").distinct().collect()} == {"a", "b"}
    assert own(got.filter("mesh_id = 'a'")) == own(editor.added_object(v.filter("mesh_id = 'm'"), (5.0, 6.0, 7.0), 2.0, 90.0))


def test_manifest_lists_categories_with_log_and_meshes(spark, tmp_path):
    root = f"file://{tmp_path}"
    for path in ("chair/individual/chair_2.stl", "chair/individual/chair_1.STL", "chair/individual/notes.txt", "chair/mannequins/m.stl", "chair/scene_log.json", "table/individual/t.stl", "lamp/scene_log.json"):
        write_text(spark, f"{root}/{path}", "{}")
    assert editor.manifest(spark, root, ["table", "chair", "lamp", "none"]) == {"categories": [{"name": "chair", "objects": ["chair_1.STL", "chair_2.stl"], "mannequins": ["m.stl"], "count": 2}]}


def test_last_edits(spark):
    rows = [("a", 1, True), ("a", 3, False), ("b", 2, True), ("a", 2, True)]
    got = edits.last_edits(spark.createDataFrame(rows, "source string, edit_id long, deleted boolean"))
    assert sorted(map(tuple, got.collect())) == [("a", 3, False), ("b", 2, True)]
