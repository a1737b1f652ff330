"""Files in and out, the configuration, a whole run on a made-up scene, and the stream."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import meshes, objects
from pointloom.plans import editor
from pointloom.plans.config import Config
from pointloom.plans.pipeline import Run, planned
from pointloom.sources import cameras, clouds, files, logs, masks, stl
from pointloom.streaming.views import running_view_counts


def ply_bytes(rows, colours, order="<"):
    """A binary PLY of single numbers, from rows of x, y, z and, with colours, red, green, blue from 0 to 1."""
    form = "little" if order == "<" else "big"
    head = ["ply", f"format binary_{form}_endian 1.0", f"element vertex {len(rows)}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue") if colours), "end_header", ""]
    pack = struct.Struct(order + "fff" + "BBB" * colours).pack
    return "\n".join(head).encode() + b"".join(pack(*map(float, r[:3]), *(int(255 * v) for v in r[3:6] if colours)) for r in rows)


def test_ply(spark, tmp_path):
    rows = [(0.5, 1.5, -2.0, 0.0, 0.5, 1.0), (1.0, 2.0, 3.0, 0.5, 0.5, 0.5)]
    (tmp_path / "a.ply").write_bytes(ply_bytes(rows, True))
    (tmp_path / "b.ply").write_bytes(ply_bytes(rows, False, ">"))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\ncomment x\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 1 255 0 51\n1 2 3 0 0 0\n3 0 1 1\n")
    got = clouds.read_cloud(spark, f"file://{tmp_path}/a.ply").orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y, r.z) for r in got] == [(0, 0.5, 1.5, -2.0), (1, 1.0, 2.0, 3.0)]
    assert abs(got[0].green - 127 / 255) < 1e-9 and got[1].red == 127 / 255
    assert clouds.read_ply(spark, f"file://{tmp_path}/b.ply").filter("red IS NULL AND z IN (-2, 3)").count() == 2
    assert clouds.read_ply(spark, f"file://{tmp_path}/c.ply").orderBy("point_id").first().blue == 0.2
    every = clouds.read_ply(spark, f"file://{tmp_path}")
    whole = clouds._whole_files(spark, f"file://{tmp_path}", every.schema)
    assert every.count() == 6 and sorted(every.collect(), key=repr) == sorted(whole.collect(), key=repr)
    with pytest.raises(ValueError):
        clouds.parse_ply(b"ply\nformat ascii 1.0\nelement face 1\nelement vertex 1\nend_header\n")
    (tmp_path / "a.ply").write_bytes(ply_bytes(rows, True)[:-3])
    with pytest.raises(Exception, match="ends before its last record"):
        clouds.read_ply(spark, f"file://{tmp_path}/a.ply").collect()


def test_a_large_ply_is_read_by_several_tasks(spark, tmp_path):
    n = 5000
    (tmp_path / "bin.ply").write_bytes(ply_bytes([(k, 2 * k, -k, 0.2, 0.4, 0.6) for k in range(n)], True))
    head = f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nelement face 3\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "asc.ply").write_text(head + "".join(f"{k}  {2 * k}.0 {-k}\n" for k in range(n)) + "3 0 1 2\n" * 3)
    for name in ("bin", "asc"):
        for split in (11_900, 1 << 30):
            df = clouds.read_ply(spark, f"file://{tmp_path}/{name}.ply", ["point_id", "x", "z"], split)
            assert df.columns == ["point_id", "x", "z"]
            assert (df.rdd.getNumPartitions() > 5) == (split < 1 << 20)
            assert sorted(map(tuple, df.collect())) == [(k, float(k), float(-k)) for k in range(n)]


@pytest.mark.parametrize("in_place", [True, False])
def test_ply_sink(spark, tmp_path, in_place):
    from pointloom.operators.util import placed
    from pointloom.sources import records

    n = 3000
    points = spark.range(0, n, 1, 7).selectExpr("id * 7919 % 3000 AS point_id").selectExpr("point_id", "point_id / 3D AS x", "-point_id AS y", "1D AS z", "(point_id % 256) / 255D AS red", "0D AS green", "if(point_id % 2 = 0, NULL, 1D) AS blue", "concat('d/f', point_id % 3, '.ply') AS file")
    at = f"file://{tmp_path}/out.ply"
    for _ in range(2):  # what was there is replaced
        clouds.write_ply(points.drop("file"), at)
    got = clouds.read_ply(spark, at, split_bytes=5000).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y, round(255 * r.red), r.green, r.blue) for r in got] == [(k, k / 3, -k, k % 256, 0, 128 / 255 if k % 2 == 0 else 1) for k in range(n)]
    assert [p.name for p in tmp_path.iterdir()] == ["out.ply"]
    rows = placed(points.drop("red", "green", "blue"), F.col("file"), ["point_id"])
    spark.dataSource.register(clouds.PlySource)
    records.write(rows.select("file", "place", "total", *"xyz"), "ply", f"file://{tmp_path}/many", in_place=in_place)
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("many/**/*.ply")) == [f"many/d/f{k}.ply" for k in range(3)]
    back = clouds.read_ply(spark, f"file://{tmp_path}/many").collect()
    assert sorted((r.path[-6:], r.point_id, r.x) for r in back) == sorted((f"f{k % 3}.ply", k // 3, k / 3) for k in range(n))
    clouds.write_ply(points.drop("file").limit(0), at)
    assert not (tmp_path / "out.ply").exists()  # no points, no file
    with pytest.raises(Exception, match="not each in its place"):
        rows.filter("place <> 5").select("file", "place", "total", *"xyz").write.format("ply").mode("overwrite").options(rows=n, places=rows.agg(F.sum("place")).first()[0], in_place=str(in_place).lower()).save(f"file://{tmp_path}/short")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["many"]  # an abort leaves nothing


def test_text_clouds(spark, tmp_path):
    (tmp_path / "b.txt").write_text("//X Y Z R G B\n1 2 3 0.5 0 1\n\n  4 5 6 1 1 1 \n")
    (tmp_path / "a.txt").write_text("/x\nnot numbers here\n")
    (tmp_path / "c.txt").write_text("1.5 2 3 10 20 300\n")
    rows = clouds.read_txt(spark, f"file://{tmp_path}/*.txt").orderBy("fragment", "point_id").collect()
    assert [(r.fragment, r.fragment_name, r.x, r.red) for r in rows] == [(1, "b", 1.0, 127.5), (1, "b", 4.0, 255.0), (2, "c", 1.5, 10.0)]
    out = f"file://{tmp_path}/out"
    clouds.write_fragments(clouds.read_txt(spark, f"file://{tmp_path}/*.txt"), out, "fragment_name")
    again = clouds.text_rows(spark.createDataFrame([(1.0, 2.0, 3.0, None, -5.0, 300.0)], "x double, y double, z double, red double, green double, blue double")).first().value
    assert again == "1.000000 2.000000 3.000000 128 0 255"
    assert sorted(r.value for r in spark.read.text(out).collect())[0] == "1.000000 2.000000 3.000000 127 0 255"


def test_cameras(spark, tmp_path):
    eye = np.eye(4).tolist()
    doc = {"frames": [{"file_path": "images/f_1.png", "transform_matrix": eye, "fl_x": 10.0, "fl_y": 11.0, "cx": 5.0, "cy": 6.0, "w": 20, "h": 30}, {"file_path": "f_2.jpg", "transform_matrix": eye}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "u.json").write_text(json.dumps(doc | {"fl_x": 1.0, "fl_y": 2.0, "cx": 3.0, "cy": 4.0, "w": 5, "h": 6}))
    (tmp_path / "d.json").write_text(json.dumps({"transform": [[1, 0, 0, 7], [0, 1, 0, 8], [0, 0, 1, 9]], "scale": 0.5}))
    assert [(r.pos, r.frame_name, r.frame_stem) for r in cameras.read_frames(spark, f"file://{tmp_path}/t.json").collect()] == [(0, "f_1.png", "f_1"), (1, "f_2.jpg", "f_2")]
    assert cameras.read_intrinsics(spark, f"file://{tmp_path}/t.json").fx == 10.0 and cameras.read_intrinsics(spark, f"file://{tmp_path}/u.json").height == 6
    assert cameras.read_dataparser(spark, f"file://{tmp_path}/d.json") == ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], [7, 8, 9], 0.5)


def filtered_png(grey, kinds):
    """A PNG whose rows use the given filters."""
    import zlib

    body, above = b"", np.zeros(grey.shape[1], int)
    for row, kind in zip(grey.astype(int), kinds):
        left = np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2}.get(kind)
        if kind == 4:
            d = np.stack([abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)])
            guess = np.choose(d.argmin(axis=0), [left, above, corner])
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    png = masks.encode_png(grey)
    start = png.index(b"IDAT") - 4
    data = zlib.compress(body)
    return png[:start] + struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data)) + png[png.index(b"IEND") - 4 :]


def test_masks(spark, tmp_path):
    r = np.random.default_rng(6)
    grey = (r.random((7, 9)) > 0.5).astype(np.uint8) * r.integers(1, 256, (7, 9)).astype(np.uint8)
    assert (masks.decode_png(masks.encode_png(grey)) == grey).all()
    assert (masks.decode_png(filtered_png(grey, [0, 1, 2, 3, 4, 4, 3])) == grey).all()
    assert masks.decode_png(b"junk") is None
    (tmp_path / "f_1").mkdir()
    (tmp_path / "f_1" / "mask_003_score_0.750.png").write_bytes(masks.encode_png(grey))
    (tmp_path / "f_1" / "mask_004.png").write_bytes(b"broken")
    runs = masks.read_masks(spark, f"file://{tmp_path}", 9, 7).collect()
    back = np.zeros((7, 9), bool)
    for x in runs:
        back[x.v, x.u_start : x.u_end + 1] = True
        assert (x.frame, x.mask_id, x.score) == ("f_1", 3, 0.75)
    assert (back == (grey > 0)).all()
    two = masks.read_masks(spark, f"file://{tmp_path}").unionByName(spark.createDataFrame([("f_2", 0, None, 6, -3, 1), ("f_2", 0, None, 0, 8, 30), ("f_2", 0, None, 0, 2, 9), ("f_2", 11, 0.25, 3, 3, 3)], masks.RUNS))
    masks.write_masks(two, f"file://{tmp_path}/out", 9, 7)
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("*/*")) == ["f_1/mask_003_score_0.750.png", "f_2/mask_000.png", "f_2/mask_011_score_0.250.png"]
    assert masks.decode_png((tmp_path / "out" / "f_2" / "mask_000.png").read_bytes())[[0, 6]].tolist() == [[0, 0, *[255] * 7], [255, 255, *[0] * 7]]
    again = masks.read_masks(spark, f"file://{tmp_path}/out", 9, 7)
    assert sorted(map(tuple, again.filter("frame = 'f_1'").collect())) == sorted(map(tuple, runs))
    with pytest.raises(Exception, match="row 7 of 7"):
        masks.write_masks(two.withColumn("v", F.lit(7)), f"file://{tmp_path}/bad", 9, 7)
    assert not list(tmp_path.glob("bad*"))
    with pytest.raises(Exception, match="pixels instead of"):
        masks.read_masks(spark, f"file://{tmp_path}", 10, 7).collect()


def test_stl(spark, tmp_path):
    from pointloom.operators import meshes

    box = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "mesh_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    v, f = meshes.boxes(box)
    stl.write_stl(meshes.corners(v, f), f"file://{tmp_path}/out")
    body = (tmp_path / "out" / "m.stl").read_bytes()
    assert len(body) == 84 + 50 * 12 and not body.startswith(b"solid")
    triangles = stl.parse_stl(body)
    normals = np.frombuffer(body, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")]), offset=84)["n"]
    assert np.allclose(normals, [np.cross(t[1] - t[0], t[2] - t[0]) / np.linalg.norm(np.cross(t[1] - t[0], t[2] - t[0])) for t in triangles])
    (tmp_path / "bin.stl").write_bytes(body)
    lines = lambda t: "facet normal 0 0 0\n outer loop\n" + "".join(f"  vertex {x:.9g} {y:.9g} {z:.9g}\n" for x, y, z in t) + " endloop\nendfacet\n"
    (tmp_path / "asc.stl").write_text("solid m\n" + "".join(map(lines, triangles)) + "endsolid m\n")
    stl.write_scene_stl(meshes.corners(v, f).unionByName(meshes.corners(v, f).withColumn("mesh_id", F.lit("n"))), f"file://{tmp_path}/scene.stl")
    scene = stl.read_stl(spark, f"file://{tmp_path}/scene.stl", 500)
    assert scene.rdd.getNumPartitions() == 3 and [r.fid for r in scene.orderBy("fid").collect()] == list(range(24))
    assert stl.scene_stl_check(spark, f"file://{tmp_path}/scene.stl").first().asDict() == {"faces": 24, "lo_x": 0, "lo_y": 0, "lo_z": 0, "hi_x": 1, "hi_y": 2, "hi_z": 3}
    for name in ("bin", "asc"):
        iv, jf = stl.indexed(stl.read_stl(spark, f"file://{tmp_path}/{name}.stl"))
        q = meshes.quality(iv, jf).first()
        assert (q.mesh_id, q.vertices, q.faces, q.is_watertight) == (name, 8, 12, True) and abs(q.volume - 6) < 1e-6
        info = stl.template_info(iv, jf).first()
        assert (info.size_z, info.faces) == (3.0, 12)
    with pytest.raises(ValueError):
        stl.parse_stl(b"vertex 0 0 0")


def test_logs_and_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    p = spark.createDataFrame([(2, "b", [1.0, 2.0, 3.0], 9), (1, "a", [0.0, 0.0, 0.0], 5)], "object_id long, source string, position array<double>, point_count long")
    logs.write_log(p, f"{root}/chair", "chair", "template")
    assert [r.source for r in logs.read_log(spark, f"{root}/chair").orderBy("object_id").collect()] == ["a", "b"]
    payload = {"chair": {"placements": [{"source": "a", "position": [1, 1, 1], "_deleted": True}, {"source": "b", "position": [2, 2, 2], "_x": 1}]}, "_room_config": {"padding": 1}, "_mannequin_adjustments": {"scale_factor": 2}}
    assert logs.save_edits(spark, payload, root) == {"chair": (1, 1)}
    edited = logs.read_log(spark, f"{root}/chair").collect()
    assert [(r.source, r.position) for r in edited] == [("b", [2.0, 2.0, 2.0])]
    assert logs.load_adjustments(spark, root) == {"scale_factor": 2} and logs.load_adjustments(spark, f"{root}/none") == {}
    assert logs.read_log(spark, f"{root}/none") is None
    (tmp_path / "x.PNG").write_bytes(b"")
    assert files.images(spark, root) == ["x.PNG"]
    with pytest.raises(FileNotFoundError):
        files.images(spark, f"{root}/chair")
    assert files.first_existing(spark, [f"{root}/no", f"{root}/chair"], (".json",)) == f"{root}/chair"


def test_config(spark, tmp_path):
    tree = {"project": {"name": "p"}, "paths": {"data_root": "data", "run_id": "r1", "input": {"transforms": "t.json"}}, "defaults": {"extraction": {"min_views": 3, "z_threshold": 0.1}}, "categories": {"chair": {"enabled": True, "extraction": {"min_views": 5}, "placement": {"mode": "template"}}, "lamp": {}}, "room": {"padding": 0.2, "size": [1, 2], "vents": [{"size": [1, 1]}]}}
    files.write_text(spark, f"file://{tmp_path}/c.yaml", __import__("yaml").safe_dump(tree))
    c = Config.load(spark, f"file://{tmp_path}/c.yaml")
    assert c.enabled() == ["chair"] and c.category("chair")["extraction"] == {"min_views": 5, "z_threshold": 0.1}
    assert c.tree == tree and c.room().size == (1, 2) and c.room().vents == ()
    assert c.run_dir().endswith("data/projects/p/runs/r1") and c.input_path("transforms", "chair").endswith("/p/t.json")
    assert c.save_copy(spark, f"file://{tmp_path}/run").endswith("config_v1.yaml") and c.save_copy(spark, f"file://{tmp_path}/run").endswith("config_v2.yaml")
    with pytest.raises(ValueError):
        c.category("sofa")
    assert planned(["2", "4"]) == (["2", "4"], ["combine"])
    assert planned(["all"])[1] == ["combine", "5"] and planned(["4b"]) == ([], ["4b"])
    with pytest.raises(ValueError):
        planned(["9"])


def edit_run(spark, run, tmp_path):
    """One table wider and moved, one deleted, one added, and a library object; then again, with nothing added up."""
    placed = sorted(json.loads(files.read_text(spark, f"{run.dir}/table/scene_log.json"))["placements"], key=lambda p: p["position"][0])
    stays, goes = placed
    (tmp_path / "stl_templates").mkdir()
    (tmp_path / "stl_templates" / "box.stl").write_bytes(editor.table_stl(spark, {"width": 1.0, "depth": 0.6, "height": 0.02}))
    was = objects.bounds(run.read("table", "vertices"), "mesh_id").filter(F.col("mesh_id") == stays["source"]).first()
    moved = stays | {"position": [p + 1.0 for p in stays["position"]], "dimensions": stays["dimensions"] | {"height": 2.0}}
    added = [{"template_file": "box.stl", "position": [5.0, 5.0, 5.0], "scale": 2.0}, {"template_file": "none.stl", "deleted": True}]
    payload = {"table": {"placements": [moved, goes | {"_deleted": True}]}, "_added_objects": added, "_added_procedural_objects": [{"position": [0, -5, 0], "rotation_degrees": 90}]}
    logs.save_edits(spark, payload, run.dir)
    for _ in range(2):
        run.run(["4b"])
        box = {r.mesh_id: r for r in objects.bounds(run.read("scene", "furniture_edited_vertices"), "mesh_id").collect()}
        assert set(box) == {f"table/{stays['source']}", "added_001_box", "added_procedural_001_table"}
        own, lib, new = box[f"table/{stays['source']}"], box["added_001_box"], box["added_procedural_001_table"]
        assert abs(own.hi_z - own.lo_z - 2.0) < 1e-9 and abs(own.lo_z - was.lo_z - 1.0) < 1e-9 and abs(own.lo_x - was.lo_x - 1.0) < 1e-9
        assert [round(x, 6) for x in (lib.lo_x, lib.hi_x, lib.lo_y, lib.lo_z, lib.hi_z)] == [4.0, 6.0, 4.4, 4.97, 5.03]
        assert [round(x, 6) for x in (new.lo_x, new.hi_x, new.lo_y, new.hi_y, new.hi_z)] == [-0.3, 0.3, -5.5, -4.5, 0.75]
        assert stl.scene_stl_check(spark, run.path("scene", "furniture_edited.stl")).first().faces == run.read("scene", "furniture_edited_faces").count() == 60 + 12 + 60
    assert run.read("scene", "watertight_log").count() == 2  # what placement made stays
    run.config.tree["categories"]["table"]["placement"]["mannequin"] = {"enabled": True, "stl_file": "box.stl", "position_offset": [0.0, 0.0, 0.5]}
    run.run(["4b"])
    (one,) = objects.bounds(run.read("table", "edited_mannequin_vertices"), "mesh_id").collect()  # only the table that is left
    assert one.mesh_id == stays["source"] and abs(one.hi_z - one.lo_z - 2.0) < 1e-9 and abs(one.lo_z - own.lo_z - 0.5) < 1e-9
    assert abs(one.lo_x + one.hi_x - own.lo_x - own.hi_x) < 1e-9
    assert stl.scene_stl_check(spark, run.path("scene", "furniture_edited_with_mannequins.stl")).first().faces == 132 + 12


def test_whole_run(spark, tmp_path):
    """Two clusters seen by three cameras become two tables in a room."""
    root = tmp_path / "projects" / "p"
    (root / "input").mkdir(parents=True)
    r = np.random.default_rng(8)
    a, b = (np.column_stack([r.uniform(-0.2, 0.2, 400) + dx, r.uniform(-0.1, 0.1, 400), r.uniform(0, 0.02, 400)]) for dx in (-0.5, 0.5))
    pts = np.vstack([a, b, r.uniform(-1, 1, (100, 3)) * [1, 0.2, 0.01] + [0, 0.9, 0]])
    # The reconstruction's frame, before its transform is undone: x, y, z here are x, z, -y there.
    (root / "input" / "cloud.ply").write_bytes(ply_bytes([(x, -z, y, 0.5, 0.5, 0.5) for x, y, z in pts], True))
    (root / "input" / "d.json").write_text(json.dumps({"transform": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], "scale": 1.0}))
    look = lambda h: [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, h], [0, 0, 0, 1.0]]
    frames = [{"file_path": f"images/f{n}.png", "transform_matrix": look(2.0 + 0.1 * n)} for n in range(3)]
    (root / "input" / "t.json").write_text(json.dumps({"fl_x": 100.0, "fl_y": 100.0, "cx": 80.0, "cy": 60.0, "w": 160, "h": 120, "frames": frames}))
    mask = np.zeros((120, 160), np.uint8)
    mask[40:80, :] = 255
    for n in range(3):
        d = root / "runs" / "r" / "1_segmentation" / "table" / f"f{n}"
        d.mkdir(parents=True)
        (d / "mask_000.png").write_bytes(masks.encode_png(mask))
    inputs = {"point_cloud": "input/cloud.ply", "transforms": "input/t.json", "dataparser": "input/d.json"}
    tree = {"project": {"name": "p"}, "paths": {"run_id": "r", "input": inputs}, "defaults": {}, "categories": {"table": {"enabled": True, "extraction": {"min_views": 2, "use_zbuffer": False, "use_depth_band": False}, "filtering": {"octree_level": 4, "min_points_per_component": 50}, "healing": {"gap_threshold": 0.05, "point_resolution": 0.02}, "placement": {"mode": "procedural", "min_points": 50}}}, "room": {"padding": 0.3}}
    run = Run(spark, Config(tree, f"file://{tmp_path}"))
    run.run()
    where = run.read("table", "placements").orderBy("place_x").collect()
    assert len(where) == 2 and abs(where[0].place_x + 0.5) < 0.1 and abs(where[1].place_x - 0.5) < 0.1
    stats = run.read("table", "filtering_stats").first()
    assert stats.components_kept == 2 and stats.output_points <= 800
    log = run.read("scene", "room_log").first()
    assert log.watertight and run.read("scene", "watertight_log").count() == 2
    checks = {n: stl.scene_stl_check(spark, run.path("scene", f"{n}.stl")).first() for n in ("furniture", "room", "furniture_and_room")}
    assert checks["furniture"].faces == 120 and checks["furniture_and_room"].faces == 120 + checks["room"].faces
    assert checks["furniture_and_room"].lo_x == checks["room"].lo_x < checks["furniture"].lo_x
    assert (root / "runs" / "r" / "scene" / "furniture.stl").stat().st_size == 84 + 50 * 120
    assert len([f for f in (root / "runs" / "r").glob("**/individual/*.stl")]) == 2
    for name, table in (("FINAL_combined_all_images", "raw"), ("FINAL_filtered", "filtered")):
        found = clouds.read_ply(spark, run.path("table", f"{name}.ply"))
        assert found.count() == run.read("table", table).count() and found.filter("red IS NULL").count() == 0
    run.run(["5"])
    assert run.read("scene", "room_log").first() == log
    edit_run(spark, run, tmp_path)
    counts = lambda: sorted(p.name for p in (root / "runs" / "r").glob("**/view_counts_*"))
    kept = [p.stat().st_mtime_ns for p in (root / "runs" / "r").glob("**/view_counts_*/_SUCCESS")]
    before = counts()
    run.run(["2"])
    assert counts() == before and kept == [p.stat().st_mtime_ns for p in (root / "runs" / "r").glob("**/view_counts_*/_SUCCESS")]
    (root / "runs" / "r" / "1_segmentation" / "table" / "f2" / "mask_000.png").unlink()
    run.run(["2"])
    assert len(counts()) == 2  # other masks, other counts
    with pytest.raises(NotImplementedError):
        run._procedural("chair", {}, None, None)


def test_streamed_counts(spark, tmp_path):
    hits = spark.createDataFrame([(f, p) for f in range(3) for p in range(f, 4)] + [(0, 1)], "frame_id int, point_id long").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    hits.write.parquet(f"{tmp_path}/hits")
    stream = spark.readStream.schema(hits.schema).parquet(f"{tmp_path}/hits")
    q = running_view_counts(stream).writeStream.outputMode("complete").format("memory").queryName("views").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        got = {r.point_id: r.n_views for r in spark.sql("SELECT * FROM views").collect()}
    finally:
        q.stop()
    assert got == {0: 1, 1: 2, 2: 3, 3: 3}


def test_a_folder_of_stl_files_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver knows none of a folder's files; text, small and split binary files and folders in it are read."""
    df = spark.range(40).selectExpr("concat('f', id % 3, '/m', id) AS mesh_id", "0D AS lo_x", "0D AS lo_y", "0D AS lo_z", "id + 1D AS hi_x", "2D AS hi_y", "3D AS hi_z")
    stl.write_stl(meshes.corners(*meshes.boxes(df)), str(tmp_path / "all"))
    (tmp_path / "all" / "text.stl").write_text("solid\nfacet\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 7\nendfacet\n")

    def never(*a):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(stl.records, "listed", never)
    got = stl.read_stl(spark, str(tmp_path / "all"), split_bytes=250).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fid").alias("fids"), F.max(F.greatest("ax", "bx", "cx")).alias("x"), F.max("cz").alias("z"))
    rows = {r.mesh_id: tuple(r)[1:] for r in got.collect()}
    assert rows == {f"m{k}": (12, 12, k + 1.0, 3.0) for k in range(40)} | {"text": (1, 1, 1.0, 7.0)}
