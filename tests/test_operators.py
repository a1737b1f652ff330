"""Small scenes worked out by hand, and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import components, distance, edits, healing, icp, meshes, objects, projection, rooms, visibility, voxels

XYZ = "point_id long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(rows)], XYZ)


def test_components_equal_union_find(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(60)] + [(2000 + k, 2001 + k) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {(x, find(x)) for x in list(root)}
    df = spark.createDataFrame(pairs + [(None, 3), (7, 7)], "a long, b long")
    assert {tuple(x) for x in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_voxels_touching_at_a_corner(spark):
    def parts(points, level):
        return voxels.octree_components(cloud(spark, points), level).select("root").distinct().count()

    grid = [(0, 0, 0), (7.9, 7.9, 7.9)]
    assert parts([*grid, (1.5, 1.5, 1.5)], 3) == 2
    assert parts([*grid, (3.5, 3.5, 3.5)], 3) == 3
    assert parts([(1, 1, 1)] * 3, 4) == 1
    assert voxels.octree_components(cloud(spark, grid).limit(0), 3).count() == 0


def test_larger_levels_refine(spark):
    r = np.random.default_rng(2)
    c = cloud(spark, r.random((200, 3)))
    of = {lv: dict(map(tuple, voxels.octree_components(c, lv).collect())) for lv in (3, 5)}
    for a in range(200):
        assert of[3][a] == of[3][of[5][a]]


def test_zbuffer_and_bands(spark):
    p = spark.createDataFrame([(0, n, 5, 5, z) for n, z in enumerate((1.0, 1.04, 1.06))], "frame_id int, point_id long, u int, v int, z double")
    assert {r.point_id for r in visibility.unoccluded(p, 0.05).collect()} == {0, 1}
    runs = spark.createDataFrame([(0, 1, 5, 0, 31)], "frame_id int, mask_id int, v int, u_start int, u_end int")
    for n, want in ((4, 4), (5, 4)):
        rows = spark.createDataFrame([(0, k, k, 5, 9.0 if k == 0 else 1.0) for k in range(n)], "frame_id int, point_id long, u int, v int, z double")
        chosen = rows.select("point_id")
        assert visibility.refine(rows, runs, chosen, use_zbuffer=False).count() == want
    assert visibility.refine(rows, runs, chosen, use_band=False, use_zbuffer=False).count() == 5
    bands = visibility.patch_bands(visibility.in_masks(rows, runs), 2.0, 32).first()
    assert (bands.med, bands.mad) == (1.0, 0.005)


def test_masks_meet_depths_not_points(spark, monkeypatch):
    """A crowd at one depth of a pixel is one row where masks and bands are made, and counts as many in a median."""
    runs = spark.createDataFrame([(0, m, 5, 0, 31) for m in (1, 2)], "frame_id int, mask_id int, v int, u_start int, u_end int")
    rows = spark.createDataFrame([(0, k, k % 2, 5, 1.0 + (k % 50 == 1) * 0.3) for k in range(200)], "frame_id int, point_id long, u int, v int, z double")
    assert "Window" not in visibility.unoccluded(rows, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    tables, made = {}, visibility.materialize
    monkeypatch.setattr(visibility, "materialize", lambda df, name: made(tables.setdefault(name, df), name))
    visibility.mask_words(runs, "mask_id")  # dealt first, aggregated once: no task holds all masks
    assert tables["mask-words"]._jdf.queryExecution().executedPlan().toString().count("partial_bit_or") == 1 and "REPARTITION_BY_COL" in tables["mask-words"]._jdf.queryExecution().executedPlan().toString()
    met, real = [], visibility.in_masks
    monkeypatch.setattr(visibility, "in_masks", lambda df, r: (met.append(df.count()), real(df, r))[1])
    assert {r.point_id for r in visibility.refine(rows, runs, rows.select("point_id"), use_band=False).collect()} == {k for k in range(200) if k % 50 != 1}
    assert visibility.refine(rows, runs, rows.select("point_id"), use_zbuffer=False).count() == 196
    assert met == [3, 3]
    one, many = (visibility.patch_bands(real(df, runs), 2.0, 32, **how).select("mask_id", "n", "med", "mad").distinct().collect() for df, how in ((rows, {}), (visibility.depths(rows), {"weight": "points"})))
    assert len(one) == 2 and sorted(one) == sorted(many)


def test_pixels_round_half_to_even(spark):
    k = projection.Intrinsics(1.0, 1.0, 0.0, 0.0, 10, 10)
    eye = [[1.0, 0.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0], [0.0, 0.0, -1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    frames = spark.createDataFrame([(0, eye), (1, None)], "frame_id int, c2w array<array<double>>")
    pts = cloud(spark, [(0.5, 2.5, 1), (1.5, 3.5, 1), (1, 1, 0.0005), (1, 1, -1), (9.6, 0, 1)])
    assert {(r.point_id, r.u, r.v) for r in projection.project(pts, frames, k).collect()} == {(0, 0, 2), (1, 2, 4)}


def test_rotation_matrix():
    m = np.array(projection.rotation_matrix((0, 0, 2), 90))
    assert np.allclose(m, [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    m = np.array(projection.rotation_matrix((1, 2, 3), 33))
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m @ [1, 2, 3], [1, 2, 3])


def test_gaps(spark):
    def heal(d, gap=0.1, res=0.03):
        rows = [(0, 0.0, 0.0, 0.0, 1), (1, d, 0.0, 0.0, 2), (2, 5.0, 0.0, 0.0, 3)]
        p = spark.createDataFrame([(*r, 0.0, 0.0, 255.0) for r in rows], "point_id long, x double, y double, z double, fragment int, red double, green double, blue double")
        links = healing.connections(p, gap)
        return {(r.src, r.dst) for r in links.collect()}, healing.fillers(links, p, res).count(), {r.name for r in healing.groups(p, links).collect()}

    assert heal(0.1) == ({(1, 2)}, 3, {"merged_group_1", "isolated_3"})
    assert heal(0.1000001)[0] == set()
    assert heal(0.02) == ({(1, 2)}, 0, {"merged_group_1", "isolated_3"})


def test_slabs_find_all_global_pairs(spark):
    r = np.random.default_rng(3)
    p = spark.createDataFrame([(n, *map(float, x), int(n % 3), 0.0, 0.0, 0.0) for n, x in enumerate(r.random((150, 3)))], "point_id long, x double, y double, z double, fragment int, red double, green double, blue double")
    one = {(x.a, x.b) for x in healing.connections(p, 0.2, 1).collect()}
    many = {(x.a, x.b) for x in healing.connections(p, 0.2, 10).collect()}
    assert one and one <= many


def test_connections_of_crowds_visit_few_leaves(spark, monkeypatch):
    """Two crowded fragments, places that repeat and one zero of either sign: as brute force, of a third of the pairs at most."""
    r = np.random.default_rng(9)
    x = np.vstack([r.random((6000, 3)) * 0.2, np.repeat(r.random((40, 3)) * 0.2, 10, axis=0), [[0.0, 0.1, 0.1], [-0.0, 0.1, 0.1], [3.0, 0.0, 0.0]]])
    f, ids = np.arange(len(x)) % 3, r.permutation(len(x))
    p = spark.createDataFrame([(int(i), *map(float, a), int(g)) for i, a, g in zip(ids, x, f)] + [(9000, 0.1, float("nan"), 0.1, 0), (9001, 0.1, None, 0.1, 1)], "point_id long, x double, y double, z double, fragment int")
    tables = {}
    real = distance.materialize
    monkeypatch.setattr(distance, "OTHERS_LEAF", 8)
    monkeypatch.setattr(distance, "materialize", lambda df, name: tables.setdefault(name, real(df, name)))
    got = {(l.a, l.dst): (l.b, l.d2, l.src) for l in healing.connections(p, 0.2, 1).collect()}
    assert tables["others-visits"].count() * distance.OTHERS_LEAF**2 < len(x) ** 2 / 3 / 3
    want = {}
    for g in range(2):
        for h in range(g + 1, 3):
            b, ib = x[f == h], ids[f == h]
            b, ib = b[np.argsort(ib)], np.sort(ib)
            for i, a in zip(ids[f == g], x[f == g]):
                d = a - b
                d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
                if d2.min() <= 0.2 * 0.2:
                    want[int(i), h] = int(ib[d2.argmin()]), float(d2.min()), g
    assert got == want


def test_distance_join_equals_brute_force(spark):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(120, 3)), np.zeros((5, 3)), [[0.3, 0, 0]]])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for reach in (0.3, 1.0, 0.0):
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= reach * reach))}
        assert {(p.a, p.b) for p in distance.close_pairs(cloud(spark, x), cloud(spark, x), reach).collect()} == want
    assert distance.spacing(cloud(spark, [(0, 0, 0), (9, 9, 9)]), 1.0) == 0.01


def box_mesh(spark, *sizes):
    return meshes.boxes(spark.createDataFrame([(n, 0.0, 0.0, 0.0, *map(float, s)) for n, s in enumerate(sizes)], "mesh_id int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"))


def test_box_and_table_meshes(spark):
    v, f = box_mesh(spark, (1, 2, 3))
    q = meshes.quality(v, f).first()
    assert (q.vertices, q.faces, q.edges, q.boundary_edges, q.is_watertight, q.is_volume) == (8, 12, 18, 0, True, True) and abs(q.volume - 6) < 1e-12
    assert meshes.quality(v, f.filter("fid <> 0")).first().boundary_edges == 3
    dims = spark.createDataFrame([(1, 2.0, 1.0, 0.75), (2, 0.05, 0.05, 0.02)], "mesh_id int, width double, depth double, height double")
    q = {r.mesh_id: r for r in meshes.quality(*meshes.boxes(meshes.table_parts(dims))).collect()}
    assert (q[1].vertices, q[1].faces, q[1].is_watertight) == (40, 60, True)
    assert (q[2].vertices, q[2].faces) == (8, 12)


@pytest.mark.parametrize("stage,flat,n_faces,open_,merged", [(1, 1, 24, 0, 0), (1, 0, 20, 6, 0), (0, 1, 16, 6, 6), (0, 0, 12, 6, 6)])
def test_auditorium_cases(spark, stage, flat, n_faces, open_, merged):
    section = rooms.auditorium_section({"lo_x": 0.0, "lo_y": 0.0, "lo_z": 0.0, "hi_x": 4.0, "hi_y": 6.0, "hi_z": 3.0}, 0.1, rooms.Room(stage_depth=1.0, stage_height=0.5 * stage, flat_depth=1.0 * flat))
    v, f = rooms._frames(spark, *rooms.auditorium_mesh(section, 0.0, 4.0))
    assert (v.count(), f.count()) == (14, n_faces)
    assert meshes.quality(v, f).first().boundary_edges == open_
    assert meshes.quality(*meshes.merge_vertices(v, f)).first().boundary_edges == merged
    # What is inside: the box, less the stage and the wedge below the slope.
    slope = 6.0 - 1.0 - flat
    inside = 4 * (6 * 3 - 0.5 * stage - 0.1 * slope**2 / 2)
    if stage:
        q = meshes.quality(*meshes.merge_vertices(v, f)).first()
        assert q.is_watertight and abs(-q.volume - inside) < 1e-9
    else:
        v, f = rooms._frames(spark, *rooms.auditorium_mesh(section, 0.0, 4.0, close_stage_gap=True))
        q = meshes.quality(*meshes.merge_vertices(v, f)).first()
        assert q.boundary_edges == 0 and abs(-q.volume - inside) < 1e-9


def test_ears_of_a_polygon():
    shape = [(0.0, 2.0), (1.0, 2.0), (1.0, 0.0), (3.0, 0.0), (6.0, 0.0), (6.0, 5.0), (0.0, 5.0)]
    found = rooms.triangles(shape, list(range(7)))
    area = lambda t: sum(shape[t[n]][0] * shape[t[n - 2]][1] - shape[t[n]][1] * shape[t[n - 2]][0] for n in range(3)) / 2
    assert len(found) == 5 and all(area(t) >= 0 for t in found) and abs(sum(map(area, found)) - 28.0) < 1e-12
    assert len(rooms.triangles([(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [0, 1, 2, 3])) == 2  # repeated corners


def test_auditorium_ceiling_rises_over_a_steep_floor():
    bounds = {"lo_x": 0.0, "lo_y": 0.0, "lo_z": 1.0, "hi_x": 4.0, "hi_y": 6.0, "hi_z": 3.0}
    section = rooms.auditorium_section(bounds, 1.0, rooms.Room(stage_depth=1.0, flat_depth=1.0))
    assert section[4] == (6.0, 5.0) and section[5] == (6.0, 7.0)
    section = rooms.auditorium_section(bounds, 0.1, rooms.Room(stage_depth=1.0, flat_depth=1.0, stage_height=0.5), lambda y: 0.25 if y == 2.0 else None)
    assert section[0] == (0.0, 1.5) and section[2] == (1.0, 0.25)


def test_rooms(spark):
    v, _ = box_mesh(spark, (4, 6, 1))
    q = meshes.quality(*rooms.build_room(v, rooms.Room())).first()
    assert q.is_watertight and q.volume < 0  # faces look inward
    v2, f2 = rooms.build_room(v, rooms.Room(vents=({"type": "inlet", "size": (0.5, 0.5)},)))
    assert meshes.quality(v2, f2).first().boundary_edges == 12 or meshes.quality(v2, f2).first().boundary_edges > 0
    with pytest.raises(ValueError):
        rooms.build_room(v, rooms.Room(vents=({"size": (9, 9)},)))
    turned = rooms.aligned(v, -25.0)
    room = rooms.build_room(turned, rooms.Room(rotation_deg=25.0))
    q = meshes.quality(*room).first()
    assert abs(-q.volume - 4.2 * 6.2 * 1.5) < 1e-6
    back = {r.vid: (r.x, r.y) for r in rooms.aligned(turned, 25.0).collect()}
    assert all(math.dist(back[r.vid], (r.x, r.y)) < 1e-9 for r in v.collect())
    low = rooms.clearance(v, 0.5, 2.0)
    assert abs(low - (0 - 0.5 * 4)) < 1e-12


def test_suppression_is_greedy(spark):
    r = random.Random(7)
    boxes = []
    for n in range(120):
        lo = [r.uniform(0, 4) for _ in range(3)]
        size = [r.uniform(0.3, 1.5) for _ in range(3)]
        boxes.append((n, *lo, *(a + b for a, b in zip(lo, size)), size[0] * size[1], r.randrange(5)))
    df = spark.createDataFrame(boxes, "object_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, footprint double, point_count int")

    def overlap(a, b):
        inter = math.prod(max(0, min(a[k + 3], b[k + 3]) - max(a[k], b[k])) for k in (1, 2, 3))
        return inter / min(math.prod(x[k + 3] - x[k] for k in (1, 2, 3)) for x in (a, b))

    taken, want = [], []
    for b in sorted(boxes, key=lambda b: (-b[8], -b[7], b[0])):
        rival = next((t for t in taken if overlap(b, t) >= 0.15), None)
        want.append((b[0], rival is None, rival and rival[0]))
        if rival is None:
            taken.append(b)
    got = sorted(map(tuple, objects.suppress(df, 0.15).collect()))
    assert got == sorted((a, b, c if not b else None) for a, b, c in want)
    assert objects.suppress(df, 0).filter("accepted").count() == 120
    assert sorted(map(tuple, objects.suppress(df, 0.15, group_pairs=30).collect())) == got  # large components in rounds


def test_no_mesh_goes_through_the_driver(spark, tmp_path):
    """What explode makes of a small file isn't small: joins of vertices, faces and cells' points are shuffled."""
    from pointloom.plans import editor

    spark.range(30).selectExpr("id AS object_id", "concat('m', id) AS mesh_id", "0D AS lo_x", "0D AS lo_y", "0D AS lo_z", "1D AS hi_x", "2D AS hi_y", "3D AS hi_z", "1D AS size_x", "2D AS size_y", "'oversized' AS classification", "1D AS n_cols", "1D AS n_rows", "0 AS i", "0 AS j", "mesh_id AS placement").write.parquet(str(tmp_path / "boxes"))
    df = spark.read.parquet(str(tmp_path / "boxes"))
    v, f = meshes.boxes(df)
    where = df.selectExpr("mesh_id", "0D AS angle", "lo_x AS place_x", "lo_y AS place_y", "lo_z AS place_z")
    added = df.selectExpr("concat('a', mesh_id) AS name", "mesh_id", "lo_x AS x", "lo_y AS y", "lo_z AS z", "1D AS scale", "0D AS rotation_degrees")
    points = v.join(df.select("mesh_id", "object_id").hint("merge"), "mesh_id").select("object_id", *"xyz")
    made = [meshes.corners(v, f), meshes.quality(v, f), meshes.centroid(v, f), *meshes.merge_vertices(v, f), meshes.stand(v, where), editor.added_objects(v, added), objects.cell_points(points, df, "object_id")]
    for df in made:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0
    out, faces = meshes.export(v, f)
    assert [r.vid for r in out.orderBy("vid").collect()] == list(range(240))
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1  # one row a range


def test_suppression_pairs_no_crowd(spark, monkeypatch):
    """Of a thousand boxes at one place only the first run's are paired among themselves; results don't depend on the runs."""
    df = spark.range(1000).selectExpr("id AS object_id", "(id * 37) % 400 AS point_count", "1D AS footprint", "(id % 9) * 0.05D AS lo_x", "0D AS lo_y", "0D AS lo_z", "(id % 9) * 0.05D + 1 AS hi_x", "1D AS hi_y", "1D AS hi_z")
    whole = sorted(map(tuple, objects.suppress(df, 0.4, first=1000).collect()))
    paired, pairs = [], objects.overlaps
    monkeypatch.setattr(objects, "overlaps", lambda *a: paired.append((found := pairs(*a)).count()) or found)
    assert sorted(map(tuple, objects.suppress(df, 0.4, first=10).collect())) == whole
    assert sum(paired) <= 45
    assert [x[1] for x in whole].count(True) == 1


def test_suppression_thins_crowds(spark, monkeypatch):
    """Copies and crowds are decided by the best of their cells, at all sizes of runs as one box after the other would be."""
    r = random.Random(12)
    boxes = []
    for n in range(400):
        lo = [r.choice((0.0, 0.1, 1.3, 4.0, -2.7)) + r.choice((0.0, 0.0, 0.05, r.random())) for _ in range(3)]
        size = [r.choice((0.5, 1.0, 1.5)) for _ in range(3)] if n % 40 else [6.0, 6.0, 6.0]
        boxes.append((n, *lo, *(a + b for a, b in zip(lo, size)), size[0] * size[1], r.randrange(20)))
    boxes += [(400 + n, *b[1:7], b[7], r.randrange(20)) for n, b in enumerate(boxes[:300])]  # copies of other quality
    boxes += [(700, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 30), (701, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 30), (702, None, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, None)]  # overlap none
    df = spark.createDataFrame(boxes, "object_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, footprint double, point_count int")

    def overlap(a, b):
        inter = math.prod(max(0, min(a[k + 3], b[k + 3]) - max(a[k], b[k])) for k in (1, 2, 3))
        return inter / min(math.prod(x[k + 3] - x[k] for k in (1, 2, 3)) for x in (a, b)) if inter else 0

    taken, want = [], [(700, True, None), (701, True, None), (702, True, None)]
    for b in sorted(boxes[:700], key=lambda b: (-b[8], -b[7], b[0])):
        rival = next((t for t in taken if overlap(b, t) >= 0.4), None)
        want.append((b[0], rival is None, rival and rival[0]))
        if rival is None:
            taken.append(b)
    paired, pairs, thinned, thin = [], objects.overlaps, [], objects._thinned
    monkeypatch.setattr(objects, "overlaps", lambda *a: paired.append((found := pairs(*a)).count()) or found)
    monkeypatch.setattr(objects, "_thinned", lambda *a: thinned.append(a) or thin(*a))
    made = {}
    for first in (1000, 12):
        paired.clear()
        assert sorted(map(tuple, objects.suppress(df, 0.4, first=first).collect())) == sorted(want)
        made[first] = sum(paired)
    assert thinned and made[12] * 4 < made[1000]


def test_first_merged_settles_the_best_only(spark, monkeypatch):
    """All are read and ranked; verdicts on worse boxes are made only if too few of the best were merged."""
    df = spark.range(300).selectExpr("id AS object_id", "concat('o', id) AS source", "cast((id * 37) % 100 AS int) AS point_count", "1D AS footprint", "(id % 60) * 2D AS lo_x", "0D AS lo_y", "0D AS lo_z", "(id % 60) * 2D + 1 + id / 1000D AS hi_x", "1D AS hi_y", "1D AS hi_z").repartition(4)
    name = {r.object_id: r for r in df.collect()}
    whole = sorted((r for r in objects.suppress(df, 0.4).filter("NOT accepted").collect()), key=lambda r: (-name[r.object_id].point_count, r.object_id))
    settled, suppress = [], objects.suppress
    monkeypatch.setattr(objects, "suppress", lambda b, *a: settled.append(b.count()) or suppress(b, *a))
    for first, tried in ((100, [100]), (20, [20, 300]), (4096, [300])):
        settled.clear()
        got = [(r.source, r.merged_with) for r in objects.first_merged(df, 0.4, 10, first).collect()]
        assert got == [(f"o{r.object_id}", f"o{r.merged_with}") for r in whole[:10]] and settled == tried


def test_suppression_of_a_long_chain(spark):
    """Each box overlaps the next, better first: every other one is accepted, in as many jobs as a short chain takes."""
    def run(n):
        df = spark.range(n).selectExpr("id AS object_id", "id * 1D AS lo_x", "0D AS lo_y", "0D AS lo_z", "id + 1.5D AS hi_x", "1D AS hi_y", "1D AS hi_z", "1D AS footprint", "cast(5000 - id AS int) AS point_count")
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        found = sorted(map(tuple, objects.suppress(df, 0.3).collect()))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found == [(k, k % 2 == 0, k - 1 if k % 2 else None) for k in range(n)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert run(1000) <= run(10) + 3


def test_overlaps_of_very_unlike_sizes(spark):
    r = random.Random(3)
    boxes = [(0, 0.0, 0.0, 0.0, 100.0, 100.0, 3.0), (1, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0), (2, -1.0, -1.0, -1.0, 0.0, 0.0, 0.0)]
    for n in range(3, 90):
        lo, size = [r.uniform(-2, 6) for _ in range(3)], [r.choice((0.01, 0.3, 1.0, 2.0, 4.0, 7.5)) for _ in range(3)]
        boxes.append((n, *lo, *(a + b for a, b in zip(lo, size))))
    boxes.append((90, 0.0, 0.0, 0.0, float("inf"), 1.0, 1.0))
    df = spark.createDataFrame(boxes, "object_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    volume = lambda b: math.prod(b[k + 3] - b[k] for k in (1, 2, 3))
    want = {}
    for a in boxes[:-1]:
        for b in boxes[:-1]:
            inter = math.prod(max(0.0, min(a[k + 3], b[k + 3]) - max(a[k], b[k])) for k in (1, 2, 3))
            if a[0] < b[0] and inter > 0 and inter / min(volume(a), volume(b)) >= 0.1:
                want[a[0], b[0]] = inter / min(volume(a), volume(b))
    got = {(x.a, x.b): x.overlap for x in objects.overlaps(df, 0.1).collect()}
    assert got.keys() == want.keys() and len(want) > 100 and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert objects.overlaps(df.limit(0), 0.1).count() == 0


def test_overlaps_of_copies_are_found_once(spark, monkeypatch):
    """Boxes of one place meet others as packs, over groups too; all their pairs are told."""
    boxes = [(n, 0.3 * (n % 5) - 1.0, 0.0, -0.5, 0.3 * (n % 5), 1.0 + n % 2, 0.5) for n in range(600)]
    df = spark.createDataFrame(boxes, "object_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double").repartition(3)
    volume = lambda b: math.prod(b[k + 3] - b[k] for k in (1, 2, 3))
    inter = lambda a, b: math.prod(max(0.0, min(a[k + 3], b[k + 3]) - max(a[k], b[k])) for k in (1, 2, 3))
    share = {(p[0], q[0]): inter(p, q) / min(volume(p), volume(q)) for p in boxes[:10] for q in boxes[:10]}
    want = {(a, b): share[a % 10, b % 10] for a in range(600) for b in range(a + 1, 600) if share[a % 10, b % 10] >= 0.4}
    met, meet = [], objects._meetings
    monkeypatch.setattr(objects, "_meetings", lambda home, *a, **k: met.append(home.count()) or meet(home, *a, **k))
    for cell_boxes, pack in ((1 << 16, 1 << 10), (100, 7)):
        monkeypatch.setattr(objects, "CELL_BOXES", cell_boxes)
        got = objects.overlaps(df, 0.4, pack=pack).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.overlap for x in got} == want
    assert met == [10, 90]


def test_eps_components_of_dense_cells(spark):
    r = random.Random(11)
    pts = [(n, *(r.gauss(c, 0.02) for c in r.choice(((0, 0, 0), (0.3, 0, 0), (0, 0.3, 0.1))))) for n in range(300)]
    pts += [(300 + n, *(r.uniform(-0.5, 0.5) for _ in range(3))) for n in range(200)]
    pts += [(500, None, 0.0, 0.0), (501, None, 0.0, 0.0), (502, float("nan"), 0.0, 0.0), (503, 9.0, 9.0, 9.0), (504, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "point_id long, x double, y double, z double").repartition(5)
    for eps in (0.0, 0.05, 0.12):
        root = {p[0]: p[0] for p in pts}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a in pts:
            for b in pts:
                if a[0] < b[0] and None not in a + b and sum((u - v) ** 2 for u, v in zip(a[1:], b[1:])) <= eps * eps:
                    x, y = find(a[0]), find(b[0])
                    root[max(x, y)] = min(x, y)
        assert {(x.point_id, x.root) for x in voxels.dbscan_components(df, eps=eps).collect()} == {(p[0], find(p[0])) for p in pts}


def test_eps_components_divide_dense_cells(spark, monkeypatch):
    """Two slabs of many points just within, or just beyond, reach of each other."""
    monkeypatch.setattr(voxels, "BOX_PAIRS", 16)
    r = random.Random(4)
    slab = lambda x, n: [(x, r.uniform(0, 0.5), r.uniform(0, 0.5)) for _ in range(n)]
    for gap, roots in ((0.999, 1), (1.001, 2)):
        pts = slab(0.0, 400) + slab(gap, 400) + [(0.0, 0.25, 0.25), (gap, 0.25, 0.25)]
        df = spark.createDataFrame([(n, *p) for n, p in enumerate(pts)], "point_id long, x double, y double, z double")
        assert voxels.dbscan_components(df, eps=1.0).select("root").distinct().count() == roots


def test_masks_as_words(spark):
    r = random.Random(8)
    runs = [(r.choice("ab"), r.randrange(4), r.randrange(6), a := r.randrange(-5, 200), a + r.choice((-1, 0, 3, 63, 64, 130))) for _ in range(80)]
    pixels = [(n, f, u, v) for n, (f, u, v) in enumerate((r.choice("abc"), r.randrange(260), r.randrange(7)) for _ in range(2000))]
    masks = spark.createDataFrame(runs, "frame_id string, mask_id int, v int, u_start int, u_end int")
    projected = spark.createDataFrame([(f, n, u, v, 1.0) for n, f, u, v in pixels], "frame_id string, point_id long, u int, v int, z double")
    want = {(n, m) for n, f, u, v in pixels for g, m, w, a, b in runs if f == g and v == w and a <= u <= b}
    got = [(x.point_id, x.mask_id) for x in visibility.in_masks(projected, masks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(x.point_id for x in visibility.covered(projected, masks).collect()) == sorted({n for n, _ in want})


@pytest.mark.parametrize("spots", [0, 100_000])
def test_counts_of_cells(spark, monkeypatch, spots):
    """As cell_points() has them, whether points are broadcast or dealt; what is joined with points is counted before it is shuffled."""
    monkeypatch.setattr(objects, "SPOTS", spots)
    r = random.Random(5)
    boxes = [(n, f"o{n}", n % 3, 0.5 * (n % 4), 0.25 * (n % 2), r.choice((0.4, 1.0, 1.7)), r.choice((0.4, 0.9)), 100) for n in range(40)]
    df = spark.createDataFrame(boxes, "object_id long, source string, fragment int, lo_x double, lo_y double, size_x double, size_y double, point_count int").withColumn("footprint", F.expr("size_x * size_y"))
    grid = objects.placements(objects.classify(df, 0.35, 0.6, 1.8), 0.35)
    shares = [(n % 2, r.choice((0.0, 0.5, r.random())), 0.9 * r.random(), 0.0) for n in range(30)]  # fragment 2 has none
    points = spark.createDataFrame(shares, "fragment int, x double, y double, z double")
    own = df.join(points, "fragment").select("object_id", F.expr("lo_x + x * size_x AS x"), F.expr("lo_y + y * size_y AS y"), "z")
    want = sorted(map(tuple, objects.cell_points(own, grid, "object_id").groupBy("placement").count().collect()))
    found = objects.cell_counts(grid, points, "fragment")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 40
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    tests = [k for k, line in enumerate(plan) if "Join" in line and "size_x" in line and "* " in line]
    assert tests and all("HashAggregate" in plan[k - 1] or "Project" in plan[k - 1] and "HashAggregate" in plan[k - 2] for k in tests)


def test_points_of_cells(spark):
    grid = spark.createDataFrame([("a_g0_0", "a", "oversized", 0, 0, 2, 1), ("a_g1_0", "a", "oversized", 1, 0, 2, 1), ("b", "b", "normal", 0, 0, 1, 1)], "placement string, source string, classification string, i int, j int, n_cols int, n_rows int")
    grid = grid.withColumns({f"{k}_{c}": F.lit(v) for k, v in (("lo", 0.0), ("size", 2.0)) for c in "xy"})
    points = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 0.5, 1.0, 0.0), ("b", 2.0, 2.0, 0.0)], "source string, x double, y double, z double")
    n = {r.placement: r["count"] for r in objects.cell_points(points, grid, "source").groupBy("placement").count().collect()}
    assert n == {"a_g0_0": 2, "a_g1_0": 2, "b": 1}  # the second cell is empty, the last point on its object's upper side


def test_occupancy_golden():
    assert edits.occupied(10, 50, 42) == {3, 5, 6, 7, 8}
    assert edits.occupied(10, 25, 0) == {0, 5}
    assert edits.occupied(20, 30, 7) == {1, 2, 6, 8, 13, 18}
    assert edits.occupied(7, 50, 123456789) == {0, 3, 4, 6}
    assert edits.occupied(10, 0, 1) == set() and edits.occupied(10, 100, 1) == set(range(10)) and edits.occupied(0, 50, 1) == set()


def test_rebuild_is_idempotent(spark):
    v, _ = box_mesh(spark, (1, 1, 1), (2, 1, 1), (3, 1, 1))
    v = v.withColumn("mesh_id", F.concat(F.lit("o"), "mesh_id"))
    originals = spark.createDataFrame([("o0", 0), ("o1", 1), ("o2", 2)], "source string, object_id long")
    e = spark.createDataFrame([("o0", True, 0.0, 0.0, 0.0, 0.0), ("o1", False, 1.0, 0.0, 0.0, 90.0), ("gone", False, 1.0, 0.0, 0.0, 0.0)], "source string, deleted boolean, dx double, dy double, dz double, turn double")
    one = sorted(map(tuple, edits.rebuild(v, e, originals).collect()))
    assert one == sorted(map(tuple, edits.rebuild(v, e, originals).collect()))
    assert {r[0] for r in one} == {"o1", "o2"}
    same = {tuple(r) for r in v.filter("mesh_id = 'o2'").collect()}
    assert {r for r in one if r[0] == "o2"} == same
    assert [r.source for r in edits.unmatched(e, originals).collect()] == ["gone"]


def test_dimensions_and_versions(spark):
    a = {k: 1.0 for k in edits.DIMENSIONS}
    df = spark.createDataFrame([(a, a), (a, a | {"leg_inset": 1.0 + 2e-6}), (a, a | {"width": 1.0 + 1e-7}), (a, a | {"_private": 2.0})], "p map<string,double>, q map<string,double>")
    got = [r[0] for r in df.select(edits.dimensions_changed(F.col("p"), F.col("q"))).collect()]
    assert got == [False, True, False, False]
    assert "_private" not in df.select(edits.public_keys(F.col("q"))).collect()[3][0]
    assert edits.next_version(["config_v2.yaml", "config_v10.yaml", "x"]) == 11 and edits.next_version([]) == 1


def test_plane_and_axis(spark):
    r = np.random.default_rng(5)
    rows = [(n, float(x), float(y), float(0.2 * x - 0.1 * y + 1), float(x), float(y), 3.0) for n, (x, y) in enumerate(r.random((20, 2)))]
    df = spark.createDataFrame(rows, "object_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    assert np.allclose(objects.plane_fit(df), (0.2, -0.1, 1.0))
    line = df.withColumn("lo_y", F.lit(0.0)).withColumn("hi_y", F.lit(0.0)).withColumn("lo_z", F.col("lo_x") * 2)
    assert np.allclose(objects.plane_fit(line), (2.0, 0.0, 0.0), atol=1e-9)
    pts = [(f, f * 1.0 + 0.01 * k, float(f % 3) + 0.01 * (k % 5), 0.02 * (k // 20)) for f in range(6) for k in range(60)]
    axis = objects.vertical_axis(spark.createDataFrame(pts, "fragment int, x double, y double, z double"), "fragment")
    assert axis[2] > 0.99
    assert objects.vertical_axis(spark.createDataFrame(pts[:60], "fragment int, x double, y double, z double"), "fragment") == (0.0, 0.0, 1.0)


def test_orientation_search_recovers_a_turn(spark):
    box = spark.createDataFrame([(0, -0.5, -0.2, 0.0, 0.5, 0.2, 0.3)], "mesh_id int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    v, f = meshes.boxes(box)
    va = np.array([tuple(r)[2:] for r in v.orderBy("vid").collect()])
    fa = np.array([tuple(r)[2:] for r in f.collect()])
    angle = 50.0
    r = math.radians(angle)
    pts = icp.sample_surface(va, fa, 700, 1) @ np.array([[math.cos(r), -math.sin(r), 0], [math.sin(r), math.cos(r), 0], [0, 0, 1]]).T
    got = icp.best_orientation(spark.createDataFrame([("a", *map(float, p)) for p in pts], "object string, x double, y double, z double"), v, f, "object", threshold=0.08).first()
    assert got.fitness > 0.6
    assert min(abs((got.angle - angle) % 180), 180 - abs((got.angle - angle) % 180)) <= 5


def test_orientation_search_of_a_thin_scan(spark):
    v, f = box_mesh(spark, (1.0, 0.4, 0.3))
    va, fa = (np.array([tuple(r)[2:] for r in d.collect()]) for d in (v.orderBy("vid"), f))
    pts = icp.sample_surface(va, fa, 60, 1) @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]).T
    assert icp.spacing(pts) > 0.02 / 3 and icp.spacing(np.array([[0.0, 0, 0], [3, 4, 0]])) == 5
    got = icp.best_orientation(spark.createDataFrame([("a", *map(float, p)) for p in pts], "object string, x double, y double, z double"), v, f, "object", threshold=0.02).first()
    assert got.fitness > 0.6 and min(got.angle % 180 - 90, 0) > -6 and got.angle % 180 < 96


def test_orientation_search_takes_the_first_of_the_fittest(spark, monkeypatch):
    v, f = box_mesh(spark, (1.0, 0.4, 0.3))
    va, fa = (np.array([tuple(r)[2:] for r in d.collect()]) for d in (v.orderBy("vid"), f))
    pts = icp.sample_surface(va, fa, 200, 1) + [7.0, -3.0, 2.0]
    points = spark.createDataFrame([("a", *map(float, p)) for p in pts], "object string, x double, y double, z double")
    # No alignment and a reach beyond everything: all trials are equally fit. Then, means (not box middles) are what meets.
    found = icp.best_orientation(points, v, f, "object", threshold=9.0, rounds=0, base=15.0).first()
    assert (found.angle, found.fitness) == (15.0, 1.0)
    far = points.union(points.limit(1).selectExpr("object", "x + 5 AS x", "y", "z"))
    assert icp.best_orientation(far, v, f, "object", threshold=0.15, rounds=0).first().fitness > 0.9


def test_filtering_stats_name_the_largest(spark):
    labels = spark.range(60 * 61 // 2).selectExpr("id AS point_id", "cast(floor((sqrt(8D * id + 1) - 1) / 2) as long) AS root")
    r = voxels.filtering_stats(labels, 3, voxel_size=0.02).first()
    assert r.largest_sizes == list(range(60, 10, -1)) and (r.voxel_size, r.eps, r.components_found, r.components_kept) == (0.02, None, 60, 58)
