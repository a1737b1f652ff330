"""Queries of the library's own operators over the derived scene, each with SQL for its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import distance, healing, projection, visibility, voxels

from .scene import CAMERA, Scene, with_views
from .scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Scene under a name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Scene(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


CLOUD_VIEWS = ("points", "frames", "projected", "loose", "mask_runs", "masked", "counts")


def _projected(s: Scene) -> DataFrame:
    return projection.project(s.points(), s.frames(), CAMERA)


def _loose(s: Scene) -> DataFrame:
    return visibility.unoccluded(_projected(s), visibility.loose_tolerance(0.05))


def _loose_covered(s: Scene) -> DataFrame:
    """Of _loose() those that some mask covers: masks cover whole pixels."""
    return visibility.unoccluded(visibility.covered(_projected(s), s.mask_runs()), visibility.loose_tolerance(0.05))


def _counts(s: Scene) -> DataFrame:
    return visibility.seen_counts(_projected(s), s.mask_runs(), 0.05)


# ---- extraction ------------------------------------------------------------------------------------------------------


@query(
    "p01_undo_dataparser",
    with_views("points", query="SELECT point_id, round(0.8 * (x / 2 - 0.1) + 0.6 * (y / 2 - 0.2), 6) AS x, round(z / 2 - 0.3, 6) AS y, round(-(-0.6 * (x / 2 - 0.1) + 0.8 * (y / 2 - 0.2)), 6) AS z FROM points"),
)
def p01(s):
    out = projection.undo_dataparser(s.points(), [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [0.1, 0.2, 0.3], 2.0)
    return out.select("point_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("p02_world_to_camera", with_views("frames", query="SELECT frame_id, unnest(range(12)) AS cell, round(unnest([c, s, 0, -(c * 0.5 + s * 0.5), s, -c, 0, -(s * 0.5 - c * 0.5), 0, 0, -1, tz]), 6) + 0 AS value FROM frames"))
def p02(s):
    cells = projection.world_to_camera(s.frames()).select("frame_id", F.posexplode("w2c").alias("cell", "value"))
    return cells.select("frame_id", F.col("cell").cast("long").alias("cell"), (F.round("value", 6) + 0.0).alias("value"))


@query("p03_projection", with_views("points", "frames", "projected", query="SELECT frame_id, count(*) AS n, sum(u)::BIGINT AS sum_u, sum(v)::BIGINT AS sum_v, round(sum(z), 4) AS sum_z FROM projected GROUP BY frame_id"))
def p03(s):
    return _projected(s).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"), F.sum("v").alias("sum_v"), F.round(F.sum("z"), 4).alias("sum_z"))


@query("f03_loose_zbuffer", with_views("points", "frames", "projected", "loose", query="SELECT frame_id, count(*) AS n, sum(point_id)::BIGINT AS ids FROM loose GROUP BY frame_id"))
def f03(s):
    return _loose(s).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


@query("a03_depth_buffer", with_views("points", "frames", "projected", query="SELECT frame_id, u, v, round(min(z), 6) AS min_z FROM projected GROUP BY ALL"))
def a03(s):
    return visibility.depth_buffer(_projected(s)).withColumn("min_z", F.round("min_z", 6))


@query("j04_in_masks", with_views(*CLOUD_VIEWS[:6], query="SELECT frame_id, mask_id, count(*) AS n, sum(point_id)::BIGINT AS ids FROM masked GROUP BY ALL"))
def j04(s):
    pixels = _loose_covered(s).groupBy("frame_id", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))  # a mask has all of a pixel's points
    return visibility.in_masks(pixels.hint("shuffle_hash"), s.mask_runs()).groupBy("frame_id", "mask_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("a01_view_counts", with_views(*CLOUD_VIEWS, query="SELECT point_id, n_views FROM counts"))
def a01(s):
    return _counts(s)


@query("a02_view_histogram", with_views(*CLOUD_VIEWS, query="SELECT t::INTEGER AS min_views, count(*) AS n_points FROM counts, (SELECT unnest([1, 2, 3, 5, 10, 20]) AS t) WHERE n_views >= t GROUP BY t"))
def a02(s):
    return visibility.view_histogram(_counts(s))


@query("f07_consensus", with_views(*CLOUD_VIEWS, query="SELECT point_id, n_views FROM counts WHERE n_views >= 2"))
def f07(s):
    return visibility.consensus(_counts(s), 2)


@query("k02_view_colours", with_views(*CLOUD_VIEWS, query="SELECT point_id, n_views, round(n_views / max(n_views) OVER (), 6) AS r, 0::DOUBLE AS g, round(1 - n_views / max(n_views) OVER (), 6) AS b FROM counts"))
def k02(s):
    return visibility.view_colours(_counts(s)).withColumns({c: F.round(c, 6) for c in "rb"})


REFINED = """, chosen AS (SELECT point_id FROM counts WHERE n_views >= 2),
own AS (SELECT * FROM projected WHERE point_id IN (SELECT point_id FROM chosen) QUALIFY z <= min(z) OVER (PARTITION BY frame_id, u, v) + 0.5),
hit AS (SELECT DISTINCT p.frame_id, mask_id, point_id, u, p.v, z, u // 32 AS pu, p.v // 32 AS pv FROM own p JOIN mask_runs m ON p.frame_id = m.frame_id AND p.v = m.v AND u BETWEEN u_start AND u_end),
med AS (SELECT frame_id, mask_id, pu, pv, count(*) AS n, quantile_cont(z, 0.5) AS med FROM hit GROUP BY ALL),
mad AS (SELECT frame_id, mask_id, pu, pv, any_value(n) AS n, any_value(med) AS med, greatest(quantile_cont(abs(z - med), 0.5), 0.005::DOUBLE) AS mad FROM hit JOIN med USING (frame_id, mask_id, pu, pv) GROUP BY ALL),
"""


@query(
    "a04_patch_bands",
    with_views(*CLOUD_VIEWS, query="SELECT 1").removesuffix("\nSELECT 1") + REFINED + "x AS (SELECT 1) SELECT frame_id, mask_id, pu::BIGINT AS patch_u, pv::BIGINT AS patch_v, n, round(med, 6) AS med, round(mad, 6) AS mad FROM mad",
)
def a04(s):
    chosen = materialize(visibility.chosen_covered(_projected(s), s.mask_runs(), visibility.consensus(_counts(s), 2)), "chosen")
    own = visibility.depths(visibility.unoccluded(chosen, 0.5))
    rows = visibility.patches(visibility.in_masks(own, s.mask_runs()), 32, weight="points")
    return rows.select("frame_id", "mask_id", "patch_u", "patch_v", "n", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query(
    "x12_refined_points",
    with_views(*CLOUD_VIEWS, query="SELECT 1").removesuffix("\nSELECT 1") + REFINED + """band AS (SELECT h.* FROM hit h JOIN mad USING (frame_id, mask_id, pu, pv) WHERE n < 5 OR z BETWEEN med - 2 * mad AND med + 2 * mad),
zbuf AS (SELECT * FROM band QUALIFY z <= min(z) OVER (PARTITION BY frame_id, mask_id, u, v) + 0.05) SELECT DISTINCT point_id FROM zbuf""",
)
def x12(s):
    return visibility.extract(_projected(s), s.mask_runs(), 2)


@query("f18_frames_without_pose", "SELECT n_nationkey % 2 = 0 AS has_pose, count(*) AS n FROM nation GROUP BY ALL")
def f18(s):
    some = s.frames().filter("frame_id % 2 = 0").withColumn("frame_stem", F.expr("if(frame_id % 4 = 0, frame_stem, 'other')"))
    out = projection.resolve_frames(s.frames().select(F.concat(F.lit("frame_"), "frame_id").alias("frame")), some)
    return out.groupBy(F.col("c2w").isNotNull().alias("has_pose")).agg(F.count(F.lit(1)).alias("n"))


# ---- components ------------------------------------------------------------------------------------------------------

VOXELS = """grid AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS most, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM cloud),
voxelled AS (SELECT c.*, floor((x - (lx - most * 0.001)) / ((most + 2 * (most * 0.001)) / {side}))::BIGINT AS i, floor((y - (ly - most * 0.001)) / ((most + 2 * (most * 0.001)) / {side}))::BIGINT AS j,
    floor((z - (lz - most * 0.001)) / ((most + 2 * (most * 0.001)) / {side}))::BIGINT AS k FROM cloud c, grid),
vox AS (SELECT i, j, k, min(point_id) AS vid FROM voxelled GROUP BY i, j, k),
near AS (SELECT a.vid AS a, b.vid AS b FROM vox a JOIN (SELECT vid, i + di AS i, j + dj AS j, k + dk AS k FROM vox, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj), (SELECT unnest([-1, 0, 1]) AS dk)) b USING (i, j, k)),
reach AS (SELECT vid AS a, vid AS b FROM vox UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
roots AS (SELECT a AS vid, min(b) AS root FROM reach GROUP BY a),
labels AS (SELECT point_id, root FROM voxelled JOIN vox USING (i, j, k) JOIN roots USING (vid)),
sizes AS (SELECT root, count(*) AS n_points FROM labels GROUP BY root)
"""


def _voxel_sql(level: int, query: str) -> str:
    return with_views("cloud", query="", recursive=True).rstrip() + ",\n" + VOXELS.replace("{side}", str(1 << level)) + query


@query("p04_voxel_index", _voxel_sql(5, "SELECT point_id, i, j, k FROM voxelled"))
def p04(s):
    return voxels.voxelize(s.cloud(), 5).select("point_id", "i", "j", "k")


@query("j08_voxel_edges", _voxel_sql(5, "SELECT least(a, b) AS a, greatest(a, b) AS b FROM near WHERE a < b"))
def j08(s):
    grid = voxels.voxelize(s.cloud(), 5).groupBy("i", "j", "k").agg(F.min("point_id").alias("vid"))
    return voxels.voxel_edges(grid).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


for _level in (3, 4, 5, 6):

    @query(f"g01_octree_components_{_level}", _voxel_sql(_level, "SELECT point_id, root FROM labels"))
    def g01(s, level=_level):
        return voxels.octree_components(s.cloud(), level)


@query("f08_component_filter", _voxel_sql(5, "SELECT point_id, dense_rank() OVER (ORDER BY root) - 1 AS component_id FROM labels WHERE root IN (SELECT root FROM sizes WHERE n_points >= 3)"))
def f08(s):
    return voxels.keep_components(voxels.octree_components(s.cloud(), 5), 3).withColumn("component_id", F.col("component_id").cast("long"))


@query("t01_largest_components", _voxel_sql(5, "SELECT root, n_points, n_points >= 3 AS kept FROM sizes ORDER BY n_points DESC, root LIMIT 10"))
def t01(s):
    return voxels.largest_components(voxels.octree_components(s.cloud(), 5), 3)


@query("k07_filtering_stats", _voxel_sql(5, """SELECT sum(n_points)::BIGINT AS input_points, sum(CASE WHEN n_points >= 3 THEN n_points ELSE 0 END)::BIGINT AS output_points, count(*) AS components_found, count(*) FILTER (WHERE n_points >= 3) AS components_kept, count(*) FILTER (WHERE n_points < 3) AS components_removed,
    (SELECT list(n_points ORDER BY n_points DESC) FROM (SELECT n_points FROM sizes ORDER BY n_points DESC LIMIT 50)) AS largest_sizes FROM sizes"""))
def k07(s):
    stats = voxels.filtering_stats(voxels.octree_components(s.cloud(), 5), 3)
    return stats.drop("voxel_size", "eps")  # they repeat what the caller says


@query("g02_dbscan_components", with_views("cloud", query="", recursive=True).rstrip() + """,
near AS (SELECT a.point_id AS a, b.point_id AS b FROM cloud a JOIN cloud b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05::DOUBLE * 0.05::DOUBLE),
reach AS (SELECT point_id AS a, point_id AS b FROM cloud UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS point_id, min(b) AS root FROM reach GROUP BY a""")
def g02(s):
    return voxels.dbscan_components(s.cloud(), eps=0.05)


PAIRS = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query("j15_close_pairs", with_views("cloud", query=f"SELECT a.point_id AS a, b.point_id AS b, round({PAIRS}, 9) AS d2 FROM cloud a JOIN cloud b ON a.point_id < b.point_id WHERE {PAIRS} <= 0.05::DOUBLE * 0.05::DOUBLE"))
def j15(s):
    return distance.close_pairs(s.cloud(), s.cloud(), 0.05).filter("a < b").withColumn("d2", F.round("d2", 9))


@query("j10_nearest_neighbours", with_views("cloud", query=f"SELECT a.point_id AS a, b.point_id AS b, row_number() OVER (PARTITION BY a.point_id ORDER BY {PAIRS}, b.point_id)::INTEGER AS rank FROM cloud a JOIN cloud b ON a.point_id <> b.point_id QUALIFY rank <= 5"))
def j10(s):
    return distance.nearest_neighbours(s.cloud(), 5).select("a", "b", "rank")


@query("a18_spacing", with_views("cloud", query=f"SELECT round(quantile_cont(sqrt(d2), 0.5), 6) AS spacing FROM (SELECT {PAIRS} AS d2 FROM cloud a JOIN cloud b ON a.point_id <> b.point_id QUALIFY row_number() OVER (PARTITION BY a.point_id ORDER BY {PAIRS}, b.point_id) <= 5)"))
def a18(s):
    return distance.nearest_neighbours(s.cloud(), 5).agg(F.round(F.median(F.sqrt("d2")), 6).alias("spacing"))


# ---- healing ---------------------------------------------------------------------------------------------------------

LINKS = """ext AS (SELECT min(x) AS x0, (max(x) - min(x)) / 10 AS w FROM cloud),
slabbed AS (SELECT c.*, s AS slab, x0 + s * w + w AS boundary FROM cloud c, ext, (SELECT unnest(range(10)) AS s) WHERE x >= x0 + s * w AND x < x0 + s * w + w + 0.05::DOUBLE),
cand AS (SELECT a.slab, a.point_id AS a, b.point_id AS b, a.fragment AS src, b.fragment AS dst, a.x AS xa, b.x AS xb, a.boundary, {pairs} AS d2
    FROM slabbed a JOIN slabbed b ON a.slab = b.slab AND a.fragment < b.fragment WHERE {pairs} <= 0.05::DOUBLE * 0.05::DOUBLE),
links AS (SELECT * FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY slab, a, dst ORDER BY d2, b) = 1) WHERE xa <= boundary OR xb <= boundary)
""".replace("{pairs}", PAIRS)
GROUPS = """, both_ways AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach AS (SELECT DISTINCT fragment AS a, fragment AS b FROM cloud UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rooted AS (SELECT a AS fragment, min(b) AS group_root FROM reach GROUP BY a),
named AS (SELECT fragment, group_root, count(*) OVER (PARTITION BY group_root) AS n_fragments,
    CASE WHEN count(*) OVER (PARTITION BY group_root) > 1 THEN concat('merged_group_', group_root) ELSE concat('isolated_', fragment) END AS name FROM rooted)
"""
FILL = """, filled AS (SELECT slab, src, dst, a, b, unnest(range(1, floor(sqrt(d2) / 0.01)::INTEGER + 1))::INTEGER AS step, floor(sqrt(d2) / 0.01)::INTEGER AS steps FROM links WHERE floor(sqrt(d2) / 0.01) > 0),
fillers AS (SELECT f.slab, f.src, f.dst, f.a, f.b, step, (1 - step / (steps + 1)) * p.x + step / (steps + 1) * q.x AS x, (1 - step / (steps + 1)) * p.y + step / (steps + 1) * q.y AS y,
    (1 - step / (steps + 1)) * p.z + step / (steps + 1) * q.z AS z, (1 - step / (steps + 1)) * p.red + step / (steps + 1) * q.red AS red FROM filled f JOIN cloud p ON f.a = p.point_id JOIN cloud q ON f.b = q.point_id)
"""


def _heal_sql(*parts: str, query: str) -> str:
    return with_views("cloud", query="", recursive=True).rstrip() + ",\n" + LINKS + "".join(parts) + query


@query("p06_slabs", _heal_sql(query="SELECT slab, point_id FROM slabbed"))
def p06(s):
    return healing.slabs(s.cloud(), 0.05, 10).select("slab", "point_id")


@query("j09_connections", _heal_sql(query="SELECT slab, a, b, src, dst, round(d2, 9) AS d2 FROM links"))
def j09(s):
    return healing.connections(s.cloud(), 0.05).select("slab", "a", "b", "src", "dst", F.round("d2", 9).alias("d2"))


@query("x01_fillers", _heal_sql(FILL, query="SELECT slab, src, dst, a, b, step, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(red, 4) AS red FROM fillers"))
def x01(s):
    out = healing.fillers(healing.connections(s.cloud(), 0.05), s.cloud(), 0.01)
    return out.select("slab", "src", "dst", "a", "b", "step", *[F.round(c, 6).alias(c) for c in "xyz"], F.round("red", 4).alias("red"))


@query("g03_fragment_groups", _heal_sql(GROUPS, query="SELECT * FROM named"))
def g03(s):
    return healing.groups(s.cloud(), healing.connections(s.cloud(), 0.05))


@query("k08_healed", _heal_sql(GROUPS, FILL, query="""SELECT name, filler, count(*) AS n, round(sum(x), 4) AS sum_x FROM (
    SELECT name, false AS filler, x FROM cloud JOIN named USING (fragment) UNION ALL SELECT name, true, x FROM fillers f JOIN named n ON f.src = n.fragment) GROUP BY ALL"""))
def k08(s):
    return healing.healed(s.cloud(), 0.05, 0.01).groupBy("name", "filler").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))
