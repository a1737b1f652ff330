"""The run of a scene from cloud, cameras and masks to furniture and room.

Every step reads tables of earlier steps in the run's folder and overwrites its own, so a run can begin at any step. Categories
run one after the other; within a step all is one plan. A failing step ends the run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import generators
from pointloom.operators import edits, healing, icp, meshes, objects, projection, rooms, visibility, voxels
from pointloom.sources import cameras, clouds, logs, masks, stl
from pointloom.sources.files import exists, read_text, state

from . import editor
from .config import Config

#: "4b" is done only when asked for: without an editor's changes it has nothing to do.
CATEGORY_STEPS, SCENE_STEPS = ("2", "2b", "3", "4"), ("combine", "4b", "5")
#: Generators of meshes by category. Others name a table function (functions.generators) in their configuration, or use a
#: template.
PROCEDURAL: dict[str, Callable[[DataFrame], DataFrame]] = {"table": meshes.table_parts}


def planned(steps: Iterable[str]) -> tuple[list[str], list[str]]:
    """Steps for each category, then for the scene; placement is followed by combination."""
    asked = set(steps) if "all" not in steps else {*CATEGORY_STEPS, *SCENE_STEPS} - {"4b"} | {*steps} - {"all"}
    if unknown := asked - {*CATEGORY_STEPS, *SCENE_STEPS}:
        raise ValueError(f"no step {sorted(unknown)}")
    return [s for s in CATEGORY_STEPS if s in asked], [s for s in SCENE_STEPS if s in asked or s == "combine" and "4" in asked]


class Run:
    def __init__(self, spark: SparkSession, config: Config, run_dir: str | None = None):
        self.spark, self.config, self.dir = spark, config, run_dir or config.run_dir()

    def path(self, category: str, name: str) -> str:
        return f"{self.dir}/{category}/{name}"

    def read(self, category: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(category, name))

    def write(self, df: DataFrame, category: str, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(category, name))
        return self.read(category, name)

    # -- steps of a category --

    def extract(self, category: str) -> None:
        """Points that the category's masks select. View counts are kept, and read again by later runs, under a key of
        the threshold and of paths, lengths and times of all files that they depend on (S14)."""
        own = self.config.category(category)["extraction"]
        k = cameras.read_intrinsics(self.spark, self.config.input_path("transforms", category))
        cloud = clouds.read_cloud(self.spark, self.config.input_path("point_cloud", category))
        r, t, scale = cameras.read_dataparser(self.spark, self.config.input_path("dataparser", category))
        runs = masks.read_masks(self.spark, f"{self.dir}/1_segmentation/{category}", k.width, k.height)
        frames = projection.resolve_frames(masks.frames_of(runs), cameras.read_frames(self.spark, self.config.input_path("transforms", category)))
        runs = runs.withColumnRenamed("frame", "frame_id")
        projected = projection.project(projection.undo_dataparser(cloud, r, t, scale), frames.withColumnRenamed("frame", "frame_id"), k)
        threshold = own.get("z_threshold", 0.05)
        inputs = [self.config.input_path(n, category) for n in ("point_cloud", "transforms", "dataparser")] + [f"{self.dir}/1_segmentation/{category}"]
        key = "view_counts_" + hashlib.sha256(repr((threshold, [(i, state(self.spark, i)) for i in inputs])).encode()).hexdigest()[:16]
        if exists(self.spark, self.path(category, f"{key}/_SUCCESS")):
            counts = self.read(category, key)
        else:
            counts = self.write(visibility.seen_counts(projected, runs, threshold), category, key)
        chosen = visibility.consensus(counts, own.get("min_views", 2))
        ids = visibility.refine(projected, runs, chosen, threshold, own.get("depth_band_sigma", 2.0), own.get("depth_patch_size", 32), own.get("use_depth_band", True), own.get("use_zbuffer", True))
        raw = self.write(cloud.join(ids, "point_id", "left_semi").drop("path"), category, "raw")
        clouds.write_ply(self._coloured(raw), self.path(category, "FINAL_combined_all_images.ply"))

    @staticmethod
    def _coloured(points: DataFrame) -> DataFrame:
        """points for a PLY: without colours if none has any."""
        colours = ("red", "green", "blue")
        return points.drop(*colours) if points.filter(F.coalesce(*colours).isNotNull()).isEmpty() else points

    def filter(self, category: str) -> None:
        own = self.config.category(category)["filtering"]
        points, level = self.read(category, "raw"), own.get("octree_level", 10)
        if not own.get("enabled", True):
            labels = points.select("point_id").withColumn("root", F.lit(0).cast("long"))
        elif own.get("method", "octree") == "octree":
            labels = voxels.octree_components(points, level)
        else:
            labels = voxels.dbscan_components(points, level, own.get("eps_override"))
        size = eps = None
        if own.get("enabled", True) and own.get("method", "octree") == "octree":
            size = voxels.voxel_size(points, level).first().voxel
        elif own.get("enabled", True):
            eps = voxels.eps_of(points, level, own.get("eps_override"))
        least = own.get("min_points_per_component", 1)
        kept = self.write(points.join(voxels.keep_components(labels, least), "point_id").withColumnRenamed("component_id", "fragment"), category, "filtered")
        clouds.write_ply(self._coloured(kept), self.path(category, "FINAL_filtered.ply"))
        if own.get("debug_colours", False):
            shown = clouds.component_colours(kept.withColumnRenamed("fragment", "component_id"))
            clouds.write_ply(kept.select("point_id", *"xyz").join(shown, "point_id"), self.path(category, "FINAL_components.ply"))
        self.write(voxels.filtering_stats(labels, least, size, eps), category, "filtering_stats")

    def heal(self, category: str) -> None:
        own = self.config.category(category)["healing"]
        points = self.read(category, "filtered").withColumns({c: 255 * F.coalesce(c, F.lit(0.5)) for c in ("red", "green", "blue")})
        self.write(healing.healed(points, own.get("gap_threshold", 0.01), own.get("point_resolution", 0.002), own.get("num_slices", 10)), category, "healed")

    def place(self, category: str) -> None:
        own = self.config.category(category).get("placement", {})
        mode = own.get("mode", "template")
        points = self.read(category, "healed").withColumnRenamed("name", "source").withColumn("point_id", F.monotonically_increasing_id())
        found = objects.bounds(points, "source").withColumn("object_id", F.xxhash64("source"))
        if mode == "procedural":
            v, f, where = self._procedural(category, own, points, found)
        elif mode == "template":
            v, f, where = self._template(own, points, found)
        else:
            raise ValueError(f"no placement mode {mode}")
        self.write(where, category, "placements")
        self.write(v, category, "vertices")
        self.write(f, category, "faces")
        v, f = self.read(category, "vertices"), self.read(category, "faces")
        self.write(meshes.quality(v, f), category, "mesh_quality")
        stl.write_stl(meshes.corners(v, f), self.path(category, "individual"))
        made = ("width", "depth", "height", "tabletop_thickness", "leg_width", "leg_inset")
        known = [c for c in ("classification", "point_count", "footprint") if c in where.columns]
        fixed = {k: F.lit(edits.TABLE[k]) for k in made[3:]}
        sizes = [F.struct(*[fixed.get(k, F.col(k)).alias(k) for k in made]).alias("dimensions")] if mode == "procedural" else []
        placed = self.read(category, "placements").withColumn("position", F.array(*[f"place_{c}" for c in "xyz"]))
        placed = placed.select(F.col("mesh_id").alias("object_id"), F.col("mesh_id").alias("source"), "position", F.col("angle").alias("rotation_degrees"), *known, F.lit(mode).alias("mode"), *sizes)
        logs.write_log(placed, f"{self.dir}/{category}", category, mode)
        m = own.get("mannequin", {})
        if m.get("enabled", False):
            angles = self.read(category, "placements").select("mesh_id", "angle")
            self._mannequins(category, "mannequin", m, self.read(category, "vertices"), angles, {})

    def _mannequins(self, category: str, name: str, m: dict, v: DataFrame, angles: DataFrame, adjusted: dict) -> None:
        """Mannequins on a category's meshes by its settings, and an editor's adjustments of them."""
        tv, tf = stl.indexed(stl.read_stl(self.spark, f"{self.templates()}/{m['stl_file']}"))
        for axis, degrees in zip(((1, 0, 0), (0, 1, 0), (0, 0, 1)), m.get("pre_rotation", (0, 0, 0))):
            if abs(degrees) > 1e-6:
                tv = projection.transform(tv, projection.rotation_matrix(axis, degrees))
        chairs = objects.bounds(v, "mesh_id").join(angles, "mesh_id")
        adjusted = {k: m[k] for k in ("occupancy_pct", "occupancy_seed") if k in m} | adjusted
        people = self.write(editor.regenerated_mannequins(tv, chairs, m, adjusted), category, f"{name}_vertices")
        self.write(people.select("mesh_id").distinct().crossJoin(tf.drop("mesh_id")), category, f"{name}_faces")

    def templates(self) -> str:
        return f"{self.config.root}/{self.config.tree.get('paths', {}).get('stl_templates', 'stl_templates')}"

    def _procedural(self, category, own, points, found):
        generator = own.get("generator")
        if generator is None and category not in PROCEDURAL:
            raise NotImplementedError(f"no generator for {category}")
        placed = objects.status(found, own.get("min_points", 50), own.get("min_footprint", 0.0)).filter("status = 'placed'")
        floor = objects.floor_height(placed)
        dims = objects.orientation(points.join(placed.select("source"), "source", "left_semi"), "source")
        scale = own.get("scale_adjustment", 1.0)
        dims = dims.select(F.col("source").alias("mesh_id"), "angle", (F.col("width") * scale).alias("width"), (F.col("depth") * scale).alias("depth"), F.lit(float(own.get("table_height", 0.75))).alias("height"))
        v, f = meshes.boxes(PROCEDURAL[category](dims) if generator is None else generators.generated(dims, generator, "width", "depth", "height"))
        where = placed.crossJoin(F.broadcast(floor)).select(F.col("source").alias("mesh_id"), "point_count", "footprint", objects.centre("x").alias("place_x"), objects.centre("y").alias("place_y"), (F.col("floor_z") + own.get("z_offset", 0.0)).alias("place_z")).join(dims.select("mesh_id", "angle"), "mesh_id")
        return meshes.stand(v, where), f, where.join(dims.drop("angle"), "mesh_id")

    def _template(self, own, points, found):
        tv, tf = stl.indexed(stl.read_stl(self.spark, f"{self.templates()}/{own['stl_file']}"))
        placed = objects.enough_points(found, own.get("min_points", 50))
        mid = meshes.centroid(tv, tf)
        fit = objects.template_fit(mid, objects.reference_size(placed), own.get("scale_adjustment", 1.0)).first()
        ref = fit["scaled_footprint"] if own.get("use_stl_footprint", True) and fit["scaled_footprint"] > 0 else own["single_footprint"]
        kinds = objects.classify(placed, ref, own.get("min_footprint_ratio", 0.5), own.get("max_footprint_ratio", 1.5), own.get("skip_undersized", False))
        where = objects.placements(objects.heights(kinds, own.get("z_mode", "global_median"), own.get("z_offset", 0.0), fit["lift"] * fit["scale"]), ref)
        rests = objects.cell_points(points, where, "source")
        where = where.drop("point_count").join(rests.groupBy("placement").agg(F.count(F.lit(1)).alias("point_count")), "placement")
        base = float(own.get("rotation_degrees", 0.0))
        if own.get("use_icp", False):
            turns = icp.best_orientation(rests, tv, tf, "placement", own.get("icp_threshold", 0.02), own.get("icp_iterations", 50), base, fit["scale"])
            where = where.join(turns, "placement", "left").withColumn("angle", F.coalesce(icp.accepted_angle(F.col("fitness"), F.col("angle"), base, own.get("icp_fitness_threshold", 0.3)), F.lit(base)))
        else:
            where = where.withColumn("angle", F.lit(base)).withColumn("fitness", F.lit(0.0))
        where = where.withColumn("mesh_id", F.col("placement")).withColumn("scale", F.lit(fit["scale"])).withColumn("object_id", F.xxhash64("placement"))
        centred = tv.crossJoin(F.broadcast(mid.select(*[F.col(f"centroid_{c}") for c in "xyz"]))).select("vid", *[(F.col(c) - F.col(f"centroid_{c}")).alias(c) for c in "xyz"])
        v = meshes.place(centred, where)
        boxes = objects.bounds(v, "mesh_id").drop("point_count", "footprint").join(where.select("mesh_id", "object_id", "point_count", "footprint"), "mesh_id")
        kept = objects.suppress(boxes, own.get("merge_overlap_ratio", 0.0)).filter("accepted").select("object_id")
        where = where.join(kept, "object_id", "left_semi")
        ids = where.select("mesh_id")
        return v.join(ids, "mesh_id", "left_semi"), ids.crossJoin(tf.drop("mesh_id")), where

    # -- steps of the scene --

    def export(self, name: str, v: DataFrame, f: DataFrame) -> None:
        """A scene's STL, read again: a file that doesn't hold every face within the meshes' bounds ends the run (K17, K18). Its
        numbers are single."""
        path = self.path("scene", f"{name}.stl")
        stl.write_scene_stl(meshes.corners(v, f), path)
        got = stl.scene_stl_check(self.spark, path).first()
        box = v.agg(*[e(c).alias(f"{n}_{c}") for n, e in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first().asDict()
        far = [n for n, x in box.items() if x is not None and abs(got[n] - x) > 1e-6 * max(1.0, abs(x))]
        if far or got.faces != f.count():
            raise ValueError(f"{path} holds {got.faces} faces; bounds that differ: {far}")

    def combine(self) -> None:
        """All categories' furniture, and with mannequins, as one table each (K17, U01), with checks."""
        for extra, name in (("", "furniture"), ("mannequin_", "mannequins")):
            have = [c for c in self.config.enabled() if exists(self.spark, self.path(c, f"{extra}vertices"))]
            if not have:
                continue
            tag = lambda df, c: df.withColumn("mesh_id", F.concat(F.lit(f"{c}/"), "mesh_id"))
            v, f = meshes.concatenate([(tag(self.read(c, f"{extra}vertices"), c), tag(self.read(c, f"{extra}faces"), c)) for c in have])
            self.write(v, "scene", f"{name}_vertices")
            self.write(f, "scene", f"{name}_faces")
        both = [self.scene_mesh(n) for n in ("furniture", "mannequins") if exists(self.spark, self.path("scene", f"{n}_vertices"))]
        self.export("furniture", *both[0])
        if len(both) > 1:
            both[1] = tuple(df.withColumn("mesh_id", F.concat("mesh_id", F.lit("/mannequin"))) for df in both[1])
            self.export("furniture_with_mannequins", *meshes.concatenate(both))
        quality = meshes.quality(self.read("scene", "furniture_vertices"), self.read("scene", "furniture_faces"))
        self.write(quality, "scene", "watertight_log")

    def edit(self) -> None:
        """Furniture and mannequins after what an editor saved in the run's folder (E02, step 4b); combined anew from the tables of
        placement, so edits never add up. Categories without an edited log stay as they are."""
        tag = lambda df, before, after="": df.withColumn("mesh_id", F.concat(F.lit(before), "mesh_id", F.lit(after)))
        furniture, people, adjusted = [], [], logs.load_adjustments(self.spark, self.dir)
        for c in self.config.enabled():
            if not exists(self.spark, self.path(c, "vertices")):
                continue
            v, f = self.read(c, "vertices"), self.read(c, "faces")
            was, now = (logs.read_log(self.spark, f"{self.dir}/{c}", (n,)) for n in ("scene_log.json", "scene_log_edited.json"))
            if now is not None:
                v, f = (self.write(df, c, f"edited_{n}") for df, n in zip(edits.rebuild_placed(v, f, now, was), ("vertices", "faces")))
                stl.write_stl(meshes.corners(v, f), self.path(c, "individual_edited"))
            furniture.append((tag(v, f"{c}/"), tag(f, f"{c}/")))
            m = self.config.category(c).get("placement", {}).get("mannequin", {})
            if m.get("enabled", False):
                angles = (was if now is None else now).select(F.col("source").alias("mesh_id"), F.coalesce("rotation_degrees", F.lit(0.0)).alias("angle"))
                self._mannequins(c, "edited_mannequin", m, v, angles, adjusted)
                people.append(tuple(tag(self.read(c, f"edited_mannequin_{n}"), f"{c}/", "/mannequin") for n in ("vertices", "faces")))
        furniture += self._added()
        if not furniture:
            return
        own = [df.select("mesh_id", *names) for df, names in zip(meshes.concatenate(furniture), (("vid", "x", "y", "z"), ("fid", "a", "b", "c")))]
        both = self.write(own[0], "scene", "furniture_edited_vertices"), self.write(own[1], "scene", "furniture_edited_faces")
        self.export("furniture_edited", *both)
        if people:
            self.export("furniture_edited_with_mannequins", *meshes.concatenate([both, *people]))

    def _added(self) -> list[tuple[DataFrame, DataFrame]]:
        """Meshes of objects and tables that an editor added and didn't delete."""
        kept = lambda name: [(n, o) for n, o in enumerate(self._saved(name), 1) if not o.get("deleted", False)]
        out = []
        for n, o in kept("added_objects"):
            own, name = o.get("individual_stl_path"), f"added_{n:03d}_{editor.object_name(o)}"
            v, f = stl.indexed(stl.read_stl(self.spark, f"{self.dir}/{own}" if own else f"{self.templates()}/{o['template_file']}"))
            v = editor.added_object(v, tuple(o.get("position", (0.0, 0.0, 0.0))), o.get("scale", 1.0), o.get("rotation_degrees", 0.0))
            out.append(tuple(df.withColumn("mesh_id", F.lit(name)) for df in (v, f)))
        if tables := kept("added_procedural_objects"):
            numbers = lambda o: [*(edits.TABLE | o.get("dimensions", {})).values(), o.get("rotation_degrees", 0.0), *o.get("position", (0.0, 0.0, 0.0))]
            columns = [*edits.TABLE, "angle", "place_x", "place_y", "place_z"]
            rows = self.spark.createDataFrame([(f"added_procedural_{n:03d}_table", *map(float, numbers(o))) for n, o in tables], "mesh_id string, " + ", ".join(f"{c} double" for c in columns))
            v, f = meshes.boxes(meshes.table_parts(rows, *map(F.col, edits.DIMENSIONS[3:])))
            out.append((meshes.stand(v, rows.select("mesh_id", *columns[-4:])), f))
        return out

    def _saved(self, name: str) -> list[dict]:
        path = f"{self.dir}/{name}.json"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else []

    def scene_mesh(self, name: str) -> tuple[DataFrame, DataFrame]:
        return self.read("scene", f"{name}_vertices"), self.read("scene", f"{name}_faces")

    def enclose(self) -> None:
        v = self.read("scene", "furniture_vertices")
        at = None
        for c in self.config.enabled():
            if exists(self.spark, self.path(c, "placements")):
                p = self.read(c, "placements").select(F.col("place_x").alias("x"), F.col("place_y").alias("y"), F.col("place_z").alias("z"))
                at = p if at is None else at.unionByName(p)
        mesh = rooms.build_room(v, self.config.room(), at)
        self.write(mesh[0], "scene", "room_vertices")
        self.write(mesh[1], "scene", "room_faces")
        mesh = self.read("scene", "room_vertices"), self.read("scene", "room_faces")
        self.write(rooms.room_log(v, mesh, meshes.quality(*mesh)), "scene", "room_log")
        turned = rooms.aligned(v, self.config.room().rotation_deg)
        turned = self.write(turned, "scene", "aligned_vertices")
        furniture = self.scene_mesh("furniture")
        self.export("room", *mesh)
        self.export("furniture_and_room", *meshes.concatenate([furniture, tuple(df.select(own.columns) for df, own in zip(mesh, furniture))]))
        stl.write_stl(meshes.corners(turned, furniture[1]), self.path("scene", "aligned_individual"))

    def run(self, steps: Iterable[str] = ("all",), categories: Iterable[str] | None = None) -> None:
        each, scene = planned(list(steps))
        do = {"2": self.extract, "2b": self.filter, "3": self.heal, "4": self.place}
        for category in categories or self.config.enabled():
            for step in each:
                do[step](category)
        for step in scene:
            {"combine": self.combine, "4b": self.edit, "5": self.enclose}[step]()
