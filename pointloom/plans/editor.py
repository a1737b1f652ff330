"""What an editor of a placed scene asks for, as functions (there is no server)."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import edits, meshes, rooms
from pointloom.operators.util import dealt
from pointloom.sources import logs, stl
from pointloom.sources.files import _fs, exists, names, read_text

#: Files and folders that edits leave in a run's scene folder, and in each category's.
SCENE_ARTEFACTS = ("mannequin_adjustments.json", "room_config.json", "added_objects.json", "added_procedural_objects.json", "furniture_edited", "mannequins_edited")
CATEGORY_ARTEFACTS = ("scene_log_edited.json", "individual_edited")


def previous_edits(spark: SparkSession, folder: str, categories: list[str]) -> list[str]:
    """Paths of what earlier edits left."""
    paths = [f"{folder}/{n}" for n in SCENE_ARTEFACTS] + [f"{folder}/{c}/{n}" for c in categories for n in CATEGORY_ARTEFACTS]
    return [p for p in paths if exists(spark, p)]


def clean_previous_edits(spark: SparkSession, folder: str, categories: list[str], confirmed: bool = False) -> list[str]:
    """Deletes them, only if told so in so many words."""
    found = previous_edits(spark, folder, categories)
    if not confirmed:
        raise PermissionError(f"would delete {len(found)} paths; say confirmed=True")
    for path in found:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return found


def scene_log(spark: SparkSession, folder: str, category: str) -> DataFrame | None:
    """Placements of a category, edited ones if there are."""
    return logs.read_log(spark, f"{folder}/{category}")


def settings(spark: SparkSession, folder: str, name: str, configured: dict | None = None) -> dict:
    """Saved settings (mannequin_adjustments or room_config) over the configured ones."""
    path = f"{folder}/{name}.json"
    return (configured or {}) | (json.loads(read_text(spark, path)) if exists(spark, path) else {})


def templates(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in names(spark, folder) if n.lower().endswith(".stl")]


def template(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Sizes and counts of a template; only names that the folder lists are opened."""
    if name not in templates(spark, folder):
        raise FileNotFoundError(name)
    return stl.template_info(*stl.indexed(stl.read_stl(spark, f"{folder}/{name}")))


def table_stl(spark: SparkSession, dimensions: dict[str, float]) -> bytes:
    """A procedural table as binary STL."""
    d = edits.TABLE | dimensions
    one = spark.createDataFrame([("table", float(d["width"]), float(d["depth"]), float(d["height"]))], "mesh_id string, width double, depth double, height double")
    v, f = meshes.boxes(meshes.table_parts(one, d["tabletop_thickness"], d["leg_width"], d["leg_inset"]))
    return stl.stl_bytes(meshes.corners(v, f))  # at most 60 faces


def floor_tilt(positions: DataFrame, room: rooms.Room) -> float:
    """Slope of the floor under placements (E08): turned about the mean of positions, from behind stage and flat floor on; of all
    of them where fewer than two are there."""
    if not positions.limit(1).count():
        return 0.0
    turned = rooms.aligned(positions, room.rotation_deg)
    y0 = turned.agg(F.min("y")).first()[0] - room.padding + room.stage_depth + room.flat_depth
    if turned.filter(F.col("y") >= y0).limit(2).count() < 2:
        return rooms.slope(turned)
    return rooms.slope(turned, y0)


def added_object(vertices: DataFrame, position: tuple[float, float, float], scale: float = 1.0, rotation_degrees: float = 0.0) -> DataFrame:
    """A library object where the editor has put it (P15): about the middle of its box, scaled, turned, moved."""
    box = F.broadcast(vertices.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"mid_{c}") for c in "xyz"]))
    r = math.radians(rotation_degrees)
    x, y, z = ((F.col(c) - F.col(f"mid_{c}")) * scale for c in "xyz")
    moved = vertices.crossJoin(box)
    return moved.select("mesh_id", "vid", (x * math.cos(r) - y * math.sin(r) + position[0]).alias("x"), (x * math.sin(r) + y * math.cos(r) + position[1]).alias("y"), (z + position[2]).alias("z"))


def added_objects(vertices: DataFrame, added: DataFrame) -> DataFrame:
    """Library objects wherever an editor has put them (P15): a mesh for each row of added (name; mesh_id, the library's; x, y, z;
    scale; rotation_degrees), about the middle of its own box. Rows of no library object drop out."""
    box = vertices.groupBy("mesh_id").agg(*[((F.min(c) + F.max(c)) / 2).alias(f"mid_{c}") for c in "xyz"])
    where = added.join(dealt(box), "mesh_id").select("mesh_id", "name", *[F.col(c).alias(f"to_{c}") for c in "xyz"], *[f"mid_{c}" for c in "xyz"], "scale", F.radians("rotation_degrees").alias("r"))
    rows = vertices.join(dealt(where), "mesh_id")
    x, y, z = ((F.col(c) - F.col(f"mid_{c}")) * F.col("scale") for c in "xyz")
    turned = {"x": x * F.cos("r") - y * F.sin("r"), "y": x * F.sin("r") + y * F.cos("r"), "z": z}
    return rows.select(F.col("name").alias("mesh_id"), "vid", *[(e + F.col(f"to_{c}")).alias(c) for c, e in turned.items()])


def manifest(spark: SparkSession, folder: str, categories: list[str]) -> dict:
    """What a run's folder offers an editor (S17, E06): of each category with a log and meshes, in the given order, the names of its
    mesh files, in order, those of its mannequins, and how many meshes there are. Reads names only."""
    meshes_in = lambda path: sorted(n for n in names(spark, path) if n.lower().endswith(".stl")) if exists(spark, path) else []
    out = []
    for c in categories:
        found = meshes_in(f"{folder}/{c}/individual")
        if found and exists(spark, f"{folder}/{c}/scene_log.json"):
            out.append({"name": c, "objects": found, "mannequins": meshes_in(f"{folder}/{c}/mannequins"), "count": len(found)})
    return {"categories": out}


def object_name(added: dict) -> str:
    """The name of an added object, from its template or its own file."""
    path = added.get("template_file") or added.get("individual_stl_path") or "object"
    return path.rsplit("/", 1)[-1].removesuffix(".stl")


def regenerated_mannequins(template_vertices: DataFrame, chairs: DataFrame, configured: dict, adjusted: dict | None = None) -> DataFrame:
    """Mannequins from placements and settings alone, so edits never add up (E03, X07): scales multiply, offsets add, the editor's
    rotation turns the template first, occupancy picks chairs."""
    a = adjusted or {}
    t = template_vertices
    if a.get("rotation_z"):
        t = t.withColumns(meshes.turn(t, F.lit(math.radians(a["rotation_z"])), (F.lit(0.0), F.lit(0.0))))
    taken = edits.occupied_chairs(chairs, a.get("occupancy_pct", 100), a.get("occupancy_seed", 42))
    offset = tuple(c + a.get(f"offset_{n}", 0.0) for n, c in zip("xyz", configured.get("position_offset", (0.0, 0.0, 0.0))))
    return edits.mannequins(t, taken, configured.get("scale_factor", 1.0) * a.get("scale_factor", 1.0), offset)
