"""Rooms around a scene: bounds, boxes, auditoriums with stage and inclined floor, vents in the ceiling."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meshes import boxes, turn
from .util import scalars


@dataclass(frozen=True)
class Room:
    """What a configuration says of a room."""

    padding: float = 0.1
    height: float | None = None
    headroom: float = 0.5
    rotation_deg: float = 0.0
    size: tuple[float, ...] | None = None
    floor_type: str = "flat"
    stage_depth: float = 0.2
    stage_height: float = 0.05
    flat_depth: float = 0.3
    floor_tilt_deg: float | None = None
    vents: tuple[dict, ...] = ()
    close_stage_gap: bool = False


def pivot(vertices: DataFrame) -> tuple[float, float]:
    return tuple(scalars(vertices, F.avg("x"), F.avg("y")))


def aligned(vertices: DataFrame, rotation_deg: float, about: tuple[float, float] | None = None) -> DataFrame:
    """Vertices turned into the room's frame about their mean."""
    if abs(rotation_deg) <= 1e-6:
        return vertices
    at = about or pivot(vertices)
    return vertices.withColumns(turn(vertices, F.lit(math.radians(-rotation_deg)), (F.lit(at[0]), F.lit(at[1]))))


def room_bounds(vertices: DataFrame, room: Room) -> DataFrame:
    """One row of lo_* and hi_* in the room's frame (A19): padded sides, the floor at the lowest vertex, a given height or
    headroom, and a given size about the same middle."""
    a = aligned(vertices, room.rotation_deg).agg(*[F.min(c).alias(f"a{c}") for c in "xyz"], *[F.max(c).alias(f"b{c}") for c in "xyz"])
    lo = {c: F.col(f"a{c}") - room.padding for c in "xy"} | {"z": F.col("az")}
    hi = {c: F.col(f"b{c}") + room.padding for c in "xy"} | {"z": F.col("az") + room.height if room.height is not None else F.col("bz") + room.headroom}
    if room.size:
        for c, s in zip("xy", room.size):
            mid = (lo[c] + hi[c]) / 2
            lo[c], hi[c] = mid - s / 2, mid + s / 2
        if len(room.size) > 2:
            hi["z"] = lo["z"] + room.size[2]
    return a.select(*[lo[c].alias(f"lo_{c}") for c in "xyz"], *[hi[c].alias(f"hi_{c}") for c in "xyz"])


def slope(positions: DataFrame, y_min: float | None = None) -> float:
    """Least-squares slope of z on y, of positions from y_min on; 0 for fewer than two or without spread."""
    some = positions if y_min is None else positions.filter(F.col("y") >= y_min)
    n, yy, yz = scalars(some, F.count(F.lit(1)), F.var_pop("y"), F.covar_pop("y", "z"))
    return 0.0 if n < 2 or n * n * (yy or 0.0) < 1e-12 else yz / yy


def clearance(vertices: DataFrame, tilt: float, y_from: float) -> float | None:
    """The highest base of a floor inclined from y_from on that no vertex there lies below."""
    return scalars(vertices.filter(F.col("y") >= y_from), F.min(F.col("z") - tilt * (F.col("y") - y_from)))[0]


def auditorium_section(bounds, tilt: float, room: Room, lowest=lambda y_from: None) -> list[tuple[float, float]]:
    """The cross-section (y, z) of an auditorium, anticlockwise from the front of its floor: front and edge of the stage, its foot,
    end of the flat floor, back of the floor, back and front of the ceiling. lowest(y): the base that clears all vertices from
    y on; the floor goes down to it, the stage's top doesn't. The ceiling rises where the floor would reach it."""
    front, back, base, top = (bounds[k] for k in ("lo_y", "hi_y", "lo_z", "hi_z"))
    stage = base + room.stage_height
    foot, bend = (min(front + d, back) for d in (room.stage_depth, room.stage_depth + room.flat_depth))
    length = back - bend
    if length <= 1e-6:
        rise = 0.0
    else:
        rise, safe = tilt * length, lowest(bend)
        base = base if safe is None else min(base, safe)
    if base + rise >= top:
        top += base + rise - bounds["lo_z"]
    return [(front, stage), (foot, stage), (foot, base), (bend, base), (back, base + rise), (back, top), (front, top)]


def triangles(polygon: list[tuple[float, float]], corners: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of a simple anticlockwise polygon, whose corners are places in ``polygon``, by cutting ears; flat ones come last."""
    left, out = list(corners), []
    at = polygon.__getitem__

    def area(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = at(a), at(b), at(c)
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def empty(t: tuple[int, int, int]) -> bool:
        held = [k for k in left if at(k) not in map(at, t)]
        return not any(area(t[0], t[1], k) >= 0 and area(t[1], t[2], k) >= 0 and area(t[2], t[0], k) >= 0 for k in held)

    while len(left) > 2:
        ears = [(left[n - 1], left[n], left[(n + 1) % len(left)]) for n in range(len(left))]
        ear = next((t for t in ears if area(*t) > 1e-12 and empty(t)), None) or min(ears, key=lambda t: abs(area(*t)))
        out.append(ear)
        left.remove(ear[1])
    return out


def auditorium_mesh(section: list[tuple[float, float]], lo_x: float, hi_x: float, close_stage_gap: bool = False) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """14 vertices and the inward faces of an auditorium (X05): its section drawn from lo_x to hi_x. Vertex 2n is the section's point
    n on the left, 2n + 1 on the right. Steps without height or depth have no faces.

    Without stage height there is no floor where the stage would be, unless close_stage_gap, and then the walls meet it."""
    stage, flat = section[0][1] - section[2][1] > 1e-6, section[3][0] - section[2][0] > 1e-6
    gap = close_stage_gap and not stage and section[2][0] - section[0][0] > 1e-6
    line = section if stage else [(section[0][0], section[2][1]), section[2], *section[2:]]
    vertices = [(x, y, z) for y, z in line for x in (lo_x, hi_x)]
    outline = [n for n, there in enumerate((True, stage, stage, flat or gap, True, True, True)) if there]
    drawn = [(3, 4), (4, 5), (5, 6), (6, 0)]  # slope, back, ceiling, front
    drawn += [(0, 1), (1, 2)] if stage else []
    drawn += [(0, 3)] if gap else [(2, 3)] if flat else []
    ends = triangles(line, outline)
    faces = [(2 * a, 2 * b, 2 * c) for a, b, c in ends] + [(2 * c + 1, 2 * b + 1, 2 * a + 1) for a, b, c in ends]
    for a, b in drawn:
        faces += [(2 * a, 2 * a + 1, 2 * b + 1), (2 * a, 2 * b + 1, 2 * b)]
    return vertices, faces


def _frames(spark: SparkSession, vertices, faces) -> tuple[DataFrame, DataFrame]:
    v = spark.createDataFrame([("room", n, *map(float, x)) for n, x in enumerate(vertices)], "mesh_id string, vid int, x double, y double, z double")
    return v, spark.createDataFrame([("room", n, *f) for n, f in enumerate(faces)], "mesh_id string, fid int, a int, b int, c int")


def vent_boxes(bounds, vents: tuple[dict, ...]) -> list[tuple[float, float, float, float]]:
    """lo_x, lo_y, hi_x, hi_y of each vent; without a position at a quarter (inlets) or three quarters of the length."""
    out = []
    for v in vents:
        share = 0.25 if v.get("type") == "inlet" else 0.75
        x, y = v.get("position") or (bounds["lo_x"] + (bounds["hi_x"] - bounds["lo_x"]) * share, (bounds["lo_y"] + bounds["hi_y"]) / 2)
        w, d = v["size"]
        out.append((x - w / 2, y - d / 2, x + w / 2, y + d / 2))
    return out


def vented_ceiling(bounds, holes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """The ceiling's rectangles that vents leave, by a grid through their sides."""
    b = bounds
    for x0, y0, x1, y1 in holes:
        if not (b["lo_x"] < x0 < x1 < b["hi_x"] and b["lo_y"] < y0 < y1 < b["hi_y"]):
            raise ValueError("a vent must lie inside the ceiling")
    xs = sorted({b["lo_x"], b["hi_x"], *(v for h in holes for v in (h[0], h[2]))})
    ys = sorted({b["lo_y"], b["hi_y"], *(v for h in holes for v in (h[1], h[3]))})
    inside = lambda x, y: any(h[0] < x < h[2] and h[1] < y < h[3] for h in holes)
    return [(x0, y0, x1, y1) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]) if not inside((x0 + x1) / 2, (y0 + y1) / 2)]


def build_room(vertices: DataFrame, room: Room, positions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and inward faces of the room of a scene (X06). Auditoriums have no vents; positions (x, y, z) of placements tell
    their floor's tilt unless the configuration does. The mesh comes back in the scene's frame."""
    spark = vertices.sparkSession
    b = room_bounds(vertices, room).first()
    if b["lo_x"] is None:
        raise ValueError("a room needs a scene with vertices")
    at = pivot(vertices)
    if room.floor_type == "auditorium":
        turned = aligned(vertices, room.rotation_deg, at)
        y_flat = min(b["lo_y"] + room.stage_depth + room.flat_depth, b["hi_y"])
        if room.floor_tilt_deg is not None:
            tilt = math.tan(math.radians(room.floor_tilt_deg))
        else:
            tilt = slope(aligned(positions, room.rotation_deg, at), y_flat) if positions is not None else 0.0
        section = auditorium_section(b, tilt, room, lambda y: clearance(turned, tilt, y))
        mesh = _frames(spark, *auditorium_mesh(section, b["lo_x"], b["hi_x"], room.close_stage_gap))
    elif room.vents:
        rectangles = vented_ceiling(b, vent_boxes(b, room.vents))
        base = [(b[f"{'hi' if n & 4 else 'lo'}_x"], b[f"{'hi' if n & 2 else 'lo'}_y"], b[f"{'hi' if n & 1 else 'lo'}_z"]) for n in range(8)]
        from .meshes import BOX_FACES

        found: dict[tuple, int] = {v: n for n, v in enumerate(base)}
        faces = [(a, c, d) for a, d, c in BOX_FACES[:10]]
        for x0, y0, x1, y1 in rectangles:
            q = [found.setdefault((x, y, b["hi_z"]), len(found)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
            faces += [(q[0], q[2], q[1]), (q[0], q[3], q[2])]
        mesh = _frames(spark, list(found), faces)
    else:
        mesh = boxes(room_bounds(vertices, room).withColumn("mesh_id", F.lit("room")), inward=True)
    return aligned(mesh[0], -room.rotation_deg, at), mesh[1]


def room_log(scene: DataFrame, mesh: tuple[DataFrame, DataFrame], checked: DataFrame) -> DataFrame:
    """One row: sizes and bounds of scene and room to 4 decimals, counts, checks."""
    box = lambda v, n: v.agg(*[F.round(F.min(c), 4).alias(f"{n}_min_{c}") for c in "xyz"], *[F.round(F.max(c), 4).alias(f"{n}_max_{c}") for c in "xyz"], *[F.round(F.max(c) - F.min(c), 4).alias(f"{n}_size_{c}") for c in "xyz"], F.count(F.lit(1)).alias(f"{n}_vertices"))
    one = checked.agg(F.sum("faces").alias("faces"), F.bool_and("is_watertight").alias("watertight"), F.sum("boundary_edges").alias("boundary_edges"))
    return box(scene, "scene").crossJoin(F.broadcast(box(mesh[0], "room"))).crossJoin(F.broadcast(one))
