"""Logs of placed scenes as JSON, original and edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, write_text

PLACEMENT = "struct<source:string, position:array<double>, rotation_degrees:double, icp_fitness:double, classification:string, point_count:bigint, footprint:double, mode:string, dimensions:map<string,double>>"
LOG = f"category string, mode string, stats map<string,double>, placements array<{PLACEMENT}>, deleted array<{PLACEMENT}>"


def read_log(spark: SparkSession, folder: str, names: tuple[str, ...] = ("scene_log_edited.json", "scene_log.json")) -> DataFrame | None:
    """Placements of a category's log, the edited one if there is one (S15); None where there is no log."""
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            log = spark.read.json(f"{folder}/{name}", schema=LOG, multiLine=True)
            return log.select("category", "mode", F.posexplode("placements").alias("nth", "p")).select("category", F.col("nth").cast("long").alias("object_id"), "p.*")
    return None


def log_rows(placements: DataFrame, category: str, mode: str) -> DataFrame:
    """One row, one column value: the log of placements (source, position, ...) as JSON (K10). A scene's placements fit one row."""
    cols = [c for c in ("source", "position", "rotation_degrees", "icp_fitness", "classification", "point_count", "footprint", "mode", "dimensions") if c in placements.columns]
    body = placements.agg(F.sort_array(F.collect_list(F.struct("object_id", *cols))).alias("rows"), F.count(F.lit(1)).alias("n"))
    stats = F.create_map(F.lit("placed"), F.col("n").cast("double"))
    return body.select(F.to_json(F.struct(F.lit(category).alias("category"), F.lit(mode).alias("mode"), stats.alias("stats"), F.transform("rows", lambda r: r.dropFields("object_id")).alias("placements"))).alias("value"))


def write_log(placements: DataFrame, folder: str, category: str, mode: str, name: str = "scene_log.json") -> None:
    write_text(placements.sparkSession, f"{folder}/{name}", log_rows(placements, category, mode).first()[0])


def save_edits(spark: SparkSession, payload: dict, folder: str) -> dict[str, tuple[int, int]]:
    """An editor's payload to files (E01, K15): settings for the whole scene each to its own, each category's placements to an edited
    log of kept and deleted ones without private keys. Gives the numbers kept and deleted."""
    import json

    whole = {"_mannequin_adjustments": "mannequin_adjustments.json", "_room_config": "room_config.json", "_added_objects": "added_objects.json", "_added_procedural_objects": "added_procedural_objects.json"}
    for key, name in whole.items():
        if payload.get(key) is not None:
            write_text(spark, f"{folder}/{name}", json.dumps(payload[key], indent=2))
    counts = {}
    for category, data in payload.items():
        if category in whole:
            continue
        sides: dict[bool, list] = {False: [], True: []}
        for p in data.get("placements", []):
            sides[bool(p.get("_deleted"))].append({k: v for k, v in p.items() if not k.startswith("_")})
        log = {"category": category, "mode": data.get("scene_log", {}).get("mode", "template"), "placements": sides[False], "deleted": sides[True]}
        write_text(spark, f"{folder}/{category}/scene_log_edited.json", json.dumps(log, indent=2))
        counts[category] = (len(sides[False]), len(sides[True]))
    return counts


def load_adjustments(spark: SparkSession, folder: str) -> dict:
    """Saved mannequin adjustments, none where there are none."""
    import json

    from .files import read_text

    path = f"{folder}/mannequin_adjustments.json"
    return json.loads(read_text(spark, path)) if exists(spark, path) else {}
