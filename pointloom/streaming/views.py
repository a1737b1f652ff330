"""View counts of a stream of mask hits: an extension, as frames may arrive while a scene is being filmed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_view_counts(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """n_views of each point so far, from a stream of frame_id, point_id and seen_at. A hit told again within the time that hits
    may be late counts once; state of hits older than that is dropped."""
    once = hits.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["frame_id", "point_id"])
    return once.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_views"))
