"""Which points masks select: z-buffers, mask membership, consensus over frames, depth bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize

from .util import one_row

#: Thresholds of the cumulative view histogram.
VIEW_STEPS = (1, 2, 3, 5, 10, 20)


def depth_buffer(projected: DataFrame) -> DataFrame:
    """Smallest depth of each pixel of each frame."""
    return projected.groupBy("frame_id", "u", "v").agg(F.min("z").alias("min_z"))


def unoccluded(projected: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Points no deeper than their pixel's nearest plus a tolerance.

    Nearest depths are an aggregate that combines before it is shuffled, one row a pixel however many points it has, and a
    hash table of them is what a task holds; points pass by unsorted."""
    pixel = ["frame_id", *keys, "u", "v"]
    nearest = projected.groupBy(*pixel).agg(F.min("z").alias("nearest")).hint("shuffle_hash")
    return projected.join(nearest, pixel).filter(F.col("z") <= F.col("nearest") + F.lit(tolerance)).select(*projected.columns)


def loose_tolerance(z_threshold: float) -> float:
    return max(10 * z_threshold, 0.5)


def mask_words(runs: DataFrame, *keys: str) -> DataFrame:
    """Masks as bits: for each frame, keys, pixel row and 64 columns (word) a number whose bits are the pixels of any run.

    Runs that overlap become one set; a row has a bounded number of words however many masks there are. Written as a table, so
    that its bytes tell the planner whether it may be sent to all tasks."""
    own = runs.filter("u_start <= u_end AND u_end >= 0").select("frame_id", *keys, "v", F.greatest("u_start", F.lit(0)).alias("first"), F.col("u_end").alias("last"))
    # One task may have read all runs: masks, of which few rows agree, are dealt before they are aggregated.
    own = own.repartition("frame_id", *keys, "v") if keys else own
    words = own.withColumn("word", F.explode(F.sequence(F.expr("first div 64"), F.expr("last div 64"))))
    lo, hi = F.greatest(F.col("first") - 64 * F.col("word"), F.lit(0)).cast("int"), F.least(F.col("last") - 64 * F.col("word"), F.lit(63)).cast("int")
    every = F.lit(-1).cast("long")
    bits = F.call_function("shiftleft", every, lo).bitwiseAND(F.call_function("shiftrightunsigned", every, 63 - hi))
    return materialize(words.groupBy("frame_id", *keys, "v", "word").agg(F.bit_or(bits).alias("bits")), "mask-words")


def _on_words(projected: DataFrame, words: DataFrame, how: str = "inner") -> DataFrame:
    """projected, u from 0, joined with the words whose bit of their pixel is set."""
    own = words.withColumnsRenamed({"frame_id": "of_frame", "v": "row"})
    same = (F.col("frame_id") == F.col("of_frame")) & (F.col("v") == F.col("row")) & (F.expr("u div 64") == F.col("word"))
    bit = F.getbit("bits", F.pmod(F.col("u"), F.lit(64))) == 1
    return projected.join(own, same & bit, how).drop("of_frame", "row", "word", "bits")


def in_masks(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """Projected points with each mask (mask_id) they fall in; runs: frame_id, mask_id, v, u_start, u_end inclusive (J04, F04). A
    mask has one word at a pixel, so a point meets it once."""
    return _on_words(projected, mask_words(runs, "mask_id"))


def view_counts(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """n_views of each point: in how many frames it falls in any mask."""
    return covered(projected, runs).groupBy("point_id").agg(F.count(F.lit(1)).alias("n_views"))


def covered(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """Projected points whose pixel some mask of their frame covers. Masks cover whole pixels, so a pixel's z-buffer needs these
    points only: what no mask covers goes before anything is shuffled, where the words are few enough to be sent."""
    return _on_words(projected, mask_words(runs), "left_semi")


def seen_counts(projected: DataFrame, runs: DataFrame, z_threshold: float) -> DataFrame:
    """n_views of each point that the loose z-buffer leaves in any mask: view_counts() of unoccluded points, masks first."""
    return unoccluded(covered(projected, runs), loose_tolerance(z_threshold)).groupBy("point_id").agg(F.count(F.lit(1)).alias("n_views"))


def consensus(counts: DataFrame, min_views: int) -> DataFrame:
    return counts.filter(F.col("n_views") >= min_views)


def view_histogram(counts: DataFrame) -> DataFrame:
    """How many points have so many views at least, for the steps that any point reaches."""
    steps = F.explode(F.array(*[F.lit(t) for t in VIEW_STEPS])).alias("min_views")
    return counts.select("n_views", steps).filter("n_views >= min_views").groupBy("min_views").agg(F.count(F.lit(1)).alias("n_points"))


def view_colours(counts: DataFrame) -> DataFrame:
    """r, g, b of each point by its share of the most views: many red, few blue."""
    top = one_row(counts, F.max("n_views").alias("most"))
    share = F.col("n_views") / F.col("most")
    return counts.crossJoin(top).select("point_id", "n_views", share.alias("r"), F.lit(0.0).alias("g"), (1 - share).alias("b"))


def depths(projected: DataFrame) -> DataFrame:
    """frame_id, u, v, z and points: how many points have one depth at one pixel. Masks tell no more of them apart."""
    return projected.groupBy("frame_id", "u", "v", "z").agg(F.count(F.lit(1)).alias("points"))


PATCH = ["frame_id", "mask_id", "patch_u", "patch_v"]


def _patched(masked: DataFrame, patch: int) -> DataFrame:
    return masked.withColumn("patch_u", F.expr(f"u div {patch}")).withColumn("patch_v", F.expr(f"v div {patch}"))


def patches(masked: DataFrame, patch: int, floor: float = 0.005, weight: str | None = None) -> DataFrame:
    """n, med and mad of each mask's patches: rows, median depth and median deviation (A04). Exact. Equal depths of a patch are
    one row with their number before they are shuffled. weight: a column of how many rows a row stands for."""
    times = F.lit(1) if weight is None else F.col(weight)
    rows = _patched(masked, patch).groupBy(*PATCH, "z").agg(F.sum(times).alias("times"))
    part = W.partitionBy(*PATCH)
    rows = rows.withColumn("n", F.sum("times").over(part)).withColumn("med", F.percentile("z", F.lit(0.5), F.col("times")).over(part))
    rows = rows.withColumn("mad", F.greatest(F.percentile(F.abs(F.col("z") - F.col("med")), F.lit(0.5), F.col("times")).over(part), F.lit(floor)))
    return rows.groupBy(*PATCH).agg(*[F.first(c).alias(c) for c in ("n", "med", "mad")])


def patch_bands(masked: DataFrame, sigma: float, patch: int, at_least: int = 5, floor: float = 0.005, weight: str | None = None) -> DataFrame:
    """masked rows with lo and hi: median depth of their mask's patch, plus and minus sigma times the median deviation (P05, A04,
    A05, J05). Patches of fewer rows have no band. Rows meet their patch in a hash table, unsorted."""
    rows = _patched(masked, patch).join(patches(masked, patch, floor, weight).hint("shuffle_hash"), PATCH)
    band = lambda sign: F.when(F.col("n") >= at_least, F.col("med") + F.lit(sign * sigma) * F.col("mad"))
    return rows.withColumn("lo", band(-1.0)).withColumn("hi", band(1.0))


def refine(projected: DataFrame, runs: DataFrame, chosen: DataFrame, z_threshold: float = 0.05, sigma: float = 2.0, patch: int = 32, use_band: bool = True, use_zbuffer: bool = True) -> DataFrame:
    """point_id of the chosen points that the depth filters leave in any mask of any frame.

    The loose z-buffer is made of chosen points alone. Mask membership depends on the pixel, so a pixel's strict buffer needs
    no point beyond those of its mask that pass the band. Depths of pixels meet the masks, points only the depths that are left."""
    if not use_band and not use_zbuffer:
        return chosen.select("point_id")
    own = materialize(unoccluded(materialize(chosen_covered(projected, runs, chosen), "chosen"), loose_tolerance(z_threshold)), "loose")
    rows = in_masks(depths(own), runs)
    if use_band:
        rows = patch_bands(rows, sigma, patch, weight="points").filter("lo IS NULL OR z BETWEEN lo AND hi")
    if use_zbuffer:
        rows = unoccluded(materialize(rows.select("frame_id", "mask_id", "u", "v", "z"), "in-masks"), z_threshold, "mask_id")
    at = ["frame_id", "u", "v", "z"]
    return own.join(rows.select(*at).distinct(), at, "left_semi").select("point_id").distinct()


def chosen_covered(projected: DataFrame, runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """covered() points that were chosen."""
    return covered(projected, runs).join(chosen.select("point_id"), "point_id", "left_semi")


def extract(projected: DataFrame, runs: DataFrame, min_views: int, z_threshold: float = 0.05, **filters) -> DataFrame:
    """point_id of the object's points: consensus over frames, then depth filters (the two passes of extraction)."""
    chosen = consensus(seen_counts(projected, runs, z_threshold), min_views)
    return refine(projected, runs, chosen, z_threshold, **filters)
