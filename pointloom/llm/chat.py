"""Chat formatting: cumulative snapshots of conversations collapsed, then rendered.

Logs often hold a conversation once for each of its states. Turns get rolling prefix hashes: the exclusive or, over the
turns so far, of hashes of place, role and text, in two independent 64-bit versions. A conversation is a snapshot where its
last hash is a prefix hash of a longer one; anti-joins on distinct hashes leave maximal conversations, one of equal ones.
DataFrame operations only; hashes are made distinct before they are dealt, so common conversations or openings cost no
task more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, i (1, 2, ... in order), role, text, h1 and h2 (of turns 1 to i), last (whether it is the conversation's last)."""
    t = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("i", F.row_number().over(order))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    for h in (1, 2):
        one = F.xxhash64(F.lit(h), "i", F.col("role").isNull(), "role", F.lit(h), F.col("text").isNull(), "text")
        t = t.withColumn(f"h{h}", F.bit_xor(one).over(upto))
    return t.withColumn("last", F.lead("i").over(order).isNull()).drop("turn")


def collapse(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, i, role, text) of the conversations that no longer one begins with, and n_copies: how many equal ones
    there were, of which that of the smallest conv_id (null only where it is alone) stays.

    Turns are in order of turn, then role, then text, nulls first; repeated rows count once; a null conv_id is an id like
    any other, null roles and texts equal only nulls; very long texts are hashed and kept whole, empty ones are turns like any
    other. No rows: no rows. Other columns don't matter.
    """
    t = materialize(prefixes(turns), "chat-prefixes")
    key = ["i", "h1", "h2"]
    whole = t.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = t.filter("NOT last").select(*key).distinct()
    kept = whole.join(longer, key, "left_anti").select(F.col("conv_id").alias("kept"), "n_copies")
    return t.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "i", "role", "text", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each conversation: every turn as its role's marker, its text and an end marker.

    Null roles are written as unknown, null texts as empty."""
    turn = F.struct("i", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")).alias("said"))
    both = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"), F.first("n_copies").alias("n_copies"))
    return both.select("conv_id", F.size("all").cast("long").alias("n_turns"), "n_copies", F.concat_ws("", "all.said").alias("text"))
