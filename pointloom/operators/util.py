"""Helpers of several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W
from pyspark.sql import functions as F

from pointloom.plans.scratch import materialize


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it is counted to have no more rows than that; otherwise left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle on both sides. The planner takes what explode makes for as small as the file it comes from,
    and would send millions of vertices through the driver to every executor."""
    return df.hint("merge")


def one_row(df: DataFrame, *aggs) -> DataFrame:
    """A global aggregate as a one-row frame that any plan may broadcast."""
    return F.broadcast(df.agg(*aggs))


def scalars(df: DataFrame, *aggs) -> Row:
    """A global aggregate brought to the driver: as many numbers as there are aggregates."""
    return df.agg(*aggs).first()


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column: each row's rank from 0 by order, which should tell all rows apart.

    In two levels: rows are dealt by ranges of the order and written with their rank in the range; where ranges begin is a
    running sum of one number each. No task sees more than its range."""
    own = f"{name}_in_range"
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()), f"numbered-{name}")
    part, nth = F.shiftright(own, 33), F.col(own).bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias(f"{name}_range")).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    before = F.sum(f"{name}_n").over(W.orderBy(f"{name}_range")) - F.col(f"{name}_n")
    starts = counts.select(f"{name}_range", before.alias(f"{name}_start"))  # one row a range: as many as shuffle partitions
    out = dealt.join(F.broadcast(starts), part == F.col(f"{name}_range"))
    out = out.select(*df.columns, (F.col(f"{name}_start") + nth).alias(name))
    out._scratch_path = dealt._scratch_path
    return out


def placed(df: DataFrame, file: Column, order: list[str]) -> DataFrame:
    """df with file, place (rank from 0 within the file) and total (the file's rows), for records.write; a table."""
    rows = materialize(df.withColumn("file", file), "records")  # dealing by ranges reads its rows twice
    ranked = numbered(rows, "nth", "file", *order)
    files = materialize(ranked.groupBy("file").agg(F.min("nth").alias("from_nth"), F.count(F.lit(1)).alias("total")), "files")
    few = files.limit(100_001).count() <= 100_000  # one file's rows aren't all dealt to one task
    if few:  # ranks were given in ranges of this very order, and the table of them is read range by range
        out = ranked.join(F.broadcast(files), "file").withColumn("place", F.col("nth") - F.col("from_nth")).drop("nth", "from_nth")
        out._scratch_path = ranked._scratch_path
        return out
    out = ranked.join(dealt(files), "file").withColumn("place", F.col("nth") - F.col("from_nth")).drop("nth", "from_nth")
    return materialize(out.repartitionByRange("file", "place").sortWithinPartitions("file", "place"), "placed")
