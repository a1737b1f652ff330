"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

A mix takes whole documents, each up to ``limit`` times. Documents of a source are dealt by a hash of doc_id and text into
blocks of about ``block_words`` words; each full copy of a source draws all its blocks, and what its target needs beyond full copies draws
blocks in a permuted order until the target is met (of the last block, documents in a permuted order). The draws of all
sources are then shared among output shards: a binary tree halves the number of draws at each node and splits every
source's exact quota between both halves as a multivariate-hypergeometric variate, so each shard's composition is that of
a random deal, while no step ever sorts all draws. Variates are exact at every size. Shards then take disjoint ranges of each source's permuted draws.

Nothing is sorted or collected beyond a group of blocks: ranks and running sums within a source are found in two levels.
What fits one row or task is one entry for each source, not for each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, shuffle_parts

#: Blocks of one rank group; a group is the most that a window sorts.
GROUP_BLOCKS = 4096


def _unit(*key) -> Column:
    """A uniform number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def sizes(docs: DataFrame, seed: int = 0, carry: bool = False) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and the document's place in permuted orders; its whole row if asked."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(*row, "doc_id", "source", F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.lit("doc"), "doc_id", "text").alias("draw"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """One row for each source: sid (rank by code point, null last), source, source_size, source_rows, weight, target.

    Targets share the words of all sources by weight; none exceeds ``limit`` times its source, and what that cuts off is
    shared again by weight among the others. Each round needs two sums, so nothing but two numbers reaches the driver.
    """
    grouped = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "mix-sources")
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    src = materialize(grouped.withColumn("sid", order.cast("long")).withColumn("weight", pick), "mix-ranked")
    cap = F.col("source_size") * limit
    total, weight = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level, fixed = (total or 0) / weight if weight else 0.0, 0
    while True:
        over = F.lit(level) * F.col("weight") > cap
        spent, left, n = src.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == fixed or not left:
            break
        fixed, level = n, (total - spent) / left
    return src.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _two_level(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """rank and words before each block in its permuted order within ``keys``, by sums over rank groups first."""
    within = W.partitionBy(*keys, "grp").orderBy("perm", "block")
    ranked = blocks.withColumn("rank", F.row_number().over(within) - 1).withColumn("before", F.sum("words").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    groups = blocks.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    above = W.partitionBy(*keys).orderBy("grp").rowsBetween(W.unboundedPreceding, 0)
    groups = groups.select(*keys, "grp", (F.sum("n").over(above) - F.col("n")).alias("n0"), (F.sum("w").over(above) - F.col("w")).alias("w0"))
    return ranked.join(groups, [*keys, "grp"]).withColumn("rank", F.col("rank") + F.col("n0")).withColumn("before", F.col("before") + F.col("w0")).drop("n0", "w0")


def _draws(blocks: DataFrame, seed: int) -> DataFrame:
    """One row for each block that a copy draws: sid, block, copy, spot (0, 1, ... within the source), rest, partial.

    ``rest`` is null where the whole block is drawn, else the words to take of it. ``partial``: drawn by the extra copy."""
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("base")))).filter("copy < base OR extra > 0")
    copies = copies.withColumn("perm", _unit(F.lit(seed), "sid", "block", "copy")).withColumn("grp", F.floor(F.col("perm") * F.ceil(F.col("n_blocks") / GROUP_BLOCKS)))
    placed = _two_level(copies, ["sid", "copy"]).filter("copy < base OR before < extra")
    rest = F.when((F.col("copy") == F.col("base")) & (F.col("before") + F.col("words") > F.col("extra")), F.col("extra") - F.col("before"))
    return placed.select("sid", "block", "copy", (F.col("copy") * F.col("n_blocks") + F.col("rank")).alias("spot"), rest.alias("rest"), (F.col("copy") == F.col("base")).alias("partial"))


def _split(rows: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Of rows in blocks of which only ``rest`` words are taken: the rows with nth, and of each block whether its nth row fits
    and the words left. Its longest documents come first by size, then the others in a permuted order."""
    nth = F.row_number().over(W.partitionBy("sid", "block").orderBy(F.when(F.col("size") * 64 > block_words, -F.col("size")).otherwise(0), "draw", "doc_id", "size"))
    rows = rows.withColumn("nth", nth)
    fold = "aggregate(sort_array(collect_list(struct(nth, size))), named_struct('left', max(rest), 'fits', cast(array() as array<boolean>)), (a, x) -> named_struct('left', if(x.size <= a.left, a.left - x.size, a.left), 'fits', concat(a.fits, array(x.size <= a.left))))"
    return rows, rows.groupBy("sid", "block").agg(F.expr(fold).alias("fold")).select("sid", "block", "fold.fits", "fold.left")


def _filled(draws: DataFrame, rows: DataFrame, seed: int, block_words: int) -> DataFrame:
    """draws, with most (null: any size), and more draws of the extra copy where its last block leaves words open: of blocks it
    hasn't drawn, the documents of at most ``most`` words, the words left then. Ends when no source has one that fits; the
    words left shrink in every round."""
    last = draws.withColumn("most", F.lit(None).cast("long"))
    every = last
    while True:
        open_blocks = rows.join(last.filter("rest IS NOT NULL").select("sid", "block", "rest"), ["sid", "block"])
        left = _split(open_blocks, block_words)[1].filter("left > 0").select("sid", F.col("left").alias("extra"))
        left = materialize(left.join(every.groupBy("sid").agg(F.count(F.lit(1)).alias("drawn")), "sid"), "mix-left")  # one row a source: small to the planner
        few = rows.withColumn("top", F.col("base")).drop("base", "extra", "n_blocks").join(left, "sid").filter("size > 0 AND size <= extra").join(every.filter("partial").select("sid", "block"), ["sid", "block"], "left_anti")
        blocks = materialize(few.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("drawn").alias("drawn"), F.first("top").alias("copy")), "mix-open")
        if blocks.isEmpty():
            return every
        blocks = blocks.join(blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("n_blocks")), "sid")
        blocks = blocks.withColumn("perm", _unit(F.lit(seed), "sid", "block", "copy")).withColumn("grp", F.floor(F.col("perm") * F.ceil(F.col("n_blocks") / GROUP_BLOCKS)))
        rest = F.when(F.col("before") + F.col("words") > F.col("extra"), F.col("extra") - F.col("before"))
        placed = _two_level(blocks, ["sid"]).filter("before < extra")
        last = materialize(placed.select("sid", "block", "copy", (F.col("drawn") + F.col("rank")).alias("spot"), rest.alias("rest"), F.lit(True).alias("partial"), F.col("extra").alias("most")), "mix-fill")
        every = every.unionByName(last)


def hypergeometric(population: str, good: str, drawn: str, unit: str) -> str:
    """SQL for an exact hypergeometric variate by inversion: how many of ``drawn`` are good, for a uniform ``unit`` in [0, 1).

    Probabilities are relative to that of the mode and follow from their neighbours' by recursion, upward and downward. Their
    sum is over the mode's neighbourhood of 9 standard deviations and 30, outside of which all probabilities together are
    less than what a double resolves. Steps grow with the standard deviation."""

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    none = "cast(array() as array<bigint>)"
    # Of either way: what the recursion passes through, the next probability, and where a walk is then.
    ways = {
        "up": (f"if(r.mode < r.hi, sequence(r.mode, r.hi - 1), {none})", "s.f * (1D * (p.good - x) * (p.take - x)) / (1D * (x + 1) * (p.pop - p.good - p.take + x + 1))", "x + 1"),
        "down": (f"if(r.mode > r.lo, sequence(r.mode, r.lo + 1, -1L), {none})", "s.f * (1D * x * (p.pop - p.good - p.take + x)) / (1D * (p.good - x + 1) * (p.take - x + 1))", "x - 1"),
    }

    def mass(way: str) -> str:
        path, ratio, _ = ways[way]
        onward = let(ratio, "g", "named_struct('f', g, 's', s.s + g)")
        return f"aggregate({path}, named_struct('f', 1D, 's', 0D), (s, x) -> {onward}, s -> s.s)"

    def walk(way: str, rest: str) -> str:
        path, ratio, at = ways[way]
        onward = let(ratio, "g", f"named_struct('f', g, 't', s.t - g, 'x', {at}, 'go', s.t >= g)")
        return f"aggregate({path}, named_struct('f', 1D, 't', {rest}, 'x', r.mode, 'go', true), (s, x) -> if(s.go, {onward}, s), s -> s.x)"

    low, high = "greatest(0L, p.take - (p.pop - p.good))", "least(p.take, p.good)"
    mode = f"greatest({low}, least({high}, cast(floor(1D * (p.take + 1) * (p.good + 1) / (p.pop + 2)) as bigint)))"
    variance = "1D * p.take * p.good / greatest(1, p.pop) * (1 - 1D * p.good / greatest(1, p.pop)) * (p.pop - p.take) / greatest(1, p.pop - 1)"
    pick = f"CASE WHEN t < 1 THEN r.mode WHEN t < 1 + m.up THEN {walk('up', 't - 1')} ELSE {walk('down', 't - 1 - m.up')} END"
    pick = let(f"named_struct('up', {mass('up')}, 'down', {mass('down')})", "m", let("p.u * (1 + m.up + m.down)", "t", pick))
    pick = let(f"named_struct('mode', mode, 'lo', greatest({low}, mode - w), 'hi', least({high}, mode + w))", "r", pick)
    pick = let(mode, "mode", let(f"cast(30 + 9 * ceil(sqrt(greatest(0D, {variance}))) as bigint)", "w", pick))
    return let(f"named_struct('pop', {population}, 'good', {good}, 'take', {drawn}, 'u', {unit})", "p", pick)


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """2^depth shards of equal numbers of draws: shard, sid, k. ``quotas``: sid, k (draws of the source).

    A node's left half draws from the node's sources in turn, each an exact hypergeometric variate given what is left."""
    item = "struct<sid:bigint,k:bigint>"
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("sid").cast("long").alias("sid"), F.col("k").cast("long").alias("k")))).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    unit = f"shiftrightunsigned(xxhash64({seed}L, node, q1.sid), 11) / {float(1 << 53)!r}D"
    h = f"if(q1.k = 0 OR a.n = 0, 0L, {hypergeometric('a.m', 'q1.k', 'a.n', unit)})"
    step = f"transform(array({h}), h -> named_struct('n', a.n - h, 'm', a.m - q1.k, 'l', concat(a.l, array(named_struct('sid', q1.sid, 'k', h)))))[0]"
    left = f"aggregate(q, named_struct('n', total div 2, 'm', total, 'l', cast(array() as array<{item}>)), (a, q1) -> {step}, a -> a.l)"
    for level in range(depth):
        if level and level % 8 == 0:
            node = node.repartition(shuffle_parts(node.sparkSession), "node")
        node = node.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x.k)")).withColumn("l", F.expr(left))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, l, (x, y) -> named_struct('sid', x.sid, 'k', x.k - y.k))").alias("q")))
        node = node.select(F.inline(halves))
    return node.select((F.col("node") - (1 << depth)).alias("shard"), F.inline("q"))


def assign(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block_words: int = 1 << 16, shard_words: int = 1 << 22, seed: int = 0, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (an array of copy and shard, one entry each time the mix takes
    the document), one row for each row of docs; with ``carry`` also row, all columns of docs.

    Null doc_ids and repeated doc_ids are dealt as any other: rows of one doc_id and text share a block and a draw, so they
    are taken alike except in blocks that an extra copy draws in part. A null text has size 0, a null source is a source of its own,
    last in order. A source without words has target 0 and is not taken. No rows: no rows. Columns besides doc_id, text
    and source don't matter. Reruns agree, however the rows are partitioned.
    """
    sized = materialize(sizes(docs, seed), "mix-sizes")
    src = targets(sized, weights, limit)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(0)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.greatest("source_size", "source_rows") / block_words))  # texts without words fill blocks, too
    src = materialize(src.withColumn("base", base.cast("int")).withColumn("extra", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long")).withColumn("n_blocks", n_blocks.cast("long")), "mix-targets")
    named = src.select(F.col("source").alias("its_source"), "sid", "source_size", "target", "base", "extra", "n_blocks")
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "draw"), F.col("n_blocks"))
    blocked = lambda x: x.join(named, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source").withColumn("block", block)
    rows = blocked(sized)
    blocks = materialize(rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("extra").alias("extra"), F.first("n_blocks").alias("n_blocks")), "mix-blocks")
    # Blocks without documents keep no rank, so a source's draws are counted from those that are there.
    blocks = blocks.drop("n_blocks").join(blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("n_blocks")), "sid")
    draws = _filled(materialize(_draws(blocks, seed), "mix-draws"), rows, seed, block_words)
    quotas = draws.groupBy("sid").agg(F.count(F.lit(1)).alias("k"))
    n = quotas.agg(F.sum("k")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, n * block_words / shard_words))))
    shares = split_tree(quotas, depth, seed).filter("k > 0")
    until = F.sum("k").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    spots = shares.withColumn("until", until).select("sid", "shard", F.explode(F.sequence(F.col("until") - F.col("k"), F.col("until") - 1)).alias("spot"))
    taken = draws.join(spots, ["sid", "spot"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("copies"), F.max("rest").alias("rest"), F.max("most").alias("most"))
    taken = materialize(taken, "mix-taken")
    placed = (blocked(sizes(docs, seed, carry)) if carry else rows).join(taken, ["sid", "block"], "left").withColumn("copies", F.coalesce("copies", F.expr("cast(array() as array<struct<copy:int,shard:bigint>>)")))
    cols = ["row"] * carry + ["doc_id", "source", "size", "source_size", "target", "copies"]
    # A block that the extra copy draws in part: its documents that still fit, or those that are short enough.
    but_last = "slice(copies, 1, size(copies) - 1)"
    split, fits = _split(placed.filter("rest IS NOT NULL"), block_words)
    split = split.join(fits, ["sid", "block"]).withColumn("copies", F.expr(f"if(fits[nth - 1], copies, {but_last})"))
    short = placed.filter("rest IS NULL AND most IS NOT NULL").withColumn("copies", F.expr(f"if(`size` <= most, copies, {but_last})"))
    return placed.filter("rest IS NULL AND most IS NULL").select(cols).unionByName(short.select(cols)).unionByName(split.select(cols))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: a row of docs for each time it is taken, with copy, shard and pos, to be read by shard in the order
    of pos (a hash: the local shuffle). Repeated rows are each taken; columns of docs with these names are replaced."""
    kept = [c for c in docs.columns if c not in ("copy", "shard", "pos")]
    out = assign(docs, carry=True, **params).select(*[F.col(f"row.`{c}`") for c in kept], F.inline("copies"))
    return out.withColumn("pos", F.xxhash64(F.lit(params.get("seed", 0)), F.lit("pos"), "doc_id", "text", "copy"))
