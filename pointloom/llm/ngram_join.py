"""N-gram Jaccard join by rare-first prefix filtering, and near-duplicate groups from it.

A text's set is its distinct shingles of ``n`` words. All shingles get one order, rarest first, by counts over all texts
in a table of hashed counters of fixed size. Two sets that reach the threshold share a shingle within a prefix of each, so
sets meet on prefix shingles only; length and positional filters drop a meeting before it becomes a pair, and each pair is
then verified once on whole sets, a suffix filter first.

Groups of near copies would make all pairs of their members. To lose no link between groups and yet make few pairs, sets
meet twice. First each prefix shingle pairs all its sets with one, that which holds it earliest in its order: it has
the fewest rare shingles, so it is nearest to what the others were copied from. Pairs within what these links connect can
no longer change a component; the second meeting pairs, on every shared prefix shingle, all sets of different components.
A shingle shared by very many sets is dealt out over salts in the first meeting, whose work is linear; in the second, sets of
every shingle with more than a few thousand are dealt over cells of two salts each.

Shingles and sets are known by 64-bit hashes. Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.components import connected_components

from .common import by_bytes, discard, materialize, mix64, release, shuffle_parts, text_buffer, word_hashes
from .slices import FORM, SCHEMA, added, saturating, sliced

SHINGLE_WORDS = 5
#: The threshold as a fraction, so that tests of it are exact.
SIMILARITY = (3, 4)
#: Hashed counters for the order of shingles.
COUNTERS = 1 << 24
#: Bits of the filter that tells which texts to shingle again for verification, and the most texts it is used for: beyond
#: these it would let most others through, and a join tells them.
FILTER_BITS = 1 << 25
FILTER_TEXTS = 1 << 22
#: A shingle counted more often is dealt over salts of about so many sets where sets first meet.
SALT_SETS = 1 << 18
#: A shingle counted more often is dealt over cells of two times so many sets at most where sets meet again.
CELL_SETS = 1 << 11


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles: n words in a row, or all words where there are fewer."""
    words, begin = word_hashes(raw, at)
    factor = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(n)]
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += words[k : len(words) - n + 1 + k] * factor[k]
    rolled = mix64(rolled)
    out = []
    for b, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if e - b >= n:
            out.append(np.unique(rolled[b : e - n + 1]))
        elif e > b:
            short = e - b
            for w in words[b:e].tolist():
                short = (short * int(factor[1]) + w) % (1 << 64)
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """The signed 64-bit id of a set."""
    total = np.array([s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)])
    return int(mix64(total[:1] ^ mix64(total[1:])).view(np.int64)[0])


def prefix_length(n: int | np.ndarray):
    num, den = SIMILARITY
    return n - -(-n * num // den) + 1


def linked(both, union) -> bool:
    num, den = SIMILARITY
    return den * both >= num * union


# ---- counters and bit filters ------------------------------------------------------------------------------------------


def _quarter_octaves(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(4 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _counter(shingles: np.ndarray, size: int) -> np.ndarray:
    return (shingles & np.uint64(size - 1)).astype(np.int64)


def _bits(doc_ids: np.ndarray) -> list[np.ndarray]:
    h = mix64(doc_ids.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(s)) % np.uint64(FILTER_BITS)).astype(np.int64) for s in (0, 20, 39)]


def bit_filter(doc_ids: DataFrame):
    """A broadcast of FILTER_BITS bits, of which each doc_id (one column, no nulls) has set three."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS, np.uint8)
        for b in batches:
            for at in _bits(b.column(0).to_numpy()):
                bits[at] = 1
        rows = list(sliced(bits))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FORM)

    marks = materialize(doc_ids.mapInArrow(mark, SCHEMA), "ngram-marks")
    shared = doc_ids.sparkSession.sparkContext.broadcast(added(marks, FILTER_BITS, "u1", np.bitwise_or, np.packbits))
    discard(marks)
    return shared


def maybe_in(bits: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """False only for doc_ids that aren't in the filter."""
    hit = np.ones(len(doc_ids), bool)
    for at in _bits(doc_ids):
        hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _told(shared) -> Column:
    """Whether doc_id (null: -1) may be in a bit filter."""

    @F.pandas_udf("boolean")
    def maybe(doc_id: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(shared.value, doc_id.fillna(-1).to_numpy(np.int64)))

    return maybe(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in removed (doc_id, distinct); null doc_ids stay.

    A bit filter of fixed size lets most texts stay where they are; only rows that it can't tell are shuffled and looked up.
    Where more are removed than the filter can tell, all rows are."""
    ids = materialize(removed.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL"), "ngram-removed")
    if ids.count() > FILTER_TEXTS:
        named = docs.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select(docs.columns)
        return named.unionByName(docs.filter("doc_id IS NULL"))
    told = _told(bit_filter(ids))
    return docs.filter(~told).unionByName(docs.filter(told).join(ids, "doc_id", "left_anti").select(docs.columns))


# ---- the passes over texts -------------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """A row for each text (doc_id, set_id, n_shingles), and rows of each task's counters (slice, body)."""
    form = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n_shingles", pa.int64()), ("slice", pa.int32()), ("body", pa.binary())])

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for b in by_bytes(batches):
            sets = shingle_sets(*text_buffer(b.column(1)), n)
            for s in sets:
                np.add.at(counts, _counter(s, COUNTERS), np.uint32(1))
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_id, sets), pa.int64()), pa.array(size, pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=form)
        rows = list(sliced(counts))
        if rows:
            yield pa.RecordBatch.from_pylist([r | {"doc_id": None, "set_id": None, "n_shingles": None} for r in rows], schema=form)

    return _texts(docs).mapInArrow(run, "doc_id long, set_id long, n_shingles long, slice int, body binary")


def _prefixes(docs: DataFrame, n: int, rarity) -> DataFrame:
    """shingle, salt, place, set_id: each task's distinct sets by their prefix shingles, rarest first; place: position above the
    set's size in one number."""
    form = pa.schema([("shingle", pa.int64()), ("salt", pa.int32()), ("place", pa.int64()), ("set_id", pa.int64())])
    # Counters also hold what other shingles add: what most hold is no sign of a frequent one.
    common = 2.0 ** (float(np.median(rarity.value)) / 4) - 1
    hot, several = (float(_quarter_octaves(np.array([n + 2 * common]))[0]) for n in (SALT_SETS, CELL_SETS))

    def run(batches):
        seen, table = set(), rarity.value
        for b in by_bytes(batches):
            cols = [[], [], [], []]
            for s in shingle_sets(*text_buffer(b.column(1)), n):
                own = set_id(s)
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                rank = table[_counter(s, COUNTERS)]
                first = np.argsort(rank, kind="stable")[: prefix_length(len(s))]  # s is sorted: ties by hash
                over = np.maximum(0, rank[first] - hot) / 4  # salt -1: all sets of the shingle meet; -2: they do, to be counted for cells
                cols[0].append(s[first].view(np.int64))
                cols[1].append(np.where(over > 0, abs(own) % np.ceil(2**over), np.where(rank[first] >= several, -2, -1)).astype(np.int32))
                cols[2].append((np.arange(len(first), dtype=np.int64) << 32) + len(s))
                cols[3].append(np.full(len(first), own, np.int64))
            if cols[0]:
                whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=form)
                for k in range(0, len(whole), 1 << 16):
                    yield whole.slice(k, 1 << 16)

    return _texts(docs).mapInArrow(run, "shingle long, salt int, place long, set_id long")


def _stars(prefixes: DataFrame) -> DataFrame:
    """Of each shingle (and salt) with several sets: its rows, and as star the set to pair each with, where filters allow.

    Rows come sorted by shingle, salt, position and set, so the first of a run is its star, and one pass suffices."""

    def run(batches):
        last = None  # the row before, its run's star, and whether it is still to be given out
        for b in batches:
            if not len(b):
                continue
            shingle, salt, place, own = (c.to_numpy() for c in b.columns)
            pos, size = place >> 32, place & 0xFFFFFFFF
            if last is not None:
                shingle, salt, pos, size, own = (np.concatenate([[x], y]) for x, y in zip(last[:5], (shingle, salt, pos, size, own)))
            new = np.ones(len(own), bool)
            new[1:] = (np.diff(shingle) != 0) | (np.diff(salt) != 0)
            again = np.zeros(len(own), bool)  # a set that several tasks have sent
            again[1:] = ~new[1:] & (np.diff(own) == 0)
            head = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            star, star_size, star_pos = (np.repeat(x[head], np.diff(np.append(head, len(own)))) for x in (own, size, pos))
            given = np.zeros(len(own), bool)
            if last is not None:
                k = run_of == 0
                star[k], star_size[k], star_pos[k], given[0] = *last[5:8], last[8]
            n_sets = np.bincount(run_of, weights=~again)
            several = (n_sets[run_of] > 1) | (salt >= 0)
            if last is not None and last[8]:
                several[run_of == 0] = True
            tail = len(own) - 1
            ok = (star != own) & _may_link(star_size, star_pos, size, pos)
            out = several & ~again & ~given
            # The last run may go on: its row waits in last if it is alone so far.
            last = (shingle[tail], salt[tail], pos[tail], size[tail], own[tail], star[tail], star_size[tail], star_pos[tail], bool(several[tail]))
            cols = [pa.array(x[out]) for x in (shingle, salt, pos.astype(np.int32), size.astype(np.int32), own)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(star[out], mask=~ok[out])], ["shingle", "salt", "pos", "size", "set_id", "star"])

    parts = shuffle_parts(prefixes.sparkSession)
    dealt = prefixes.repartition(parts, "shingle", "salt").sortWithinPartitions("shingle", "salt", "place", "set_id")
    return dealt.mapInArrow(run, "shingle long, salt int, pos int, size int, set_id long, star long")


def _may_link(size_a, pos_a, size_b, pos_b):
    """Length and positional filters for two sets whose first shared shingle, in the common order, is at these positions."""
    num, den = SIMILARITY
    size_a, size_b = size_a.astype(np.int64), size_b.astype(np.int64)
    most = np.minimum(size_a - pos_a, size_b - pos_b)
    near = den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b)
    return near & ((num + den) * most >= num * (size_a + size_b))


def _crossing(rows: DataFrame) -> DataFrame:
    """a, b: pairs of sets of different components that share a prefix shingle and pass the filters.

    A rare shingle's sets are one cell, compared in blocks. Of frequent ones, those whose sets are all of one component go
    first, by partial aggregation; sets of the others are dealt to a cell for each two salts of CELL_SETS sets."""
    salted = rows.filter("salt <> -1").drop("salt")
    spread = salted.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("shingle", F.ceil(F.col("n") / CELL_SETS).cast("int").alias("salts"))
    salted = salted.join(spread, "shingle").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int"))
    salted = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cols = ["shingle", "row", "col", "salt", "pos", "size", "set_id", "component"]
    rows = rows.filter("salt = -1").withColumns({"row": F.lit(0), "col": F.lit(0), "salt": F.lit(0)}).select(*cols).unionByName(salted.withColumns({"row": F.least("salt", "other"), "col": F.greatest("salt", "other")}).select(*cols))

    def pairs(row: int, col: int, salt, pos, size, own, component):
        a = np.flatnonzero(salt == row)
        b = a if row == col else np.flatnonzero(salt == col)
        step = max(1, (1 << 20) // max(1, len(b)))  # about a million comparisons at a time, however many sets meet
        for k in range(0, len(a), step):
            i = a[k : k + step, None]
            ok = (component[i] != component[b]) & _may_link(size[i], pos[i], size[b], pos[b])
            if row == col:
                ok &= i < b
            x, y = np.nonzero(ok)
            yield own[a[k + x]], own[b[y]]

    def run(batches):
        rest = None
        for b in _ended(batches):
            t = [c.to_numpy() for c in b.columns] if b is not None else None
            if rest is not None:
                t = rest if t is None else [np.concatenate([x, y]) for x, y in zip(rest, t)]
            if t is None or not len(t[0]):
                continue
            new = np.flatnonzero((np.diff(t[0]) != 0) | (np.diff(t[1]) != 0) | (np.diff(t[2]) != 0)) + 1
            heads = [0, *new.tolist(), len(t[0])]
            whole = heads if b is None else heads[:-1]
            found = set()
            for s, e in zip(whole, whole[1:]):
                comp = t[7][s:e]
                if (comp != comp[0]).any():
                    for x, y in pairs(int(t[1][s]), int(t[2][s]), *(c[s:e] for c in t[3:])):
                        found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
                        if len(found) > 1 << 18:
                            yield _pair_batch(found)
                            found = set()
            if found:
                yield _pair_batch(found)
            rest = [c[whole[-1] :] for c in t] if b is not None else None

    parts = shuffle_parts(rows.sparkSession)
    dealt = rows.repartition(parts, "shingle", "row", "col").sortWithinPartitions("shingle", "row", "col", "set_id")
    return dealt.mapInArrow(run, "a long, b long")


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _pair_batch(found: set) -> pa.RecordBatch:
    x = np.array(list(found), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


# ---- verification ----------------------------------------------------------------------------------------------------


def verified(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link: a suffix filter on parts between probes, then the whole intersection."""
    num, den = SIMILARITY
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    # The sets differ in at most so many shingles; parts of other sizes between the probes differ at least by those.
    allowed = len(a) + len(b) - 2 * -(-num * (len(a) + len(b)) // (num + den))
    if len(a) > 64:
        probes = a[:: len(a) // 8]
        in_a, in_b = (np.diff(np.concatenate([[0], np.searchsorted(x, probes), [len(x)]])) for x in (a, b))
        if np.abs(in_a - in_b).sum() > allowed:
            return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return linked(both, len(a) + len(b) - both)


def _verify(docs: DataFrame, pairs: DataFrame, owners: DataFrame, often: DataFrame, n: int) -> DataFrame:
    """pairs (a, b of set ids) with ok. owners: one doc_id of each set; often: doc_ids of several rows. Only texts that the pairs
    need are shingled again, and rows that repeat once."""
    spark = docs.sparkSession
    needed = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct().join(owners, "set_id")

    needed = materialize(needed.select("doc_id"), "ngram-needed")
    told = needed.count() <= FILTER_TEXTS
    shared = bit_filter(needed) if told else None
    texts = _texts(docs) if told else _texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(needed.distinct(), "doc_id", "left_semi").select("doc_id", "text")
    twice = materialize(needed.join(often, "doc_id", "left_semi").distinct(), "ngram-twice")
    repeats = None if twice.isEmpty() else bit_filter(twice)
    if repeats is not None:
        texts = texts.filter(~_told(repeats)).unionByName(texts.filter(_told(repeats)).distinct())

    def again(batches):
        seen = set()
        for b in by_bytes(batches):
            hit = maybe_in(shared.value, b.column(0).fill_null(-1).to_numpy()) if told else np.ones(len(b), bool)
            found = {set_id(x): x.tobytes() for x in shingle_sets(*text_buffer(b.column(1).take(pa.array(np.flatnonzero(hit)))), n) if len(x)}
            new = [k for k in found if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[k] for k in new], pa.binary())], ["set_id", "body"])

    # Sets that the filter lets through by chance join no pair, but for exact copies of ones that do: those may tell a pair
    # twice, alike. Both sides of the join read one shuffle of the sets.
    sets = texts.mapInArrow(again, "set_id long, body binary")

    def check(batches):
        for b in batches:
            ok = [verified(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    side = lambda k: sets.select(F.col("set_id").alias(k), F.col("body").alias(f"set_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
    links = materialize(joined.mapInArrow(check, "a long, b long, ok boolean"), "ngram-links")
    for b in (shared, repeats):
        if b is not None:
            b.destroy()
    discard(needed)
    discard(twice)
    return links


# ---- the operator ----------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs: the smallest doc_id that links reach, its own included.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Texts of fewer than n words
    are one shingle. Equal sets link, so repeated rows share a component; a null doc_id counts as none when the smallest
    is sought. Very long texts are shingled whole. No rows: no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    first = materialize(_sets_and_counts(docs, n), "ngram-counts")
    texts = materialize(first.filter("slice IS NULL").select("doc_id", "set_id", "n_shingles"), "ngram-texts")
    counts = added(first.filter("slice IS NOT NULL").select("slice", "body"), COUNTERS, "u4", saturating, _quarter_octaves)
    discard(first)
    rarity = spark.sparkContext.broadcast(counts)
    del counts
    release()
    owners = materialize(texts.filter("n_shingles > 0").groupBy("set_id").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id")), "ngram-owners")
    often = materialize(texts.filter("n_shingles > 0").groupBy(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).count().filter("count > 1").select("doc_id"), "ngram-often")

    meetings = materialize(_stars(_prefixes(docs, n, rarity)), "ngram-meetings")
    rarity.destroy()
    stars = meetings.filter("star IS NOT NULL").select(F.least("set_id", "star").alias("a"), F.greatest("set_id", "star").alias("b")).distinct()
    stars = _verify(docs, materialize(stars, "ngram-stars"), owners, often, n)
    edges = stars.filter("ok").select("a", "b")
    found = materialize(connected_components(edges), "ngram-components")

    labelled = meetings.join(found, F.col("set_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set_id"))
    crossing = _crossing(labelled.select("shingle", "salt", "pos", "size", "set_id", "component")).distinct().join(stars, ["a", "b"], "left_anti")
    crossing = materialize(crossing, "ngram-crossing")
    discard(meetings)
    edges = edges.unionByName(_verify(docs, crossing, owners, often, n).filter("ok").select("a", "b"))
    found = materialize(connected_components(materialize(edges, "ngram-links")), "ngram-components")

    full = texts.filter("n_shingles > 0").join(found, F.col("set_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = full.groupBy(F.col("component").alias("root")).agg(F.min("doc_id").alias("component_id"))
    full = full.join(lowest, F.col("component") == F.col("root")).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(texts.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
