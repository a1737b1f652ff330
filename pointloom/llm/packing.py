"""Packing documents into token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most one sequence; whole-sequence pieces need no packing. The others are dealt by hash into
chunks of a bounded number of pieces. Each chunk is solved on several islands, each a population of packings in a group of
its own: crossover injects well-filled bins of one parent whole into the other, drops that parent's bins which hold any of
the same pieces, exchanges displaced pieces for ones of other bins where these get fuller, and best-fits the rest. After
each epoch an island's elite moves on to the next island of its chunk by a shuffle. The emptiest bins that a chunk's best
packing leaves are dealt and packed again with those of other chunks, over fewer and fewer chunks, until one is left.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize

CAPACITY = 2048
CHUNK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
OFFSPRING = 96
#: An epoch also ends after so many offspring in a row that bettered nothing.
PATIENCE = 32
#: The most of a chunk's pieces that are dealt again: those in its emptiest bins with room.
AGAIN = 0.25
#: The most tasks that islands are dealt over; beyond so many islands a task has several, one after the other.
ISLAND_TASKS = 65536

_ENCODERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """The byte-level BPE tokenizer of a tokenizers JSON file as a tiktoken encoding: the same ids, several times as fast."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes other bytes as 256, 257, ...
        byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in printable)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): n for word, n in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the pre-tokenizer of this kind of file
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its regex engine gives up on white space of hundreds of thousands of characters; the other doesn't
        from tokenizers import Tokenizer

        if ("slow", path) not in _ENCODERS:
            _ENCODERS["slow", path] = Tokenizer.from_file(path)
        return np.array(_ENCODERS["slow", path].encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece of each row of docs.

    A document is its text's ids, then end_id; a null text is empty. One longer than capacity is cut into pieces of
    capacity of which the first may be shorter. Null and repeated doc_ids, repeated rows and other columns don't matter;
    very long texts are read whole.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            at, piece, start, length, ids = [], [], [], [], []
            for n, text in enumerate(b.column(1)):
                own = np.append(token_ids(text.as_py() or "", path), end_id).astype("<u4")
                bounds = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
                    at.append(n), piece.append(k), start.append(s), length.append(e - s), ids.append(own[s:e].tobytes())
            cols = [b.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---- one island ------------------------------------------------------------------------------------------------------


def best_fit(items, lengths: list[int], bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts each item where it leaves the least room, or into a new bin; bins and room are updated."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin has room r
    for b, r in enumerate(room):
        if r:
            by_room[r].append(b)
            open_rooms |= 1 << r
    for i in items:
        n = lengths[i]
        if fits := open_rooms >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(0)
        bins[i] = b
        room[b] = r = r - n
        if r:
            if not by_room[r]:
                open_rooms |= 1 << r
            by_room[r].append(b)


def fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven ones: room gathered in few bins is of more use."""
    f = fills(bins, lengths)
    return -len(f), float((f * f).sum()) / capacity**2


def bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth): pieces above half need bins of their own, and of those shorter than these
    leave room for, only what fits there is free."""
    n = np.bincount(lengths, minlength=capacity + 1)
    upto, words = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, total = capacity // 2, upto[capacity]
    short = np.arange(half + 1)  # pieces shorter than this are left aside
    below = np.where(short > 0, words[np.maximum(short - 1, 0)], 0)
    middle, middle_words = upto[capacity - short] - upto[half], words[capacity - short] - words[half]
    extra = -((-(words[half] - below - (middle * capacity - middle_words))) // capacity)
    return int((total - upto[half] + np.maximum(0, extra)).max(initial=0))


def exchange(out: np.ndarray, rest: np.ndarray, as_list: list[int], room: list[int]) -> np.ndarray:
    """Swaps pieces of bins with unplaced ones (rest), where that fills a bin more: one or two against one, or one against two.

    Each bin takes the swap that fills it most of those tried. out and room are updated; what is unplaced then is returned."""
    free = sorted((as_list[i], i) for i in rest.tolist())
    placed = np.argsort(out, kind="stable")
    placed = placed[out[placed] >= 0]
    heads = np.flatnonzero(np.diff(out[placed], prepend=-1)).tolist()
    placed = placed.tolist()
    last = (1 << 60,)
    for b, (s, e) in enumerate(zip(heads, [*heads[1:], len(placed)])):
        if not room[b] or not free:
            continue
        items, gain, swap = placed[s:e], 0, None
        for x, i in enumerate(items):
            n = as_list[i]
            top = bisect_right(free, (n + room[b], *last)) - 1
            if top >= 0 and free[top][0] - n > gain:
                gain, swap = free[top][0] - n, ((i,), (top,))
            low, high = 0, top
            for _ in range(24):
                if low >= high:
                    break
                two = free[low][0] + free[high][0] - n
                if two > room[b]:
                    high -= 1
                    continue
                if two > gain:
                    gain, swap = two, ((i,), (low, high))
                low += 1
            for j in items[x + 1 :] if len(items) <= 6 else ():
                both = n + as_list[j]
                top = bisect_right(free, (both + room[b], *last)) - 1
                if top >= 0 and free[top][0] - both > gain:
                    gain, swap = free[top][0] - both, ((i, j), (top,))
        if swap:
            come = [free[k][1] for k in swap[1]]
            for k in reversed(swap[1]):
                del free[k]
            for i in swap[0]:
                out[i] = -1
                insort(free, (as_list[i], i))
            out[come] = b
            room[b] -= gain
    return np.array([i for _, i in free], np.int64)


def _rebuild(keep: np.ndarray, bins: np.ndarray, injected: np.ndarray | None, lengths: np.ndarray, as_list: list[int], capacity: int, rng) -> np.ndarray:
    """bins where keep says so, injected's groups (-1: none) as new bins, other items exchanged for theirs or best-fitted, longest first."""
    out = np.full(len(bins), -1, np.int32)
    own = keep[bins]
    if injected is not None:
        own &= injected < 0
    _, out[own] = np.unique(bins[own], return_inverse=True)
    if injected is not None and (new := injected >= 0).any():
        _, group = np.unique(injected[new], return_inverse=True)
        out[new] = group + out.max(initial=-1) + 1
    placed = out >= 0
    room = (capacity - np.bincount(out[placed], weights=lengths[placed])).astype(int).tolist() if placed.any() else []
    rest = np.sort(exchange(out, np.flatnonzero(~placed), as_list, room)) if room else np.flatnonzero(~placed)
    best_fit(rest[np.argsort(-lengths[rest] * rng.uniform(0.97, 1, len(rest)), kind="stable")].tolist(), as_list, out, room, capacity)
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, as_list: list[int], capacity: int, rng) -> np.ndarray:
    f = fills(b, lengths)
    good = np.argsort(-f, kind="stable")[: max(1, len(f) // 2)]
    chosen = np.zeros(len(f), bool)
    chosen[rng.choice(good, max(1, len(good) // 5), replace=False)] = True
    injected = np.where(chosen[b], b, -1)
    keep = np.ones(int(a.max()) + 1, bool)
    keep[a[injected >= 0]] = False
    return _rebuild(keep, a, injected, lengths, as_list, capacity, rng)


def mutate(a: np.ndarray, lengths: np.ndarray, as_list: list[int], capacity: int, rng) -> np.ndarray:
    """Dissolves the emptiest bins and a few others."""
    f = fills(a, lengths)
    keep = np.ones(len(f), bool)
    keep[np.argsort(f, kind="stable")[: 2 + len(f) // 50]] = False
    keep[rng.integers(0, len(f), 2 + len(f) // 20)] = False
    return _rebuild(keep, a, None, lengths, as_list, capacity, rng)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng, offspring: int = OFFSPRING) -> list[np.ndarray]:
    """The population after so many offspring, best first; made here where there is none. Ends early at the lower bound
    or where nothing gets better."""
    as_list = lengths.tolist()
    nothing = np.zeros(1, bool)
    zero = np.zeros(len(lengths), np.int32)
    goal = -bound(lengths, capacity)
    scored = [(fitness(x, lengths, capacity), x) for x in population]
    if not scored:
        plain = np.full(len(lengths), -1, np.int32)
        best_fit(np.argsort(-lengths, kind="stable").tolist(), as_list, plain, [], capacity)
        scored = [(fitness(plain, lengths, capacity), plain)]
    done = lambda: max(s[0][0] for s in scored) >= goal
    while len(scored) < POPULATION and not done():
        x = _rebuild(nothing, zero, None, lengths, as_list, capacity, rng)
        scored.append((fitness(x, lengths, capacity), x))
    best_first = lambda: sorted(scored, key=lambda s: s[0], reverse=True)[:POPULATION]
    best, since = None, 0
    for k in range(offspring):
        scored = best_first()
        best, since = scored[0][0], since + 1 if scored[0][0] == best else 0
        if done() or len(scored) < 2 or since > PATIENCE:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = mutate(scored[i][1], lengths, as_list, capacity, rng) if k % 4 == 3 else crossover(scored[i][1], scored[j][1], lengths, as_list, capacity, rng)
        score = fitness(child, lengths, capacity)
        if all(score != s for s, _ in scored):
            scored.append((score, child))
    return [x for _, x in best_first()]


# ---- chunks and rounds -----------------------------------------------------------------------------------------------

_STATE = "pack_chunk long, island int, lengths binary, population array<binary>"


def _solved(chunked: DataFrame, chunks: int, capacity: int, seed: int) -> DataFrame:
    """pack_chunk and bins (32-bit, in the chunk's order of pack_uid): the best packing that any of its islands found.

    Islands are few bytes and much work, so their tasks are counted by islands: adaptive execution would join them by bytes."""
    form = pa.schema([("pack_chunk", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary()))])

    def start(t: pa.Table) -> pa.Table:
        t = t.sort_by("pack_uid")
        n = t.column("length").to_numpy().astype("<i4").tobytes()
        k = t.column("pack_chunk")[0].as_py()
        return pa.table([[k] * ISLANDS, list(range(ISLANDS)), [n] * ISLANDS, [[]] * ISLANDS], schema=form)

    def epoch(e: int):
        def run(t: pa.Table) -> pa.Table:
            k, island = t.column("pack_chunk")[0].as_py(), t.column("island")[0].as_py()
            lengths = np.frombuffer(max(t.column("lengths").to_pylist()), "<i4").astype(np.int64)
            arrived = sorted(x for p in t.column("population").to_pylist() for x in p)
            found = evolve(lengths, [np.frombuffer(x, "<i4") for x in arrived], capacity, np.random.default_rng([seed, k, island, e]))
            keep = [x.astype("<i4").tobytes() for x in found]
            n = lengths.astype("<i4").tobytes()
            # Its own population stays; a copy of its elite goes to the next island.
            return pa.table([[k, k], [island, (island + 1) % ISLANDS], [n, b""], [keep, keep[:1]]], schema=form)

        return run

    def best(t: pa.Table) -> pa.Table:
        lengths = np.frombuffer(max(t.column("lengths").to_pylist()), "<i4").astype(np.int64)
        found = sorted(x for p in t.column("population").to_pylist() for x in p)
        top = max(found, key=lambda x: fitness(np.frombuffer(x, "<i4"), lengths, capacity))
        return pa.table([[t.column("pack_chunk")[0].as_py()], [top]], names=["pack_chunk", "bins"])

    state = chunked.select("pack_chunk", "pack_uid", "length").groupBy("pack_chunk").applyInArrow(start, _STATE)
    for e in range(EPOCHS):
        state = state.repartition(min(chunks * ISLANDS, ISLAND_TASKS), "pack_chunk", "island").groupBy("pack_chunk", "island").applyInArrow(epoch(e), _STATE)
    return state.groupBy("pack_chunk").applyInArrow(best, "pack_chunk long, bins binary")


def _placer(depth: int, capacity: int, again: float):
    """Of a chunk's rows and its solution: the rows with sequence_id, offset, and whether their bin stays: all but the emptiest
    ones with room, which hold at most a share ``again`` of the pieces, or are one bin with at most half of them."""

    def place(t: pa.Table, solution: pa.Table) -> pa.Table:
        t = t.sort_by("pack_uid")
        bins = np.frombuffer(solution.column("bins")[0].as_py(), "<i4")
        lengths = t.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        ids = (np.int64(depth) << 57) + (np.int64(t.column("pack_chunk")[0].as_py()) << 20) + bins
        full = fills(bins, lengths)
        emptiest = np.argsort(full, kind="stable")
        pieces = np.cumsum(np.bincount(bins, minlength=len(full))[emptiest])
        share = (pieces <= again * len(bins)) | (np.arange(len(full)) == 0) & (pieces <= len(bins) // 2) & (again > 0)
        stays = np.ones(len(full), bool)
        stays[emptiest[share]] = full[emptiest[share]] >= capacity
        return t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("pack_stays", pa.array(stays[bins]))

    return place


def pack(cut: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES, seed: int = 0, again: float = AGAIN) -> DataFrame:
    """The rows of cut (any columns; length: 1 to capacity) with sequence_id and offset, gapless from 0 in each sequence.

    ``again`` (0 to 0.5): the share of a chunk's pieces, those of its emptiest bins with room, that meet the ones of other
    chunks in a next round; one rule for all lengths. The last round has one chunk, all of whose bins stay. Ties and repeated
    rows are packed as any other. No rows: no rows. Columns with the names sequence_id, offset and pack_* are replaced.
    """
    cols = [c for c in cut.columns if c not in ("sequence_id", "offset") and not c.startswith("pack_")]
    rows = materialize(cut.select(*cols).withColumn("pack_uid", F.monotonically_increasing_id()), "pack-pieces")
    whole = rows.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("pack_uid")).withColumn("offset", F.lit(0).cast("long"))
    out, left = whole.select(*cols, "sequence_id", "offset"), rows.filter(F.col("length") < capacity)
    for depth in range(64):
        n = left.count()
        if not n:
            break
        chunks = math.ceil(n / chunk_pieces)
        chunked = left.withColumn("pack_chunk", F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "pack_uid"), F.lit(chunks)))
        schema = chunked.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn("pack_stays", F.lit(True)).schema
        place = _placer(depth, capacity, 0 if chunks == 1 else min(0.5, again))
        packed = chunked.groupBy("pack_chunk").cogroup(_solved(chunked, chunks, capacity, seed + depth).groupBy("pack_chunk")).applyInArrow(place, schema)
        packed = materialize(packed, "pack-round")
        out = out.unionByName(packed.filter("pack_stays").select(*cols, "sequence_id", "offset"))
        left = packed.filter("NOT pack_stays").select(*cols, "pack_uid")
    else:
        raise RuntimeError("pieces are left after 64 rounds, each of which should halve them")
    return out
