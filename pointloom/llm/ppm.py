"""Language-model scores by prediction by partial matching (PPM, escape method C with symbol exclusion) over bytes.

The model is a trie of contexts of up to four bytes, pretrained on all training texts. A symbol's code length in a context
depends on that context's counts only: nested contexts have nested symbol sets, so what exclusion takes from a shorter
context is a sum known for each node. It is therefore worked out once for each distinct five-byte event. Texts are dealt
into groups of a few MB, a task each, which streams them. A group sends its distinct events and words, with their training
counts, to the parts of the trie and of the word table that own them. A part adds the lists of a bounded number of groups at
a time, in a tree, and answers as many groups at a time with a code length or a count for each key. No task holds the whole
trie or vocabulary, or the lists of all groups; only contexts of one byte or none, of fixed size, are sent to all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, materialize, release, text_buffer, word_hashes
from .slices import added, sliced

ORDER = 4
#: Bytes that UTF-8 never has: before a text's first byte and after its last one.
BEGIN, END = 0xFE, 0xFF
SYMBOLS = 256
#: Bytes of a group's texts.
GROUP_BYTES = 1 << 24
#: Most parts of the trie and of the word table, and most lists that a task adds up or answers.
PARTS, FAN_IN = 1 << 10, 64
#: Bytes of texts looked at together.
STEP = 1 << 20
WORDS, EVENTS, PAIRS, TEXT = 0, 1, 2, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def events(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's events, its end included, as context and symbol in 40 bits, and where each text's events begin."""
    n = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    buf = np.full(len(raw) + (ORDER + 1) * len(n), BEGIN, np.uint8)
    head = at[:-1] + (ORDER + 1) * np.arange(len(n))
    buf[np.arange(len(raw)) + np.repeat((ORDER + 1) * np.arange(len(n)) + ORDER, n)] = _LOWER[raw]
    buf[head + ORDER + n] = END
    first = np.arange(begin[-1]) + np.repeat(ORDER * np.arange(len(n)), n + 1)
    key = np.zeros(len(first), np.uint64)
    for k in range(ORDER + 1):
        key = key << np.uint64(8) | buf[first + k]
    return key, begin


def part_of(kind: int, key: np.ndarray, parts: int) -> np.ndarray:
    """Words by hash; events by the last two bytes of their context, so that all nodes above order 1 are whole in a part."""
    near = key if kind == WORDS else (key >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (near % np.uint64(parts)).astype(np.int64)


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, then values; compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(gaps.tobytes() + values.astype("<f8" if values.dtype.kind == "f" else "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(body: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(body[8:], 16 * n), np.uint8)
    both = [np.ascontiguousarray(raw[k * 8 * n : (k + 1) * 8 * n].reshape(8, n).T).ravel() for k in (0, 1)]
    return np.cumsum(both[0].view(np.uint64), dtype=np.uint64), both[1].view(kind)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    k, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first) if len(first) else n


class _Tally:
    """Counts of keys, added up whenever what waits has grown as large as what is there."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        if len(keys):
            u, n = np.unique(keys, return_counts=True)
            self.keys.append(u), self.counts.append(n * weight)
            self.waiting += len(u)
            if len(self.keys) > 1 and self.waiting > max(1 << 19, len(self.keys[0])):
                self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        both = _summed(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [both[0]], [both[1]], 0
        return both


# ---- the trie --------------------------------------------------------------------------------------------------------


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each event. keys: sorted distinct events of all contexts that share their last two bytes with any of
    them; counts: in training (0: not seen). pairs: counts of symbols after each byte, of all training texts."""
    counts = counts.astype(np.float64)
    seen, of, total, kinds, covered = [], [], [], [], []  # by order: each event's count and node; nodes' sums
    at = np.arange(len(keys))
    ev, c = keys, counts
    place = []  # of each key, its event of this order
    for order in (4, 3, 2):
        if order < 4:
            ev, inverse = np.unique(ev & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, weights=c, minlength=len(ev))
            at = inverse[at]
        _, node = np.unique(ev >> np.uint64(8), return_inverse=True)
        place.append(at), seen.append(c), of.append(node)
        total.append(np.bincount(node, weights=c))
        kinds.append(np.bincount(node, weights=c > 0))
    symbol = (keys & np.uint64(0xFF)).astype(np.int64)
    last = (keys >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
    pairs = pairs.astype(np.float64)
    single = pairs.sum(axis=0)
    # What a node's symbols hold of its shorter context's count.
    for k in (0, 1):
        shorter = np.zeros(len(seen[k]))
        shorter[place[k]] = seen[k + 1][place[k + 1]]
        covered.append(np.bincount(of[k], weights=shorter * (seen[k] > 0)))
    shorter = np.zeros(len(seen[2]))
    shorter[place[2]] = pairs[last, symbol]
    covered.append(np.bincount(of[2], weights=shorter * (seen[2] > 0)))
    by_order = [(seen[k][place[k]], total[k][of[k]][place[k]], kinds[k][of[k]][place[k]], covered[k][of[k]][place[k]]) for k in range(3)]
    by_order.append((pairs[last, symbol], pairs.sum(axis=1)[last], (pairs > 0).sum(axis=1)[last], ((pairs > 0) * single).sum(axis=1)[last]))
    by_order.append((single[symbol], np.full(len(keys), single.sum()), np.full(len(keys), (single > 0).sum()), np.zeros(len(keys))))
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    less, less_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for c, t, q, d in by_order:
        mass, escape = t - less, q - less_kinds
        known = open_ & (t > 0)
        hit = known & (c > 0)
        out[hit] += np.log(c[hit]) - np.log(mass[hit] + escape[hit])
        miss = known & (c == 0) & (escape > 0)
        out[miss] += np.log(escape[miss]) - np.log(mass[miss] + escape[miss])
        open_ &= ~hit
        less, less_kinds = np.where(t > 0, d, 0), np.where(t > 0, q, 0)
    out[open_] -= np.log(SYMBOLS - (single > 0).sum())
    return out / math.log(10)


# ---- groups and parts ------------------------------------------------------------------------------------------------


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin) - 1)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(values, begin[some])
    return out


def _gather(parts: int):
    """Of a group of texts, one task's rows: its distinct words and events with their training counts by part, and its counts
    of byte pairs."""
    form = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("grp", pa.int64()), ("body", pa.binary())])

    def run(batches):
        grp, found = None, (_Tally(), _Tally())
        pairs = np.zeros(65 * 1024, np.int64)
        for b in by_bytes(batches, 2, STEP):
            grp = b.column(0)[0].as_py()
            learn = b.column(1).to_numpy(zero_copy_only=False)
            buffer = text_buffer(b.column(2))
            for kind, make in ((WORDS, word_hashes), (EVENTS, events)):
                key, begin = make(*buffer)
                own = np.repeat(learn, np.diff(begin))
                seen = key[own]
                if kind == EVENTS:
                    pairs[: 1 << 16] += np.bincount((seen & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                found[kind].add(seen, 1)
                found[kind].add(key[~own], 0)
        if grp is None:
            return
        for kind in (WORDS, EVENTS):
            u, n = found[kind].sums()
            part = part_of(kind, u, parts)
            order = np.argsort(part, kind="stable")
            heads = np.flatnonzero(np.diff(part[order], prepend=-1))
            for s, e in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist()):
                own = order[s:e]
                yield pa.RecordBatch.from_pylist([{"kind": kind, "part": int(part[own[0]]), "grp": grp, "body": packed(u[own], n[own])}], schema=form)
        yield pa.RecordBatch.from_pylist([{"kind": PAIRS, "part": r["slice"], "grp": grp, "body": r["body"]} for r in sliced(pairs)], schema=form)
        del found
        release()

    return run


def _added_lists(t: pa.Table) -> pa.Table:
    """Lists of one part made one."""
    both = _summed(*zip(*(unpacked(x.as_py(), "<i8") for x in t.column("body"))))
    return pa.table([t.column("kind")[:1], t.column("part")[:1], t.column("bucket")[:1], pa.array([packed(*both)], pa.binary())], names=["kind", "part", "bucket", "body"])


def _values(shared):
    """Of a part: total counts of its words, and how many they are and how many differ in training; or log10 probabilities of
    its events."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        u, n = _summed(*zip(*(unpacked(x.as_py(), "<i8") for x in t.column("body"))))
        body = packed(u, n if kind == WORDS else code_lengths(u, n, shared.value))
        sums = [int(n.sum()), int((n > 0).sum())] if kind == WORDS else [0, 0]
        release()
        return pa.table([t.column("kind")[:1], t.column("part")[:1], pa.array([body], pa.binary()), *(pa.array([x], pa.int64()) for x in sums)], names=["kind", "part", "body", "total", "distinct"])

    return run


def _answer(asked: pa.Table, values: pa.Table) -> pa.Table:
    """For each group that asked a part: its keys with their values."""
    form = pa.schema([("kind", pa.int32()), ("grp", pa.int64()), ("body", pa.binary())])
    if not len(asked):
        return form.empty_table()
    kind = asked.column("kind")[0].as_py()
    u, value = unpacked(values.column("body")[0].as_py(), "<i8" if kind == WORDS else "<f8")
    keys = (unpacked(x.as_py(), "<i8")[0] for x in asked.column("body"))
    return pa.table([asked.column("kind"), asked.column("grp"), pa.array([packed(k, value[np.searchsorted(u, k)]) for k in keys], pa.binary())], schema=form)


def _score(total: int, distinct: int, ends: int):
    """Of a group's rows, answers first: its texts' numbers."""
    base = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    names = ["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"]

    def table(got, dtype):
        keys, values = (np.concatenate([np.zeros(0, (np.uint64, dtype)[i]), *(g[i] for g in got)]) for i in (0, 1))
        order = np.argsort(keys)
        return keys[order], values[order]

    def run(batches):
        got, tables = ([], []), None
        for whole in batches:
            kinds = whole.column(1).to_numpy()
            answers = int(np.searchsorted(kinds, TEXT))
            for kind, body in zip(kinds[:answers].tolist(), whole.column(2)[:answers]):
                got[kind].append(unpacked(body.as_py(), ("<i8", "<f8")[kind]))
            if answers == len(whole):
                continue
            if tables is None:
                tables, got = (table(got[WORDS], "<i8"), table(got[EVENTS], "<f8")), None
            for b in by_bytes([whole.slice(answers)], 5, STEP):
                buffer = text_buffer(b.column(5))
                words, begin = word_hashes(*buffer)
                c = tables[WORDS][1][np.searchsorted(tables[WORDS][0], words)] if len(words) else np.zeros(0, np.int64)
                event, first = events(*buffer)
                length = tables[EVENTS][1][np.searchsorted(tables[EVENTS][0], event)]
                known = _sums((c > 0).astype(np.float64), begin).astype(np.int64) + (ends > 0)
                cols = [b.column(3), b.column(4), pa.array(np.diff(begin) + 1), pa.array(known), pa.array(_sums(base(c), begin) + base(ends)), pa.array(_sums(length, first))]
                yield pa.RecordBatch.from_arrays(cols, names)
        del got, tables
        release()

    return run


def scores(docs: DataFrame, learn: Column, group_bytes: int = GROUP_BYTES, parts: int = PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score for each row of docs, from the rows of docs for
    which learn holds (null: it doesn't).

    A-Z are lower-cased. score is the log10 probability of a text's bytes and its end under the PPM model, base_score that of
    its words and an end under smoothed word frequencies. Null texts are empty; empty texts are an end only. Null and
    repeated doc_ids and repeated rows are scored as any other and spread over groups like others; very long texts are one
    row of their group; other columns don't matter. Without training rows every symbol is as likely as any other. No rows:
    no rows.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, ends = rows.agg(F.sum(F.octet_length("text") + 1), F.count(F.when(F.col("learn"), 1))).first()
    groups = max(1, math.ceil((size or 0) / group_bytes))
    texts = materialize(rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), "ppm-texts")
    dealt = lambda x: x.repartitionById(groups, F.col("grp").cast("int"))
    asked = dealt(texts.select("grp", "learn", "text")).mapInArrow(_gather(min(parts, max(16, groups))), "kind int, part long, grp long, body binary")
    asked = materialize(asked, "ppm-asked")
    pairs = added(asked.filter(F.col("kind") == PAIRS).select(F.col("part").cast("int").alias("slice"), "body"), 65 * 1024, "i8")[: 1 << 16].reshape(256, 256)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    lists = asked.filter(F.col("kind") != PAIRS).withColumn("bucket", F.expr(f"grp div {fan_in}"))
    tree, left = lists.select("kind", "part", "bucket", "body"), groups
    while left > fan_in:
        tree = materialize(tree.groupBy("kind", "part", "bucket").applyInArrow(_added_lists, "kind int, part long, bucket long, body binary"), "ppm-added")
        tree, left = tree.withColumn("bucket", F.expr(f"bucket div {fan_in}")), math.ceil(left / fan_in)
    values = materialize(tree.groupBy("kind", "part").applyInArrow(_values(shared), "kind int, part long, body binary, total long, distinct long"), "ppm-values")
    shared.destroy()
    total, distinct = values.filter(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)
    key = ["kind", "part", "bucket"]
    to_all = values.select("kind", "part", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((groups - 1) // fan_in).cast("long"))).alias("bucket"))
    answers = materialize(lists.groupBy(*key).cogroup(to_all.groupBy(*key)).applyInArrow(_answer, "kind int, grp long, body binary"), "ppm-answers")
    discard(asked)
    none = lambda name, of: F.lit(None).cast(of).alias(name)
    both = answers.select("grp", "kind", "body", none("doc_id", kind), none("learn", "boolean"), none("text", "string"))
    both = both.unionByName(texts.select("grp", F.lit(TEXT).alias("kind"), none("body", "binary"), "doc_id", "learn", "text"))
    out = dealt(both).sortWithinPartitions("kind").mapInArrow(_score(total, distinct, ends), f"doc_id {kind.simpleString()}, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
