"""Cross-tokenizer alignment of two tokenizers' tokens of the same bytes.

Each document has a string of one label a byte: none, an A token ends here, a B token ends here, or both. A regular
expression scans it for spans up to each both-label; the labels in a span count the tokens of a group, and groups' tokens
follow one another in both sequences. A group links each of its A tokens to each of its B tokens.

How many documents hold a pair of ids linked is counted over all of them without a shuffle of documents' pairs: documents
are gathered into blocks of some megabytes; a block knows its distinct pairs and how many of its documents hold each. What
is shuffled is one row for each block and pair: counts are sums over blocks, and each block is answered for the pairs
it has. Documents stay where they are, as indices into their block's pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize
from .packing import encoder

#: Bytes of texts in a block; one longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Links of a group beyond which its equal ids are counted before they are paired.
WIDE = 4096
A_END, B_END, BOTH = 1, 2, 3
_SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)
_PLACES = np.int64(32)

_MODELS: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, the bytes of their tokens, and decimal ids with the sign that follows them."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.path, self.a, self.slow = a, encoder(a), None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        known = range(self.b.get_piece_size())
        self.b_bytes = [self._piece(k) for k in known]
        self.a_bytes = [self._token(k) for k in range(self.a.n_vocab)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = [*map(str, range(max(len(self.a_bytes), len(self.b_bytes))))]
        self.size = len(ids)
        self.written = [x + sign for sign in ",|;" for x in ids]  # id + size * (0 within, 1 after the last A, 2 after the last B)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def _token(self, k: int) -> bytes:
        try:
            return self.a.decode_single_token_bytes(k)
        except KeyError:  # a number that no token has
            return b""

    def a_ids(self, text: str) -> np.ndarray:
        try:
            return self.a.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        except ValueError:  # its regex engine gives up on white space of hundreds of thousands of characters; the other doesn't
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text; None where there is none, or where either's bytes are other than those of a space and the text."""
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                yield None
                continue
            raw, a = b" " + text.encode(), self.a_ids(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, np.array(b, np.int64)) if same else None


def models(a: str, b: str) -> Pair:
    if (a, b) not in _MODELS:
        _MODELS[a, b] = Pair(a, b)
    return _MODELS[a, b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- one document ----------------------------------------------------------------------------------------------------


def labels(a_length: np.ndarray, b_length: np.ndarray) -> bytes:
    """One label for each byte, from the lengths of both sequences' tokens."""
    out = np.zeros(int(a_length.sum()), np.uint8)
    out[np.cumsum(a_length) - 1] |= A_END
    out[np.cumsum(b_length) - 1] |= B_END
    return out.tobytes()


def group_sizes(label: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens of each group, in order: what the labels of each span up to a both-label count."""
    ends = np.cumsum(np.fromiter(map(len, _SPAN.findall(label)), np.int64))
    marks = np.frombuffer(label, np.uint8)
    count = lambda end: np.diff(np.cumsum(marks & end != 0)[ends - 1], prepend=0)
    return count(A_END), count(B_END)


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (A id shifted left by 32 bits, plus B id), sorted, and how often each is linked."""
    first_a, first_b, product = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    few = np.flatnonzero(product <= WIDE)
    total, of = product[few], np.repeat(few, product[few])
    place = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
    keys, times = np.unique((a[first_a[of] + place // n_b[of]] << _PLACES) + b[first_b[of] + place % n_b[of]], return_counts=True)
    for g in np.flatnonzero(product > WIDE):
        x, more_x = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, more_y = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        wide = ((x[:, None] << _PLACES) + y).ravel()
        both, at = np.unique(np.concatenate([keys, wide]), return_inverse=True)
        summed = np.zeros(len(both), np.int64)
        np.add.at(summed, at, np.concatenate([times, np.outer(more_x, more_y).ravel()]))
        keys, times = both, summed
    return keys, times


def written(m: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
    """Groups as text: A ids, a bar, B ids; semicolons between groups."""
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    all_a, all_b = np.cumsum(n_a), np.cumsum(n_b)
    code = np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + (all_b - n_b)[of_a], np.arange(len(b)) + all_a[of_b]
    code[at_a], code[at_b] = a, b
    code[at_a[all_a - 1]] += m.size
    code[at_b[all_b - 1]] += 2 * m.size
    return "".join(map(m.written.__getitem__, code.tolist()))[:-1]


# ---- blocks ----------------------------------------------------------------------------------------------------------

_BLOCK = "block string, pairs binary, held binary, ends binary, at binary, times binary, docs array<struct<doc_id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"


def _packed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(x.tobytes(), asbytes=True)


def _unpacked(body: bytes, n: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd", 1).decompress(body, n * np.dtype(kind).itemsize), kind)


def blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each block: its distinct pairs (8 bytes each, sorted), how many of its documents hold each, and its
    documents, with the places of their pairs and how often each is linked."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, task, made = models(a, b), TaskContext.get().partitionId(), 0
        rows, own, size = [], [], 0

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            count = np.array([len(k) for k, _ in own], np.int64)
            keys = np.concatenate([k for k, _ in own])
            pairs, at, held = np.unique(keys, return_inverse=True, return_counts=True)
            at = at.astype(np.int64)
            starts = (np.cumsum(count) - count)[count > 0]
            step = np.diff(at, prepend=0)
            step[starts] = at[starts]
            times = np.concatenate([t for _, t in own])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            kinds = [id_type, *[pa.int64()] * 4, pa.string()]
            items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), items)
            body = [pairs.tobytes(), held.astype(np.int64).tobytes(), np.cumsum(count).tobytes(), _packed(step), _packed(times.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), *[pa.array([x], pa.binary()) for x in body], docs], ["block", "pairs", "held", "ends", "at", "times", "docs"])

        none = np.zeros(0, np.int64)
        id_type = None
        for batch in by_bytes(batches):
            id_type = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for doc_id, text, found in zip(batch.column(0).to_pylist(), texts, m.encode(texts)):
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, "")), own.append((none, none))
                else:
                    x, y = found
                    n_a, n_b = group_sizes(labels(m.a_length[x], m.b_length[y]))
                    own.append(links(x, y, n_a, n_b))
                    rows.append((doc_id, len(x), len(y), len(n_a), int((n_a * n_b).sum()), hashlib.sha256(written(m, x, y, n_a, n_b).encode()).hexdigest()))
                size += 64 + len(text or "")
                if size >= BLOCK_BYTES:
                    yield flush(id_type)
                    made, rows, own, size = made + 1, [], [], 0
        if rows:
            yield flush(id_type)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCK.format(kind=kind.simpleString()))


def _listed(table: DataFrame) -> DataFrame:
    """block, place, pair, held: one row for each pair of each block."""

    def run(batches):
        for b in batches:
            for block, pairs, held in zip(*(b.column(k).to_pylist() for k in range(3))):
                pairs, held = np.frombuffer(pairs, np.int64), np.frombuffer(held, np.int64)
                for k in range(0, len(pairs), 1 << 16):
                    n = len(pairs[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(pairs[k : k + n]), pa.array(held[k : k + n])], ["block", "place", "pair", "held"])

    return table.select("block", "pairs", "held").mapInArrow(run, "block string, place int, pair long, held long")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, documents (how many hold it linked) and best (whether no other pair of its A id is in more)."""
    counts = _listed(table).groupBy("pair").agg(F.sum("held").alias("documents")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _answered(table: DataFrame, counts: DataFrame) -> DataFrame:
    """block, counts and best: what its pairs' counts are, in their order."""

    def gather(t: pa.Table) -> pa.Table:
        place = t.column("place").to_numpy()
        number, best = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
        number[place] = t.column("documents").to_numpy()
        best[place] = t.column("best").to_numpy()
        return pa.table([t.column("block").slice(0, 1), pa.array([_packed(number)], pa.binary()), pa.array([_packed(best)], pa.binary())], names=["block", "counts", "best"])

    asked = _listed(table).drop("held").join(counts, "pair")
    return asked.select("block", "place", "documents", "best").groupBy("block").applyInArrow(gather, "block string, counts binary, best binary")


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text).

    a: a byte-level BPE file of tokenizers; b: a sentencepiece model. Texts that are null, empty, or whose bytes either
    tokenizer changes have no tokens: zeros and ''. Very long texts are read whole. A repeated row is a document each time.
    Pairs whose counts tie for an A id's highest are all best. Null and repeated doc_ids don't matter, nor do other columns.
    No rows: no rows.
    """
    own = default_tokenizers()
    table = materialize(blocks(docs, a or own[0], b or own[1]), "align-blocks")
    counts = materialize(pair_counts(table), "align-counts")
    answers = _answered(table, counts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                ends = np.frombuffer(row["ends"].as_py(), np.int64)
                n, wide = int(ends[-1]), len(row["pairs"].as_py()) // 8
                step, times = (_unpacked(row[c].as_py(), n) for c in ("at", "times"))
                begin = np.concatenate([[0], ends[:-1]])
                some = ends > begin
                total = np.cumsum(step)
                at = total - np.repeat(total[begin[some]] - step[begin[some]], (ends - begin)[some])
                number, best = (_unpacked(row[c].as_py(), wide, t) if row[c].is_valid else np.zeros(0, t) for c, t in (("counts", np.int64), ("best_of", np.uint8)))
                sums = []
                for value in (times * best[at], times * number[at]):
                    run_sum = np.concatenate([[0], np.cumsum(value)])
                    sums.append(run_sum[ends] - run_sum[begin])
                items = row["docs"].values
                c = dict(zip((f.name for f in items.type), items.flatten()))
                cols = [c["doc_id"], c["n_a"], c["n_b"], c["n_groups"], c["n_links"], pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), c["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    # A block whose documents have no pairs has no answer.
    whole = table.drop("held").join(answers.withColumnRenamed("best", "best_of"), "block", "left")
    return whole.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
