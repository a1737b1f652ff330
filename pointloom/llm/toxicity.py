"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first few bytes, so that forms of a stem share
most of it. Filters of several widths slide over whole texts; the largest and the third largest response of each filter go
into a logistic layer, so that what recurs can weigh more than what occurs once. Training is done in one task on a bounded sample of labelled rows. Function words tell a text's language, and each
language's threshold, calibrated on a part of the sample that training leaves out, is mapped to a score of 0.7.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, release, text_buffer, word_hashes

#: Labelled rows that the classifier is fitted on at most: those of least hash, of either label.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
#: Bytes of their texts at most: whole texts by hash until the next would pass this. One text is at most a small part of it.
TRAIN_BYTES = 1 << 26
#: The longest text that is trained on, in bytes.
TRAIN_TEXT_BYTES = 1 << 20
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 12, 10, (1, 2, 3)
CUTS = (4, 5, 6)
EPOCHS, BATCH, RATE = 6, 64, 0.05
THRESHOLD = 0.7
#: Frequent function words of each language that has a threshold of its own; texts without any share a further one.
LANGUAGES = {
    "en": "the and of to is was with for that this are by",
    "de": "der die das und ist nicht mit von den zu ein eine",
    "fr": "le les des et est dans pour une pas qui sur vous",
    "es": "el los las y es por para con una del lo como",
}

_ENDS = np.ones(256, bool)  # letters, digits and all bytes of other scripts make words
_ENDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SHIFTS = [(w, o) for w in WIDTHS for o in range(w)]


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids (0: none) of each word and its beginnings, with padding after each text, and where texts begin."""
    hashed, begin = word_hashes(*text_buffer(column), _ENDS, CUTS)
    pad = max(WIDTHS) - 1
    n = np.diff(begin)
    to = np.arange(len(hashed[0])) + np.repeat(np.arange(len(n)) * pad, n)
    ids = np.zeros((len(hashed[0]) + pad * len(n), len(hashed)), np.int32)
    for k, h in enumerate(hashed):
        ids[to, k] = ((h >> np.uint64(7)) + np.uint64(k * 7919)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return ids, begin + np.arange(len(begin)) * pad


def _all_features(column) -> tuple[np.ndarray, np.ndarray]:
    """The same of a whole column, a few MB of texts at a time."""
    parts = [_features(b.column(0)) for b in by_bytes(pa.table([column], names=["text"]).to_batches(), 0)]
    if not parts:
        return np.zeros((0, 1 + len(CUTS)), np.int32), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(begin) for _, begin in parts])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _language_table() -> np.ndarray:
    table = np.zeros(BUCKETS, np.int8)
    for k, words in enumerate(LANGUAGES.values()):
        ids, _ = _features(pa.array([words]))
        table[ids[: len(words.split()), 0]] = k + 1
    table[0] = 0
    return table


def _languages(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per text the language whose function words are most frequent, 0 where there is none."""
    found = _language_table()[ids[:, 0]]
    which = np.flatnonzero(found)
    doc = np.searchsorted(begin, which, side="right") - 1
    kinds = len(LANGUAGES) + 1
    counts = np.bincount(doc * kinds + found[which], minlength=kinds * (len(begin) - 1)).reshape(-1, kinds)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), 0)


def _top(z: np.ndarray) -> np.ndarray:
    """The three largest of each column, 0 at least, largest first."""
    if len(z) < 3:
        z = np.concatenate([z, np.zeros((3 - len(z), z.shape[1]), z.dtype)])
    return np.maximum(0, np.sort(np.partition(z, len(z) - 3, axis=0)[-3:], axis=0)[::-1])


class Model:
    """emb (bucket, dim), w (dim, width and shift, filter), bias (width, filter), out and base (logistic), cut (language)."""

    FIELDS = ("emb", "w", "bias", "out", "base", "cut")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{k: getattr(self, k) for k in self.FIELDS})
        return f.getvalue()

    @classmethod
    def load(cls, body: bytes) -> Model:
        with np.load(io.BytesIO(body)) as f:
            return cls(**{k: f[k] for k in cls.FIELDS})

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings, and every filter's response at every position: (position, width, filter)."""
        x = self.emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.emb[ids[:, k]]
        y = (x @ self.w.reshape(DIMS, -1)).reshape(len(x), len(_SHIFTS), FILTERS)
        z = np.repeat(self.bias[None], len(x), axis=0)
        for k, (w, o) in enumerate(_SHIFTS):
            z[: len(x) - o, WIDTHS.index(w)] += y[o:, k]
        return x, z

    def pooled(self, ids: np.ndarray, begin: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """The largest and the third largest response of each filter in each text, 0 at least; whole texts, in steps."""
        out = np.zeros((len(begin) - 1, 2, len(WIDTHS) * FILTERS), np.float32)
        pad = max(WIDTHS) - 1
        k = 0
        while k < len(begin) - 1:
            e = max(k + 1, int(np.searchsorted(begin, begin[k] + step, side="right")) - 1)
            s, t = int(begin[k]), int(begin[e])
            if e > k + 1 or t - s <= step:
                z = self.responses(ids[s:t])[1].reshape(t - s, -1)
                for d in range(k, e):
                    out[d] = _top(z[begin[d] - s : begin[d + 1] - pad - s])[::2]
            else:
                best = np.zeros((0, out.shape[2]), np.float32)
                for a in range(s, t - pad, step):
                    n = min(step, t - pad - a)
                    best = _top(np.concatenate([best, self.responses(ids[a : a + n + pad])[1].reshape(-1, out.shape[2])[:n]]))
                out[k] = best[::2]
            k = e
        return out.reshape(len(out), 2 * len(WIDTHS) * FILTERS)

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.pooled(ids, begin) @ self.out + self.base[0]

    def scores(self, column) -> np.ndarray:
        ids, begin = _features(column)
        if len(begin) < 2:
            return np.zeros(0)
        over = self.logits(ids, begin).astype(np.float64) - self.cut[_languages(ids, begin)]
        return 1 / (1 + np.exp(-np.clip(over + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """The middle of the widest gap between cuts of the best F1."""
    order = np.argsort(-logits, kind="stable")
    s, y = logits[order], labels[order]
    if not y.any() or y.all():
        return None
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    below = np.append(s[1:], s[-1] - 1)
    f1[s == below] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((s - below)[best])]
    return float(s[k] - 0.5 * min(s[k] - below[k], 8.0))


def train(column, labels: np.ndarray, seed: int = 0) -> Model:
    """Fits on four fifths of the rows and calibrates on the others."""
    rng = np.random.default_rng(seed)
    ids, begin = _all_features(column)
    n = len(labels)
    apart = rng.permutation(n) % 5 == 0
    fit = np.flatnonzero(~apart)
    prior = np.zeros(BUCKETS)
    if (labels[fit] == 1).any() and (labels[fit] == 0).any():
        pos, neg = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in np.array_split(fit, max(1, len(fit) // 256)):  # in how many texts of either label a bucket occurs
            words = np.concatenate([ids[begin[d] : begin[d + 1]] for d in part])
            own = np.repeat(np.arange(len(part)), np.diff(begin)[part])
            seen = np.unique((own[:, None] * BUCKETS + words).ravel())
            toxic = labels[part][seen // BUCKETS] == 1
            pos += np.bincount(seen[toxic] % BUCKETS, minlength=BUCKETS)
            neg += np.bincount(seen[~toxic] % BUCKETS, minlength=BUCKETS)
        n_pos, n_neg = (labels[fit] == 1).sum(), (labels[fit] == 0).sum()
        rate = (pos + neg + 0.5) / (len(fit) + 1)
        odds = np.log((pos + rate) / (n_pos + 1)) - np.log((neg + rate) / (n_neg + 1))
        prior = np.clip(odds, -3, 8) * pos / (pos + 4)
    emb = rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32)
    emb[:, 0] = 0.25 * prior  # word evidence to start from; training moves it
    emb[0] = 0
    w = rng.normal(0, 0.1, (DIMS, len(_SHIFTS), FILTERS)).astype(np.float32)
    for k, (width, _) in enumerate(_SHIFTS):
        w[0, k, : FILTERS // 2] = 1 / width
    model = Model(emb=emb, w=w, bias=np.zeros((len(WIDTHS), FILTERS), np.float32), out=np.full(2 * len(WIDTHS) * FILTERS, 0.75 / (len(WIDTHS) * FILTERS), np.float32), base=np.array([-2.0], np.float32), cut=np.zeros(len(LANGUAGES) + 1))
    grads = {k: np.full(getattr(model, k).shape, 1e-3, np.float32) for k in ("emb", "w", "bias", "out", "base")}

    def move(name: str, grad: np.ndarray, rows=slice(None)) -> None:
        grads[name][rows] += grad * grad
        getattr(model, name)[rows] -= RATE * grad / np.sqrt(grads[name][rows])

    weight = np.where(labels == 1, 1.0, max(0.2, (labels == 1).sum() / max(1, (labels == 0).sum())))
    pad = max(WIDTHS) - 1
    for _ in range(EPOCHS if n else 0):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            batch = batch[np.diff(begin)[batch] > pad]
            if not len(batch):
                continue
            parts = [ids[begin[d] : begin[d + 1]] for d in batch]
            x, z = model.responses(np.concatenate(parts))
            at = np.cumsum([0, *map(len, parts)])
            flat = z.reshape(len(z), -1)
            peak = []  # (text, largest or third, filter): where
            for first, end in zip(at, at[1:] - pad):
                own = flat[first:end]
                top = np.argpartition(own, len(own) - 3, axis=0)[-3:] if len(own) > 3 else np.tile(np.arange(len(own))[:, None], own.shape[1])
                order = np.argsort(-np.take_along_axis(own, top, axis=0), axis=0, kind="stable")[[0, min(2, len(own) - 1)]]
                peak.append(first + np.take_along_axis(top, order, axis=0))
            peak = np.stack(peak).reshape(len(batch), -1)
            pool = np.maximum(0, flat[peak, np.tile(np.arange(flat.shape[1]), 2)])
            p = 1 / (1 + np.exp(-np.clip(pool @ model.out + model.base[0], -30, 30)))
            g = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g_pool = (g[:, None] * model.out[None] * (pool > 0)).reshape(len(batch), 2, len(WIDTHS), FILTERS)
            g_w, touched, g_x = np.zeros_like(model.w), [], []
            for k, (width, o) in enumerate(_SHIFTS):
                i = WIDTHS.index(width)
                spot = peak.reshape(len(batch), 2, len(WIDTHS), FILTERS)[:, :, i] + o
                gk = g_pool[:, :, i]
                g_w[:, k] = np.einsum("bhf,bhfd->df", gk, x[spot])
                touched.append(spot.ravel())
                g_x.append((gk[..., None] * model.w[:, k].T[None]).reshape(-1, DIMS))
            rows = np.concatenate(parts)[np.concatenate(touched)]
            u, inverse = np.unique(rows, return_inverse=True)
            g_emb = np.zeros((len(u), DIMS), np.float32)
            np.add.at(g_emb, inverse.reshape(rows.shape), np.concatenate(g_x)[:, None])
            g_emb[u == 0] = 0
            move("out", pool.T @ g)
            move("base", g.sum(keepdims=True))
            move("bias", g_pool.sum(axis=(0, 1)))
            move("w", g_w)
            move("emb", g_emb, u)
    logits, lang = model.logits(ids, begin), _languages(ids, begin)
    check = np.flatnonzero(apart)
    general = _best_cut(logits[check], labels[check])
    general = general if general is not None else (_best_cut(logits, labels) or 0.0)
    for k in range(len(LANGUAGES) + 1):
        own = check[lang[check] == k]
        own_cut, n_toxic = _best_cut(logits[own], labels[own]), (labels[own] == 1).sum()
        model.cut[k] = general if own_cut is None else (n_toxic * own_cut + 10 * general) / (n_toxic + 10)
    return model


def sample(docs: DataFrame, labels: DataFrame, held_out, seed: int = 0) -> DataFrame:
    """doc_id, text and toxic of the rows to train on: of at most TRAIN_TOXIC and TRAIN_CLEAN labelled doc_ids, chosen by hash,
    those whose texts, in the order of a second hash, take at most TRAIN_BYTES in all; equal hashes by doc_id.

    Texts of more than TRAIN_TEXT_BYTES aren't trained on, so one can't keep the others out. Of several rows of a doc_id that
    of the smallest text counts, so repeated rows don't add up."""
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    take = lambda y, n: own.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    rows = texts.join(take(1, TRAIN_TOXIC).unionByName(take(0, TRAIN_CLEAN)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    order = W.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)  # a bounded sample
    rows = rows.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).filter(F.col("so_far") <= TRAIN_BYTES)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, held_out, seed: int = 0) -> bytes:
    """A model of rows of docs with a label in labels (doc_id, toxic) whose doc_id isn't held out (a Column's test).

    Trained on a bounded sample() of them. Where labels of a doc_id differ it is toxic. Null ids and labels other than 0 and 1
    take no part, null texts are empty. Without labels of rows of docs, a model that finds nothing toxic; where there are some
    but all of texts too long to train on, an error. Other columns don't matter."""

    def run(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        yield pa.RecordBatch.from_arrays([pa.array([train(t.column("text"), t.column("toxic").to_numpy(), seed).dump()], pa.binary())], ["model"])
        del t
        release()

    found = sample(docs, labels, held_out, seed).repartition(1).mapInArrow(run, "model binary").first()
    if found:
        return bytes(found[0])
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(~held_out).join(docs.select("doc_id"), "doc_id", "left_semi")
    if not known.isEmpty():
        raise ValueError(f"all labelled texts have more than {TRAIN_TEXT_BYTES} bytes")
    return train(pa.array([], pa.string()), np.zeros(0, np.int32)).dump()


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with toxicity, a score from 0 to 1, appended (a column of that name is replaced).

    Null and empty texts score as texts without words; very long ones are scored whole, in steps of bounded memory. Repeated
    rows score alike. Rows, nulls and other columns stay as they are; no rows: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")
    at = docs.columns.index("text")
    loaded: list[Model] = []

    def run(batches):
        if not loaded:
            loaded.append(Model.load(shared.value))
        for b in by_bytes(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(loaded[0].scores(b.column(at)), pa.float64())], [*b.schema.names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))
