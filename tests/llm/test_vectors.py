import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import ann, topk, vectors
from pointloom.llm.queries import op3_topk, op5_ann

NAN, INF = float("nan"), float("inf")


def table(spark, rows, path=None):
    df = spark.createDataFrame([(i, e, "s", 1) for i, e in rows], "vec_id long, embedding array<float>, score string, block int")
    if path:
        df.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return df


def rows_of(seed, n=400, dim=8):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[50:120] = x[50]  # one very common vector
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(10_000, None), (11_000, [NAN] * dim), (12_000, [INF] + [0.0] * (dim - 1)), (13_000, [0.0] * dim), (13_001, [None] * dim), (None, x[0].tolist()), (14_000, []), (15_000, [1.0, 2.0]), (15_001, [2.0, 1.0])]
    return out + odd + [out[0], out[3]]


def usable(rows, zero):
    kept = {}
    for i, e in rows:
        if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e) and (zero or any(e)):
            kept.setdefault(i, e)
    return kept


def brute(rows, every, k, score, zero):
    v = usable(rows, zero)
    out = []
    for q in v:
        if q % every:
            continue
        best = sorted((score(v[q], e), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = rows_of(1)
    table(spark, rows, tmp_path)
    product = lambda a, b: -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    want = [(q, n, i, -s) for q, n, i, s in brute(rows, 50, 5, product, True)]
    for vectors_, least, part in ((1 << 20, 1 << 14, 8192), (37, 37, 20)):
        monkeypatch.setattr(topk, "SHARD_BYTES", 64 * vectors_)
        monkeypatch.setattr(topk, "LEAST_BYTES", 64 * least)
        monkeypatch.setattr(topk, "TILE_BYTES", 64 * least)
        monkeypatch.setattr(topk, "PART", part)
        got = sorted(tuple(r) for r in op3_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
        assert got == sorted(want)
    assert topk.top_products(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_large_products_are_exact():
    a = np.array([[2.0**28 + 1, 2.0**28 - 1]])
    _, _, s = topk.tile_top(a, np.array([1]), a, np.array([2]), 5)
    assert s.tolist() == [(2**28 + 1) ** 2 + (2**28 - 1) ** 2]
    assert topk.tile_top(16 * a, np.array([1]), 16 * a, np.array([2]), 5)[2].tolist() == [topk.OVER]
    assert topk.tile_top(16 * a, np.array([1]), -16 * a, np.array([2]), 5)[2].tolist() == [topk.UNDER]


def test_large_rows_equal_whole_numbers():
    r = np.random.default_rng(3)
    for big_q, big_s in ((0, 0), (3, 0), (40, 0), (0, 3), (0, 40)):
        q, s = (np.floor(r.uniform(-(2.0**20), 2.0**20, (40, 4))) for _ in range(2))
        q[r.permutation(40)[:big_q]] *= 2.0**21
        s[r.permutation(40)[:big_s]] *= 2.0**21
        i, j, got = topk.tile_top(q, np.arange(40), s, np.arange(20, 60), 5)
        for x in range(40):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(q[x], s[y])), y) for y in range(40) if y + 20 != x)[:5]
            assert sorted(zip((-got[i == x]).tolist(), j[i == x].tolist()))[:5] == want


def test_one_large_vector_takes_part(spark):
    """Products of one pair fit though the larger vector's own with itself doesn't; only a wanted score that doesn't fit is an error."""
    rows = [(0, [2.5e12, 1.0]), (1, [3.0, 2.0]), (2, [-5.0, 1.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {d: [int(256 * x) for x in e] for d, e in rows}
    want = [(q, n, b, s) for q in (0, 50) for n, (s, b) in enumerate(sorted(((sum(x * y for x, y in zip(v[q], v[b])), b) for b in v if b != q), key=lambda t: (-t[0], t[1])), 1)]
    assert sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()) == want
    low = spark.createDataFrame([*rows[1:], (3, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert len(topk.top_products(low, F.col("vec_id") == 50, k=2).collect()) == 2  # too low to matter
    for k, e in ((3, low), (1, spark.createDataFrame([*rows[1:], (3, [1e30, 0.0])], "vec_id long, embedding array<double>"))):
        with pytest.raises(Exception, match="64-bit"):
            topk.top_products(e, F.col("vec_id") == 50, k=k).collect()


def test_ann_recall_and_distances(spark, tmp_path, monkeypatch):
    rows = rows_of(2, 3000, 16)
    table(spark, rows, tmp_path)
    dist = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(np.float32(a).astype(float), np.float32(b).astype(float))))
    want = brute(rows, 100, 10, dist, False)
    for shard in (8192, 500):
        monkeypatch.setattr(ann, "SHARD_BYTES", 128 * shard)
        monkeypatch.setattr(ann, "LEAST_BYTES", 128 * shard)
        monkeypatch.setattr(ann, "TILE_BYTES", 128 * 16)
        got = op5_ann(spark, str(tmp_path)).collect()
        pairs = {(r.query_id, r.vec_id) for r in got}
        assert len(pairs) == len(got) == len(want)
        assert len(pairs & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
        v = usable(rows, False)
        for q in {r.query_id for r in got}:
            own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
            assert [n for n, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
            assert all(abs(s - dist(v[q], v[i])) < 1e-12 for _, s, i in own)
    assert ann.search(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_merge_tree(spark):
    r = np.random.default_rng(3)
    rows = [(int(q), int(s * 100 + i), int(r.integers(0, 50)), s, 40) for q in range(3) for s in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, score long, shard long, shards long")
    got = sorted(tuple(x) for x in vectors.merged(df, 5, "CASE WHEN x.score > y.score THEN -1 WHEN x.score < y.score THEN 1 ELSE cast(x.vec_id - y.vec_id as int) END", fan_in=3).collect())
    want = []
    for q in range(3):
        best = sorted((-s, i) for a, i, s, _, _ in rows if a == q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
