import random

import numpy as np
import pytest

from pointloom.llm import ngram_join as J
from pointloom.llm.queries import op1_ngram_join


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k]):
                root[find(i)] = find(k)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    """Copies edited a little or much, a passage that many share, exact copies, short and empty texts, repeated rows."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(60))
    texts = [None, "", " \t\n", "one", "One", "a b c d", "A b\u000bc d", "é a b c d e", "É a b c d e"]
    common = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 20, 80, 200]))]
        for _ in range(r.choice([1, 3, 12])):
            copy = [word() if r.random() < r.choice([0, 0.01, 0.03]) else w for w in base]
            texts.append(" ".join(copy))
    texts += [" ".join(common + [word() for _ in range(r.choice([3, 8, 20, 60]))]) for _ in range(25)]
    texts += ["\n".join(common)] * 10 + ["x " * 3000 + "y", "x " * 3000 + "y"]
    r.shuffle(texts)
    rows = [(n if n % 17 else None, t) for n, t in enumerate(texts)]
    return rows + rows[:6] + [(5, "some other text of the same id as a row before")]


@pytest.mark.parametrize("seed,cells,salts,told", [(1, 1 << 11, 1 << 18, 1 << 22), (2, 4, 3, 10)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, cells, salts, told):
    monkeypatch.setattr(J, "FILTER_TEXTS", told)
    monkeypatch.setattr(J, "CELL_SETS", cells)
    monkeypatch.setattr(J, "SALT_SETS", salts)
    rows = corpus(seed)
    spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, slice string, component long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in op1_ngram_join(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.85, 0.9, 1])], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert J.verified(a, b) == (union > 0 and 100 * both >= 75 * union and len(b) > 0)
        if len(b) and J.linked(both, union):
            shared = np.intersect1d(a[: J.prefix_length(len(a))], b[: J.prefix_length(len(b))])
            assert len(shared)
            pa, pb = np.searchsorted(a, shared[0]), np.searchsorted(b, shared[0])
            assert J._may_link(*map(np.array, (len(a), pa, len(b), pb)))


def test_without(spark):
    docs = spark.createDataFrame([(i % 50 if i % 9 else None, f"t{i}") for i in range(200)], "doc_id long, text string")
    gone = {3, 7, 44}
    got = sorted(map(tuple, J.without(docs, spark.createDataFrame([(g,) for g in gone], "doc_id long")).collect()), key=repr)
    assert got == sorted((tuple(r) for r in docs.collect() if r.doc_id not in gone), key=repr)
    assert J.without(docs, docs.select("doc_id").limit(0)).count() == 200


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse_are_different(spark, n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    docs = spark.createDataFrame([(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.near_duplicates(docs).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("told", [1, 1 << 22])
def test_without_keeps_the_others_either_way(spark, monkeypatch, told):
    monkeypatch.setattr(J, "FILTER_TEXTS", told)
    docs = spark.createDataFrame([(None, "x"), (1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, text string")
    left = J.without(docs, spark.createDataFrame([(1,), (3,), (None,)], "doc_id long"))
    assert sorted(map(str, left.select("text").toPandas()["text"])) == ["c", "x"]


def test_counts_do_not_begin_again():
    a = np.array([4_000_000_000, 5], np.uint32)
    J.saturating(a, a, out=a)
    assert a.tolist() == [2**32 - 1, 10]


@pytest.mark.parametrize("told", [0, 1 << 22])
def test_repeated_rows_are_verified_once(spark, monkeypatch, told):
    """Two near copies, each in 200 rows of 16 partitions, one of them of null doc_id: one pair, verified once."""
    monkeypatch.setattr(J, "FILTER_TEXTS", told)
    words = [f"w{n}" for n in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (None, " ".join(words[:-1] + ["other"]))] * 200, "doc_id long, text string").repartition(16)
    seen, plain = [], J._verify

    def counted(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(J, "_verify", counted)
    got = {tuple(r) for r in J.near_duplicates(docs).collect()}
    assert got == {(1, 96, 1), (None, 96, 1)} and sum(x.count() for x in seen) == 1
