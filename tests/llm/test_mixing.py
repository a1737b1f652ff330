import random
from math import comb

import pytest
from pyspark.sql import functions as F

from pointloom.llm import mixing as M
from pointloom.llm.queries import op7_mixing


def plain_targets(sizes):
    """By source (None last): water-filling of the total by weights 1, 2, 3 under caps of 3 times each size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for n in range(900):
        source = r.choice(["hot"] * 12 + ["a", "b", "B", "é", None, "tiny" if n % 9 == 0 else "c", "", "long"])
        size = r.choice([0, 1, 5, 30, 100]) if source != "tiny" else 2
        rows.append((n if n % 50 else None, " \t".join(["w"] * size) if n % 31 else None, source))
    rows += [(7, "x " * 20_000, "long"), (8, "one\u000btwo x", "c")] + rows[3:9] + [(901, "", "void")]
    return rows


@pytest.mark.parametrize("block_words,shard_words", [(1 << 16, 1 << 22), (200, 700)])
def test_targets_and_takes(spark, tmp_path, block_words, shard_words):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, sid long")
    words = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = plain_targets(sizes)
    got = M.assign(docs, block_words=block_words, shard_words=shard_words).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(((d, s, words(t)) for d, t, s in rows), key=repr)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert len(r.copies) <= 3 and len({c["copy"] for c in r.copies}) == len(r.copies)
        taken[r.source] = taken.get(r.source, 0) + r["size"] * len(r.copies)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(120, 0.01 * target[s]) or s == "long"
    again = M.assign(docs.repartition(7), block_words=block_words, shard_words=shard_words).collect()
    key = lambda rs: sorted(((r.doc_id, r.source, r["size"], [tuple(c) for c in r.copies]) for r in rs), key=repr)
    assert key(got) == key(again)
    mixed = M.mix(docs, block_words=block_words, shard_words=shard_words)
    assert mixed.columns == ["doc_id", "text", "source", "sid", "copy", "shard", "pos"]
    assert mixed.count() == sum(len(r.copies) for r in got)


@pytest.mark.parametrize("population,good,drawn", [(20_000, 300, 8), (20_000, 8, 300), (700, 350, 300), (50, 49, 25), (5, 5, 3), (9, 0, 4), (4000, 1000, 2000)])
def test_variates_are_hypergeometric(spark, population, good, drawn):
    """The share of evenly spaced uniforms that give each value is its probability."""
    n = 4000
    units = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    rows = units.select(F.expr(M.hypergeometric(f"{population}L", f"{good}L", f"{drawn}L", "u")).alias("h")).groupBy("h").count().collect()
    exact = {h: comb(good, h) * comb(population - good, drawn - h) / comb(population, drawn) for h in range(max(0, drawn - population + good), min(good, drawn) + 1)}
    assert {r.h for r in rows} <= set(exact) and sum(r["count"] for r in rows) == n
    got = {r.h: r["count"] / n for r in rows}
    assert all(abs(got.get(h, 0) - p) <= 1.01 / n for h, p in exact.items())


def test_shards_are_even_and_quotas_exact(spark):
    quotas = spark.createDataFrame([(1, 5000), (2, 700), (3, 40), (4, 0), (5, 1)], "sid long, k long")
    rows = M.split_tree(quotas, 4, 9).collect()
    total, by_source, by_shard = 5741, {}, {}
    for r in rows:
        assert r.k >= 0
        by_source[r.sid] = by_source.get(r.sid, 0) + r.k
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.k
    assert by_source == {1: 5000, 2: 700, 3: 40, 4: 0, 5: 1}
    assert set(by_shard) == set(range(16)) and set(by_shard.values()) <= {total // 16, total // 16 + 1}
    spread = [r.k for r in rows if r.sid == 2]
    assert 25 <= min(spread) and max(spread) <= 65  # 43.75 each, standard deviation about 6


def test_query_on_empty_and_null(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_mixing(spark, str(tmp_path)).count() == 0
    r = M.assign(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(x.doc_id, x["size"], x.target, x.copies) for x in r] == [(1, 0, 0.0, [])]


@pytest.mark.parametrize("seed", range(4))
def test_documents_that_do_not_fit_are_made_up_for(spark, seed):
    """Documents longer than what an extra copy has to take, among short ones that can fill it exactly."""
    rows = [(n, "x " * 4000, "a") for n in range(6)] + [(10 + n, "x " * (1 + n % 3), "a") for n in range(1500)] + [(5000, "x " * 20_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.assign(docs, weights=(1, 15), block_words=500, shard_words=4000, seed=seed).collect()
    taken = sum(r["size"] * len(r.copies) for r in got if r.source == "a")
    target = next(r.target for r in got if r.source == "a")
    assert 2500 < target < 3900 and abs(taken - target) <= 1
    assert all(len({c["copy"] for c in r.copies}) == len(r.copies) for r in got)


def test_null_ids_and_texts_without_words_fill_many_blocks(spark):
    """A block's rows go to one task: neither null ids nor rows of no words may gather in one."""
    rows = [(None, f"w{n} " * 4, "nulls") for n in range(4000)] + [(n, None if n % 2 else " ", "void") for n in range(4000)] + [(9000, "x " * 4000, "rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []

    def counted(blocks, *args):
        seen.append(blocks.groupBy("sid").count().collect())
        return draws(blocks, *args)

    draws, M._draws = M._draws, counted
    try:
        got = M.assign(docs, block_words=1000, shard_words=4000).collect()
    finally:
        M._draws = draws
    assert {r.sid: r["count"] for r in seen[0]} == {1: 16, 2: 1, 3: 4}
    nulls = [r for r in got if r.source == "nulls"]
    assert len(nulls) == 4000 and abs(sum(r["size"] * len(r.copies) for r in nulls) - nulls[0].target) <= 4
