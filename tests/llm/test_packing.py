import zlib

import numpy as np
import pytest

from pointloom.llm import packing as P
from pointloom.llm.queries import op4_packing

TEXTS = [None, "", "hello world", "<|endoftext|> is text <|endoftext|>x", "é ü\t\n  naïve 中文 " * 900, "a" * 5000, "x y " * 4000, "hello world", "   1234567 don't '", " " * 30_000]


def reference(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def verify(rows, texts, capacity=2048):
    want = {n: ids for n, ids in enumerate(reference(texts))}
    got, seqs = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got) == sorted(want)
    for n, ids in want.items():
        own = sorted(got[n], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert all(r.length == capacity for r in own[1:]) and own[0].length <= capacity and len(own) == -(-len(ids) // capacity)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(map(len, want.values()))


def test_ids_and_cuts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, total = verify(op4_packing(spark, str(tmp_path)).collect(), TEXTS)
    assert n <= -(-total // 2048) + 1


def test_rounds_and_repeats(spark):
    """Several chunks, repeated rows and clashing columns: every row once, few more sequences than the bound."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 1500).tolist() + [700] * 300
    df = spark.createDataFrame([(None, n, 9, "x") for n in lengths], "doc_id long, length long, offset long, chunk string")
    rows = P.pack(df, chunk_pieces=256).collect()
    assert rows[0].__fields__ == ["doc_id", "length", "chunk", "sequence_id", "offset"] and {r.chunk for r in rows} == {"x"}
    assert sorted(r.length for r in rows) == sorted(lengths)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    plain, room = np.full(len(lengths), -1, np.int32), []
    P.best_fit(np.argsort(-np.array(lengths), kind="stable").tolist(), lengths, plain, room, 2048)
    assert P.bound(np.array(lengths), 2048) <= len(seqs) <= 1.01 * len(room)  # best-fit decreasing over all pieces at once
    assert P.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_crossover_keeps_every_item(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 1500, 300)
    pop = P.evolve(n, [], 2048, rng)
    for x in [*pop, P.crossover(pop[0], pop[-1], n, n.tolist(), 2048, rng), P.mutate(pop[0], n, n.tolist(), 2048, rng)]:
        f = P.fills(x, n)
        assert f.max() <= 2048 and f.min() > 0 and x.min() == 0


def test_emptiest_bins_of_all_chunks_meet(spark):
    cut = spark.range(200).selectExpr("id", "40 AS length")
    rows = P.pack(cut, capacity=100, chunk_pieces=9).collect()
    assert sorted(r.id for r in rows) == list(range(200))
    assert len({r.sequence_id for r in rows}) <= 101


@pytest.mark.parametrize("low,high,gain", [(500, 1100, 0.03), (300, 900, 0.015)])
def test_evolution_beats_best_fit(low, high, gain):
    """Lengths that best fit packs badly: offspring of several islands' elites need clearly fewer bins."""
    n = np.random.default_rng(7).integers(low, high + 1, 2000)
    plain, room = np.full(len(n), -1, np.int32), []
    P.best_fit(np.argsort(-n, kind="stable").tolist(), n.tolist(), plain, room, 2048)
    first = P.evolve(n, [], 2048, np.random.default_rng(1))
    other = P.evolve(n, [], 2048, np.random.default_rng(2))
    moved = P.evolve(n, [*first, other[0]], 2048, np.random.default_rng(3))
    bins = lambda x: int(x.max()) + 1
    assert P.bound(n, 2048) <= bins(moved[0]) <= min(bins(first[0]), bins(other[0])) <= (1 - gain) * len(room)
    assert P.fitness(moved[0], n, 2048) >= P.fitness(first[0], n, 2048)


def test_bound_equals_plain_one():
    rng = np.random.default_rng(3)
    for low, high in ((1, 100), (40, 70), (50, 100), (26, 49)):
        n = rng.integers(low, high + 1, 60)
        best = 0
        for k in range(51):
            one, two, three = n[n > 100 - k], n[(n > 50) & (n <= 100 - k)], n[(n >= k) & (n <= 50)]
            best = max(best, len(one) + len(two) + max(0, -((len(two) * 100 - int(two.sum()) - int(three.sum())) // 100)))
        assert P.bound(n, 100) == best


def test_ids_equal_the_tokenizers():
    """Odd white space, scripts, emoji and the special token, in many short random texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(11)
    parts = [" ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u200b", "\x1c", "\x85", "a", "B", "word", "don't", "I'LL", "'s", "9", "1234", "é", "ñ", "中文", "العربية", "👍🏽", "👩‍👩‍👧", "\ufeff", "<|endoftext|>", "<|end", "_", "-", "...", "\u0301", "ǅ", "Ⅷ", "²"]
    for _ in range(6000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert P.token_ids(text, path).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
