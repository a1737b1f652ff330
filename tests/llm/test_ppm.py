import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import ppm
from pointloom.llm.queries import op6_lm_scoring

TEXTS = [None, "", "abracadabra", "Abra cadabra", "the cat sat on the mat", "THE\u000bcat sat", "é ü naïve 中文", "the the the the", "x" * 3000, "zq!", "a rose is a rose is a rose", " \n\t ", "the cat sat on the mat", "never seen words"] * 3


def plain_model(texts):
    """counts[context][symbol] for all contexts of 0 to 4 symbols."""
    counts = defaultdict(Counter)
    for t in texts:
        s = [0xFE] * 4 + list((t or "").encode().translate(bytes(ppm._LOWER))) + [0xFF]
        for i in range(4, len(s)):
            for n in range(5):
                counts[tuple(s[i - n : i])][s[i]] += 1
    return counts


def plain_probability(counts, context, symbol):
    p, out = 1.0, set()
    for n in range(4, -1, -1):
        node = counts.get(tuple(context[4 - n :]))
        if not node:
            continue
        live = {s: c for s, c in node.items() if s not in out}
        total, kinds = sum(live.values()), len(live)
        if symbol in live:
            return p * live[symbol] / (total + kinds)
        if kinds:
            p *= kinds / (total + kinds)
        out |= set(node)
    return p / (256 - len(out))


def plain_score(counts, text):
    s = [0xFE] * 4 + list((text or "").encode().translate(bytes(ppm._LOWER))) + [0xFF]
    return sum(math.log10(plain_probability(counts, s[i - 4 : i], s[i])) for i in range(4, len(s)))


@pytest.mark.parametrize("group_bytes,parts,fan_in", [(1 << 24, 1 << 10, 64), (300, 5, 3)])
def test_equals_plain_model(spark, tmp_path, monkeypatch, group_bytes, parts, fan_in):
    monkeypatch.setattr(ppm.scores, "__defaults__", (group_bytes, parts, fan_in))
    rows = list(enumerate(TEXTS)) + [(None, "abc"), (3, "same id"), (2, "abracadabra")]
    spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, row int, grp string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    train = [t for d, t in rows if learn(d)]
    model = plain_model(train)
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    term = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted(((d, not learn(d) if d is not None else True, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(map(term, [*words(t), None])), plain_score(model, t)) for d, t in rows), key=repr)
    got = sorted((tuple(r) for r in op6_lm_scoring(spark, str(tmp_path)).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_probabilities_sum_to_one():
    model = plain_model(t for t in TEXTS if t)
    for context in ([0x74, 0x68, 0x65, 0x20], [1, 2, 3, 4], [0xFE] * 4, [1, 1, 1, 0x61]):
        total = sum(plain_probability(model, context, s) for s in range(256))
        assert abs(total - 1) < 1e-9


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert ppm.scores(docs.limit(0), F.lit(True)).count() == 0
    r = ppm.scores(docs, F.lit(False)).first()
    assert abs(r.score - 3 * math.log10(1 / 256)) < 1e-9 and (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert abs(r.base_score - 2 * math.log10(0.1 / 0.1)) < 1e-9


def thue_morse(n, letters):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_confuse_are_counted_apart(spark, n):
    a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
    docs = spark.createDataFrame([(1, f"{a} {a}"), (2, b)], "doc_id long, text string")
    known = {r.doc_id: r.n_known for r in ppm.scores(docs, F.col("doc_id") == 1).collect()}
    assert known == {1: 3, 2: 1}  # of the second text only the end


def test_repeated_rows_are_spread(spark):
    docs = spark.range(64).selectExpr("7L AS doc_id", "'the same text again' AS text")
    rows = ppm.scores(docs, F.lit(True), 100).collect()
    assert len(rows) == 64 and len({r.score for r in rows}) == 1
    assert rows[0].train_tokens == 64 * 5
