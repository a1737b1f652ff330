import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import token_align as t


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = t.default_tokenizers()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in printable)}
    return first, sentencepiece.SentencePieceProcessor(model_file=b), byte


def groups_of(text, tools):
    """Groups of a text by walking both sequences."""
    first, second, byte = tools
    if not text:
        return None
    coded = first.encode(" " + text, add_special_tokens=False)
    a = [(k, bytes(byte[c] for c in s)) for k, s in zip(coded.ids, coded.tokens)]
    pieces = [(k, second.id_to_piece(k)) for k in second.encode(text)]
    b = [(k, bytes([int(s[3:5], 16)]) if second.is_byte(k) else s.replace("▁", " ").encode()) for k, s in pieces]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            groups[-1][0].append(a[i][0])
            at_a, i = at_a + len(a[i][1]), i + 1
        else:
            groups[-1][1].append(b[j][0])
            at_b, j = at_b + len(b[j][1]), j + 1
        if at_a == at_b and groups[-1][0] and groups[-1][1] and (i < len(a) or j < len(b)):
            groups.append(([], []))
    return groups


def plain(rows, tools):
    made = [groups_of(text, tools) for _, text in rows]
    links = [[(x, y) for g in m or () for x in g[0] for y in g[1]] for m in made]
    count = Counter(pair for own in links for pair in set(own))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc_id, _), m, own in zip(rows, made, links):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in m) if m else None
        out.append((doc_id, sum(len(g[0]) for g in m or ()), sum(len(g[1]) for g in m or ()), len(m or ()), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if m else ""))
    return out


def test_equals_walking_both_sequences(spark, tools, monkeypatch):
    r = random.Random(13)
    texts = ["", None, " ", "a", "\n", "  two  spaces\n\n\nlines\t\ttabs ", "é́🙂日本語 中文", "▁ is a sign of B", "<s>x</s><unk><0x41>", "a<|endoftext|>b", "\x00nul", "İstanbul ﬁ Å", "x" * 3000, " " * 5000, "🙂" * 900, "1234567890" * 30, "\r\n\r\n" * 50]
    words = ["the", " of", "tion", "é", "Straße", "123", "\n", "🙂", "日本", "  ", ",", "don't", "ing"]
    texts += ["".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randrange(1, 200))) for _ in range(150)]
    rows = [(n, x) for n, x in enumerate(texts)] + [(None, "no id"), (None, "no id"), (3, "another text of three"), (20, texts[20]), (20, texts[20])]
    monkeypatch.setattr(t, "BLOCK_BYTES", 4000)
    df = spark.createDataFrame([(*x, "s", 5) for x in rows], "doc_id long, text string, block string, n_a int").repartition(5)
    got = sorted((tuple(x) for x in t.align(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == sorted(plain(rows, tools), key=repr)
    assert sum(x[-1] == "" for x in got) >= 3
    assert t.align(df.limit(0)).count() == 0


def test_wide_groups_count_as_narrow_ones(monkeypatch):
    r = np.random.default_rng(1)
    n_a, n_b = r.integers(1, 60, 40), r.integers(1, 60, 40)
    a, b = r.integers(0, 9, n_a.sum()), r.integers(0, 9, n_b.sum())
    want = t.links(a, b, n_a, n_b)
    monkeypatch.setattr(t, "WIDE", 100)
    for x, y in zip(want, t.links(a, b, n_a, n_b)):
        assert np.array_equal(x, y)
    assert want[1].sum() == (n_a * n_b).sum()


def test_labels_and_spans():
    label = t.labels(np.array([1, 2, 3]), np.array([3, 1, 2]))
    assert list(label) == [1, 0, 3, 2, 0, 3]
    assert [x.tolist() for x in t.group_sizes(label)] == [[2, 1], [1, 2]]


def test_long_white_space(tools):
    m = t.models(*t.default_tokenizers())
    text = "a" + " " * 600_000 + "b"
    a, b = next(m.encode([text]))
    assert a.tolist() == tools[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == tools[1].encode(text)
