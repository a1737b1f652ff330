import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import fim

MARKS = fim.SENTINELS


def plain(doc_id, text, seed=1, rate=90, spm=20):
    """The transformation by slices of one string."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return doc_id, len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(text), form, len(p), len(m), out


def test_equals_slices(spark):
    r = random.Random(3)
    texts = ["", None, "a", "<", "<P", "x<S>y", "ab<M>", "é́🙂\r\n" * 50, "<P" * 40, "S>" * 40, "z" * 300_000, "\x00 <", "<<<S"]
    rows = [(n, texts[n % len(texts)] if n < 60 else "".join(r.choice("ab<PSM>é🙂\n ") for _ in range(r.randrange(3000)))) for n in range(300)]
    rows += [(None, "no id"), (None, "no id"), (7, "another text of seven"), rows[0], rows[70], rows[70]]
    df = spark.createDataFrame([(*x, "f", 1) for x in rows], "doc_id long, text string, form string, n int").repartition(5)
    found = fim.restore(fim.fill_in_middle(df)).collect()
    key = lambda x: repr(x)
    assert sorted((tuple(x)[:6] for x in found), key=key) == sorted((plain(*x) for x in rows), key=key)
    assert sorted((x["restored"] for x in found)) == sorted((t or "" for _, t in rows))
    assert {x["form"] for x in found} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]), st.sampled_from([None, r"\w+\s*", "[^\n]*\n", "."]))
def test_rope_round_trip(text, x, y, form, unit):
    if any(m in text for m in MARKS):
        return
    pattern = re.compile(unit, re.DOTALL) if unit else None
    rope = fim.build(text, pattern)
    first, second = sorted((x % (rope.units + 1), y % (rope.units + 1)))
    out, p, m = fim.rearranged(text, first, second, form, unit=pattern)
    assert fim.restored(out, form) == text
    assert len(out) == len(text) + 9 and out.count("<M>") == 1
    assert out.endswith("<M>" + text[p : p + m])


@given(st.lists(st.text(max_size=20), max_size=8), st.integers(0, 200))
def test_split_and_concat(parts, rank):
    rope = fim.EMPTY
    for p in parts:
        rope = fim.concat(rope, fim.build(p))
    text = "".join(parts)
    a, b = fim.split(rope, rank)
    assert (fim.flat(a), fim.flat(b)) == (text[:rank], text[rank:])
    assert a.points == a.units == len(text[:rank]) and b.points == len(text[rank:])


def test_units_are_matches():
    text = "one two  three" * 700
    rope = fim.build(text, re.compile(r"\w+"))
    assert rope.units == len(re.findall(r"\w+", text)) and rope.points == len(text)
    for rank in (0, 1, 2, 1023, 1024, 1025, rope.units - 1, rope.units):
        a, b = fim.split(rope, rank)
        assert fim.flat(a) + fim.flat(b) == text and a.units == rank and b.units == rope.units - rank
        assert rank == rope.units or not rank or re.match(r"\w", fim.flat(b))


def test_depth_stays_small():
    rope, depth = fim.build("x" * 5_000_000), 0
    while isinstance(rope, fim.Node):
        rope, depth = rope.left, depth + 1
    assert depth <= 13


def test_sentinels_that_overlap_are_refused(spark):
    for marks in (("<P>", "<P>>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim._apart(marks)
    fim._apart(MARKS)
