"""Fill-in-middle transformation on ropes.

A text becomes a rope: a balanced binary tree whose leaves hold short slices and cache how many units and code points they
have; inner nodes cache the sums. Splitting at a rank walks one path and shares every subtree beside it, concatenation makes
one node, so no text is copied until the result is written out. The forward transformation splits a tree at two unit ranks
and concatenates the parts, rearranged, with leaves of sentinels. The inverse builds a rope of the output, finds the
sentinels, splits at their code-point ranks, and concatenates the parts in their first order.

A unit is a code point, or a match of a pattern, matched left to right; what lies between matches belongs to the unit
before it (before the first match: to the first).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

#: Where a sequence's prefix, suffix and middle begin.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are rearranged, and of those, that begin with the suffix.
RATE, SPM_RATE = 90, 20
#: The most units of a leaf.
LEAF_UNITS = 1024


# ---- ropes -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True, slots=True)
class Leaf:
    """A slice of a text. ends: where in it each of its units ends; None where each code point is a unit."""

    text: str
    units: int
    points: int
    ends: tuple[int, ...] | None = None

    def cut(self, rank: int, by_units: bool) -> tuple[Leaf, Leaf]:
        at = rank if self.ends is None or not by_units else self.ends[rank - 1] if rank else 0
        units = at if self.ends is None else bisect_right(self.ends, at)
        left, right = (None, None) if self.ends is None else (self.ends[:units], tuple(e - at for e in self.ends[units:]))
        return Leaf(self.text[:at], units, at, left), Leaf(self.text[at:], self.units - units, self.points - at, right)


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def concat(a: Rope, b: Rope) -> Rope:
    if not a.points:
        return b
    if not b.points:
        return a
    return Node(a, b, a.units + b.units, a.points + b.points)


def build(text: str, unit: re.Pattern | None = None) -> Rope:
    """A balanced rope of a text."""
    if not text:
        return EMPTY
    if unit is None:
        level: list[Rope] = [Leaf(s, len(s), len(s)) for s in (text[k : k + LEAF_UNITS] for k in range(0, len(text), LEAF_UNITS))]
    else:
        starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()][1:]  # the first unit begins with the text
        bounds = [0, *starts, len(text)]
        level = []
        for k in range(0, len(bounds) - 1, LEAF_UNITS):
            own = bounds[k : k + LEAF_UNITS + 1]
            level.append(Leaf(text[own[0] : own[-1]], len(own) - 1, own[-1] - own[0], tuple(e - own[0] for e in own[1:])))
    while len(level) > 1:
        level = [concat(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def split(rope: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The rope's first ``rank`` units (or code points) and the rest."""
    size = rope.units if by_units else rope.points
    if rank <= 0 or rank >= size:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if isinstance(rope, Leaf):
        return rope.cut(rank, by_units)
    own = rope.left.units if by_units else rope.left.points
    if rank <= own:
        a, b = split(rope.left, rank, by_units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - own, by_units)
    return concat(rope.left, a), b


def flat(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, Leaf):
            out.append(r.text)
        else:
            stack += (r.right, r.left)
    return "".join(out)


# ---- one text --------------------------------------------------------------------------------------------------------


def rearranged(text: str, first: int, second: int, form: str, sentinels: tuple[str, str, str] = SENTINELS, unit: re.Pattern | None = None) -> tuple[str, int, int]:
    """The output of a form (psm or spm), and code points of prefix and middle; the cuts are unit ranks."""
    p, s, m = (Leaf(x, 1, len(x), None if unit is None else (len(x),)) for x in sentinels)
    rest, suffix = split(build(text, unit), second)
    prefix, middle = split(rest, first)
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out: Rope = EMPTY
    for part in order:
        out = concat(out, part)
    return flat(out), prefix.points, middle.points


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    order = (p, s, m) if form == "psm" else (s, p, m)
    parts, rope, gone = {}, build(output), 0
    at = 0
    marks = []
    for x in order:
        at = output.index(x, at)
        marks.append(at)
        at += len(x)
    for x, (begin, end) in zip(order, pairwise([*marks, len(output)])):
        _, rope = split(rope, begin + len(x) - gone, by_units=False)
        parts[x], rope = split(rope, end - begin - len(x), by_units=False)
        gone = end
    return flat(concat(concat(parts[p], parts[m]), parts[s]))


def _apart(sentinels: tuple[str, ...]) -> None:
    """No text without sentinels may form one together with a sentinel's edge."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("sentinels overlap")


# ---- tables ----------------------------------------------------------------------------------------------------------


def _drawn(seed: int, k: int) -> Column:
    """The k-th 32-bit number of a document: eight hex digits of the digest of seed and doc_id (nothing where it is null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, unit: str | None = None
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output of each
    row of docs (doc_id, text).

    unit: a Python regular expression of a unit; a code point if None. A text that is empty or holds a sentinel is plain, and
    so is the share of texts that rate leaves. Null texts are empty. Very long texts are cut whole: a rope copies nothing but
    its output. What a row becomes depends on its text and doc_id alone, so repeated rows become the same, and two texts of
    one doc_id draw the same numbers; a null doc_id draws as an empty one. Cuts that meet leave a part empty. No rows: no
    rows. Other columns don't matter, whatever their names.
    """
    _apart(sentinels)
    pattern = re.compile(unit, re.DOTALL) if unit else None
    drawn = [_drawn(seed, k).alias(f"h{k}") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            n, form, prefix, middle, output = [], [], [], [], []
            draws = [b.column(k).to_pylist() for k in range(2, 6)]
            for text, h1, h2, h3, h4 in zip(b.column(1).to_pylist(), *draws):
                count = len(text) if pattern is None else build(text, pattern).units
                n.append(count)
                if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
                    form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                    continue
                x, y = h1 % (count + 1), h2 % (count + 1)
                form.append("spm" if h4 % 100 < spm_rate else "psm")
                out, before, within = rearranged(text, min(x, y), max(x, y), form[-1], sentinels, pattern)
                prefix.append(before), middle.append(within), output.append(out)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made (form, output, ...) with restored, the text rebuilt from these two alone. A null output or form stays null."""
    _apart(sentinels)
    columns = made.columns
    form, output = columns.index("form"), columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, output):
            texts = [None if o is None or f is None else restored(o, f, sentinels) for o, f in zip(b.column(output).to_pylist(), b.column(form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*columns, "restored"])

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())]))
