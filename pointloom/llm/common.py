"""What several operators share: scratch tables, and the fixed definition of a word."""

from __future__ import annotations

import numpy as np

from pointloom.plans.scratch import discard, materialize, scratch_dir, shuffle_parts  # noqa: F401

#: A word, as a Java regular expression for Spark SQL.
WORD = r"[^\\x20\\x09-\\x0D]+"

def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on, and idle pools would add up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def by_bytes(batches, column: int = 1, most: int = 1 << 22):
    """Record batches cut so that the texts of one take about so many bytes; one text is never cut."""
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < len(b):
            e = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, side="right")))
            yield b.slice(k, e - k)
            k = e
    release()


# ---- words of many texts at once -------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Positions in a word whose bytes' values stand in a table.
_NEAR = 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _byte_values(code: np.ndarray) -> np.ndarray:
    """A fixed random-looking number for each position in a word and byte there (position * 256 + byte)."""
    return mix64((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_VALUES = _byte_values(np.arange(_NEAR << 8))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column joined, and where each text begins (one more than texts). Null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE, cuts: tuple[int, ...] = ()):
    """64-bit hashes of the words of all texts in order, A-Z lower-cased, and where each text's words begin.

    A word's hash sums numbers drawn for each of its bytes by position, then mixes the sum: words differ by chance only,
    whatever pattern they follow. One running sum over the bytes gives all; texts never share a word. With cuts a list: of
    whole words, then of the words' first bytes, as many as each cut says. space: which bytes end words.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.uint64)
        return [none] * (1 + len(cuts)) if cuts else none, np.zeros(len(at), np.int64)
    inside = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    first = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    last = np.flatnonzero(ends)
    out = [np.empty(len(first), np.uint64) for _ in range(1 + len(cuts))]
    step = 1 << 19  # words of so many bytes at a time: arrays stay small and in cache
    k = 0
    while k < len(first):
        e = max(k + 1, int(np.searchsorted(last, first[k] + step)))
        a, b = int(first[k]), int(last[e - 1]) + 1
        begin, end = first[k:e] - a, last[k:e] + 1 - a
        place = np.arange(b - a, dtype=np.int32) - np.repeat(begin.astype(np.int32), np.diff(begin, append=b - a))
        code = (place << 8) + _LOWER[raw[a:b]] if b - a < 1 << 22 else (place.astype(np.int64) << 8) + _LOWER[raw[a:b]]
        value = _VALUES.take(code, mode="clip")
        if len(far := np.flatnonzero(place >= _NEAR)):
            value[far] = _byte_values(code[far])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        for o, cut in zip(out, (None, *cuts)):
            o[k:e] = total[end if cut is None else np.minimum(end, begin + cut)] - total[begin]
        k = e
    hashed = [mix64(x) for x in out]
    return hashed if cuts else hashed[0], np.searchsorted(first, at)
