"""Array kernels on the UTF-8 bytes of many texts at once: words, lines, their hashes and shingles.

Texts come as Arrow columns and are worked through in chunks of 256 KB (or one text, if it is longer), so memory is bounded
by the longest text, whatever a batch holds. Hashes have 64 bits. A word's hash is a polynomial over random numbers drawn for
each byte value, finished by an avalanche; equal words have equal hashes, and among 10^8 distinct ones a collision is expected
about 0.0003 times.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
SPACES = (32, 9, 10, 11, 12, 13)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


@cache
def _places(n: int) -> np.ndarray:
    """Odd multipliers of the places in a window of n words."""
    return np.random.default_rng(977).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def give_back() -> None:
    """Returns to the system what allocators keep of memory that was freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """run, a function over Arrow batches, which gives back the memory that it freed when it ends.

    Python workers outlive their tasks, and the allocators keep what tasks free; idle workers would hold it beside the next
    stage's.
    """

    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return over_batches


def trimmed(run: Callable[[pa.Table], pa.Table], least: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """run, a function of a group's table, which gives back memory after groups of least bytes or more."""

    def over_group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes >= least:
                give_back()

    return over_group


def mixed(x: np.ndarray) -> np.ndarray:
    """An avalanche over 64-bit numbers: a bijection after which every bit depends on every other."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xCF1BBCDCB7A56463)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)]) for base in (_BASE, _BASE_INVERSE)]
    return _powers


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts within them and the end), of so many bytes; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans_where(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(inside) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=first[1:-1])
    first[offsets] = True
    edges = np.flatnonzero(first)
    keep = inside[edges[:-1]]
    return edges[:-1][keep], edges[1:][keep]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each text's first word and the end."""
    starts, ends = spans_where(~_IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; lower: A-Z count as a-z. Spans ascend and don't overlap; they are taken by about CHUNK
    bytes, so that a long text needs no more."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTES[_LOWER] if lower else _BYTES
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = data[base : ends[j - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((sums[b] - sums[a]) * down[a])
        i = j
    return out


def windows(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on; the last n - 1 places, and places whose window leaves a text, mean nothing."""
    out = np.zeros(len(word), np.uint64)
    m = len(word) - n + 1
    if m > 0:
        places = _places(n)
        total = word[:m] * places[0]
        for j in range(1, n):
            total += word[j : j + m] * places[j]
        out[:m] = mixed(total)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its windows of n lower-cased words; all its words as one if it has fewer."""
    starts, ends, first = words(data, offsets)
    word = hashes(data, starts, ends, lower=True)
    window = windows(word, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(window[a : b - n + 1]))
        elif b > a:
            out.append(mixed(np.cumsum(word[a:b] * _places(n)[: b - a])[-1:] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between each text's first place and the next one's."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def codepoints(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point."""
    return (data & 0xC0) != 0x80
