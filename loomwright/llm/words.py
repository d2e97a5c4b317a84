"""Vectorised words and word n-grams over Arrow string columns.

Texts are handled as UTF-8 bytes: every word definition here is a set of byte values, with all
bytes of non-ASCII characters inside or outside it. Words and n-grams get 64-bit polynomial hashes
from prefix sums, so a text costs a few array passes whatever its number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_MIX = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 18  # bytes, or words, that are hashed at once: bounds the arrays of eight bytes for each


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Runs of anything but ASCII white space.
SPACED = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: Runs of ASCII letters, digits and all non-ASCII characters.
LETTERS = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have[0], have[1]


def scramble(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a block of documents: byte spans, and the first word of each document (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            base = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, base + _PIECE, side="right")))
            data = self.data[base : self.end[b - 1]]
            power, inverse = _powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_MIX[data] * power[: len(data)], out=sums[1:])
            first = self.start[a:b] - base
            out[a:b] = scramble((sums[self.end[a:b] - base] - sums[first]) * inverse[first])
            a = b
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words of the block; those that cross documents are the caller's to skip."""
    count = max(len(word_hashes) - n + 1, 0)
    out = np.empty(count, np.uint64)
    for a in range(0, count, _PIECE):
        b = min(a + _PIECE, count)
        mine = word_hashes[a : b + n - 1]
        power, inverse = _powers(len(mine) + 1)
        sums = np.zeros(len(mine) + 1, np.uint64)
        np.cumsum(mine * power[: len(mine)], out=sums[1:])
        out[a:b] = scramble((sums[n:] - sums[: b - a]) * inverse[: b - a])
    return out


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """The words at which n consecutive words of one document start."""
    last = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(len(last)) + n <= last)


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes in ``inside`` within each document."""
    n = len(data)
    member = np.zeros(n + 2, bool)
    member[1:-1] = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    here, before, after = member[1:-1], member[:-2], member[2:]
    start = np.flatnonzero(here & (~before | edge[:-1]))
    end = np.flatnonzero(here & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def release() -> None:
    """Gives what a worker has freed back to the system: a worker lives on between tasks, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def blocks(column: pa.Array, max_bytes: int = 1 << 22, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splits a string column into runs of whole documents of at most ``max_bytes`` (or one document).

    Yields the first row, the bytes and the document offsets within them. Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1)
        data = raw[offsets[row] : offsets[stop]]
        yield row, (_LOWER[data] if lower else data), offsets[row : stop + 1] - offsets[row]
        row = stop
