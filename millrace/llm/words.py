"""Words of Arrow text columns as flat numpy arrays: no Python object for a word is made.

A word is a maximal run of bytes of one class (UTF-8 is searched bytewise; all bytes of a character
beyond ASCII are word bytes). Each gets a 64-bit hash of its bytes: a polynomial over random byte
values, mixed. Columns are cut into blocks of at most BLOCK bytes (one text at least) and ROWS rows, so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK, ROWS = 1 << 20, 1 << 16
U64 = np.uint64
_SEED = np.random.default_rng(20240131)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: all but space and the controls 9 to 13; and ASCII digits and letters, with all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers = np.array([1], U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1024)
        _powers = np.concatenate([[U64(1)], np.cumprod(np.full(size, _BASE, U64), dtype=U64)])
    return _powers


@dataclass
class Words:
    """hash, start and stop (bytes in data) of each word; text i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(column: pa.Array, block: int = BLOCK, rows: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of each block of rows; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1
        to = min(max(to, at + 1), at + rows, len(column))
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    data = _LOWER[data] if lower else data
    inside = word_bytes[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    now = np.zeros(n + 1, bool)
    now[:-1] = inside
    start = np.flatnonzero(now & (edge | ~before))
    edge[n] = True
    stop = np.flatnonzero(before & (edge | ~now))
    size = stop - start
    value = _BYTE[data]
    where = np.arange(n) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [n]])))
    value *= _power(int(where.max(initial=0)) + 1)[np.where(inside, where, 0)]
    value *= inside
    h = np.add.reduceat(value, start) if len(start) else np.zeros(0, U64)
    h = mix(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(data, offsets, h, start, stop, np.searchsorted(start, offsets))


def run_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes between one start and the next (or the end); none is 0."""
    size = np.diff(start, append=len(data))
    where = np.arange(len(data)) - np.repeat(start, size) if len(start) else np.zeros(0, np.int64)
    value = _BYTE[data]
    value *= _power(int(where.max(initial=0)) + 1)[where]
    h = mix(np.add.reduceat(value, start) + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return np.where(h == 0, U64(1), h)


_GRAM = _SEED.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive numbers of h; those across two texts are for the caller to leave out."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out = h[:n] * _GRAM[0]
    for i in range(1, k):
        out += h[i : i + n] * _GRAM[i]
    return mix(out)
