"""Words of Arrow text columns and their hashes, whole columns at a time.

A word is a maximal run of characters other than space and \\t\\n\\v\\f\\r.  Words never reach Python as
objects: a column's bytes are cut and hashed with array operations, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0 to base ** (count - 1), modulo 2 ** 64."""
    found = np.full(count, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found)


#: Bytes whose powers of the step are kept; those of other bytes are these times a power of their block.
_BLOCK = 1 << 12
_BACK = pow(int(_STEP), -1, 1 << 64)
_STEPS, _BACKS = _powers(int(_STEP), _BLOCK) * _STEP, _powers(_BACK, _BLOCK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of parts of a column; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = len(texts)
    if not rows:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(rows, max(end, first + 1))
        at = offsets[first : end + 1]
        yield first, end, data[at[0] : at[-1]], at - at[0]
        first = end


def cut(data: np.ndarray, offsets: np.ndarray, other: np.ndarray = _IS_SPACE):
    """Starts and ends of the words, and for every text the number of its first word."""
    inside = ~other[data]
    begins, closes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[full] = inside[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        closes[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of every word; fold: A-Z count as a-z.

    A word's hash is the sum of its bytes' values, each times a power of the step by its place in the word: the
    difference of two running sums over the data, times the step's inverse to the power of the word's start.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    blocks = -(-len(data) // _BLOCK)
    total = np.zeros(blocks * _BLOCK + 1, np.uint64)
    total[1 : len(data) + 1] = (_FOLDED if fold else _BYTE)[data]
    values = total[1:].reshape(blocks, _BLOCK)
    values *= _STEPS
    values *= _powers(pow(int(_STEP), _BLOCK, 1 << 64), blocks)[:, None]
    np.cumsum(total, out=total)
    found = total[ends] - total[starts]
    found *= _powers(pow(_BACK, _BLOCK, 1 << 64), blocks)[starts // _BLOCK]
    found *= _BACKS[starts % _BLOCK]
    return mixed(found + (ends - starts).astype(np.uint64))


def runs(hashed: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries; callers leave out those that span two texts."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashed[j : j + n] * _PLACE[j]
    return mixed(total + np.uint64(k))


def word_hashes(texts: pa.Array, fold: bool, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all words, number of each text's first word)."""
    for first, end, data, offsets in chunks(texts, size):
        starts, ends, at = cut(data, offsets)
        yield first, end, hashes(data, starts, ends, fold), at
