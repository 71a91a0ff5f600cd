"""Words of UTF-8 text columns as NumPy arrays: hashes and places without a Python loop over texts.

Used inside tasks on slices of Arrow batches. A word is a run of bytes that a table of 256 entries calls letters; this is
exact for classes that hold all or none of the bytes from 0x80. Hashes are polynomials modulo 2 ** 64 with random odd
values, so equal words have equal hashes and others differ but for a chance of about 2 ** -60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHARD_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One value per byte, the same for A to Z and a to z.
FOLDED = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED[65:91] = FOLDED[97:123]
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A to Z.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True
#: ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def _power(kept: dict, base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of ``base``, kept in a dictionary of the worker."""
    have = kept.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(n + n // 4 + 1, base, np.uint64)
        steps[0] = 1
        have = kept[int(base)] = np.cumprod(steps)
    return have[:n]


def cut_words(
    data: np.ndarray, offsets: np.ndarray, powers: dict, letters: np.ndarray = ALPHANUMERIC
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of every word, and the words per text; text i is ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    inside = letters[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(FOLDED[data] * _power(powers, _STEP, n), out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _power(powers, _BACK, n)[starts]
    return hashes, starts, stops, np.diff(np.searchsorted(starts, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def shards(column: pa.Array, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive slices (first row, end row, bytes, offsets) of a text column with at most ``size`` (else
    ``SHARD_BYTES``) bytes, one text at least."""
    size = size or SHARD_BYTES
    data, offsets = text_buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
