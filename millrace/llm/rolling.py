"""Rolling 64-bit hashes over whole Arrow text columns, without a Python loop over texts or words.

A window's hash is a polynomial in an odd base, modulo 2**64, taken as the difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd bases and their inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Texts are taken in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below ``n`` at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def text_slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of consecutive rows; a null is an empty text."""
    chunks, row = (column.chunks if isinstance(column, pa.ChunkedArray) else [column]), 0
    for c in chunks:
        c = pc.fill_null(c, "" if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else b"")
        wide = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        if not len(c):
            continue
        offs = np.frombuffer(c.buffers()[1], dtype=np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        data = np.frombuffer(c.buffers()[2], dtype=np.uint8) if c.buffers()[2] is not None and c.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(c):
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield row + at, row + end, offs[at : end + 1] - offs[at], data[offs[at] : offs[end]]
            at = end
        row += len(c)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of anything but ASCII white space; never across
    texts), and the first word of each text, with the number of words at the end."""
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, after = solid[:-2].copy(), solid[2:].copy()
    cut = offs[(offs > 0) & (offs < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(solid[1:-1] & ~before)
    ends = np.flatnonzero(solid[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def in_one_text(first: np.ndarray, width: int) -> np.ndarray:
    """The items at which a window of ``width`` items starts that ends in the same text."""
    n = np.diff(first)
    end = np.repeat(first[1:], n)
    at = np.arange(int(first[-1]))
    return at[at + width <= end]


def window_hashes(items: np.ndarray, width: int, at: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """Hash of the ``width`` items from each position in ``at``."""
    up, down = powers(base, len(items) + 1)
    total = np.zeros(len(items) + 1, dtype=U)
    np.cumsum(items * up[: len(items)], out=total[1:])
    return mix((total[at + width] - total[at]) * down[at])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``width`` from one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of True, as rows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)
