"""Text of Arrow batches as numpy arrays: words, rolling hashes, shingles.

Everything works on the UTF-8 bytes of a bounded run of rows at a time, so the memory of a task follows
one run (or one very long text), not its partition.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
SLICE_ROWS = 1_000
U = np.uint64

#: Byte classes: white space as in the contracts, letters A-Z folded to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; another seed gives another order of the same values."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [int(v) | 1 for v in mix(np.arange(64, dtype=U), 11)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        got = np.full(size, base, U)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(got)
        if size <= 4 * RUN_BYTES:
            _powers[base] = got
    return got[:n]


def lean(run):
    """A function over Arrow batches that sees them in slices of ``SLICE_ROWS`` rows, so its copies are small, and gives the
    memory it freed back to the system when its task ends: Spark keeps the worker process for other tasks, which
    share the executor's memory."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)

    @functools.wraps(run)
    def over(batches):
        try:
            yield from run(sliced(batches))
        finally:
            give_back()

    return over


def lean_group(run):
    """A function over the rows of a group that gives the memory it freed back to the system after each group."""

    @functools.wraps(run)
    def over(key, rows):
        try:
            return run(key, rows)
        finally:
            give_back()

    return over


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words, runs of bytes of class ``inside`` within a row; ``first[i]`` is the
    number of words before row i."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[raw]
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = is_in[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_in[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random byte values, finalised with the length."""
    if not len(start):
        return np.zeros(0, U)
    table = _BYTE[FOLD] if fold else _BYTE
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, U)
        total[0] = 0
        np.cumsum(table[raw] * _power(_BASE, len(raw)), out=total[1:])
        value = (total[end] - total[start]) * _power(_INVERSE, len(raw) + 1)[start]
        return mix(value + (end - start).astype(U))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count before each row) of the runs of ``width`` words of every row, in order, repeats kept.
    A row of fewer words gives its whole sequence as one if ``whole_short``, else nothing."""
    n = np.diff(first)
    size = np.maximum(n - width + 1, 0)
    short = (n > 0) & (n < width)
    if whole_short:
        size = size + short
    before = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(before[-1]), U)
    if not len(out):
        return out, before
    at = np.repeat(first[:-1] - before[:-1], size) + np.arange(len(out))
    length = np.full(len(out), width)
    if whole_short:
        length[before[:-1][short]] = n[short]
    with np.errstate(over="ignore"):
        for j in range(width):
            use = length > j
            if use.all():
                out += hashes[at + j] * U(_STEP[j])
            else:
                out[use] += hashes[at[use] + j] * U(_STEP[j])
        return mix(out + length.astype(U), 3), before


class Members:
    """Membership of many hashes in a fixed set: a bit table answers most misses, a sorted search the rest."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(U))
        bits = max(16, min(26, int(len(self.values) * 64).bit_length()))
        self.shift = U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``hashes``, index into ``values``) of the members."""
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        found = hashes[at]
        index = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        same = self.values[index] == found
        return at[same], index[same]
