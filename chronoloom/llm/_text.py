"""Vectorised kernels over the byte buffers of Arrow strings.

Everything works on whole texts: a slice is a run of whole rows whose bytes stay
under a limit, and a row larger than the limit is a slice of its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20

def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: A worker's blocks from this size on, such as whole batches, are the system's again as soon as they are freed.
LARGE_BYTES = 4 << 20
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def _libc(call: str, *a: int) -> None:
    try:
        getattr(ctypes.CDLL("libc.so.6"), call)(*a)
    except (OSError, AttributeError):
        pass


@functools.cache
def _lean() -> None:
    """Arrow takes memory from the C library, which keeps no large blocks: the batch of a task that ended would stay with its worker."""
    pa.set_memory_pool(pa.system_memory_pool())
    _libc("mallopt", _M_MMAP_THRESHOLD, LARGE_BYTES)
    _libc("mallopt", _M_TRIM_THRESHOLD, 2 * LARGE_BYTES)


def tidy(f: Callable[..., Iterator], lean: bool = True) -> Callable[..., Iterator]:
    """A generator that gives memory back when a task ends: workers wait for the next one beside others. `lean`: large blocks go at once, which takes time where many come and go."""

    @functools.wraps(f)
    def g(*a, **k):  # noqa: ANN002, ANN003, ANN202
        if lean:
            _lean()
        try:
            yield from f(*a, **k)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _libc("malloc_trim", 0)

    return g


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most `limit` bytes, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes outside `[\\x20\\x09-\\x0D]`, never across rows."""
    return spans(~SPACE[data], at)


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true values, never across rows."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    change[at[:-1][at[:-1] < n]] = True
    edge = np.flatnonzero(change)
    end = np.append(edge[1:], n)
    keep = inside[edge]
    start, end = edge[keep], end[keep]
    return start, end, np.searchsorted(at, start, "right") - 1


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG = 64  # spans beyond this many bytes are hashed one by one, in C


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span, the same wherever it lies: every eight bytes are mixed into a chain, so no family of strings collides by its structure."""
    size = end - start
    eights = _eights(data)
    h = mix(size.astype(U64) + U64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    h ^= eights[start] & _LOW_BYTES[np.minimum(size, 8)]
    h = mix(h)
    at, live = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(live):
        x = h[live] * U64(0xD1B54A32D192ED03)
        x ^= eights[start[live] + at] & _LOW_BYTES[np.minimum(size[live] - at, 8)]
        h[live] = mix(x)
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
            h[i] = xxhash.xxh3_64_intdigest(raw[a:b], seed)
    return h


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether span start:end holds the same bytes as other:stop, for each pair."""
    size = end - start
    same = size == stop - other
    eights = _eights(data)
    at, live = 0, np.flatnonzero(same & (start != other))
    while len(live):
        if at >= LONG:  # few are left
            raw = data.tobytes()
            for i, a, b, n in zip(live.tolist(), start[live].tolist(), other[live].tolist(), size[live].tolist()):
                same[i] = raw[a : a + n] == raw[b : b + n]
            break
        good = (eights[start[live] + at] ^ eights[other[live] + at]) & _LOW_BYTES[np.minimum(size[live] - at, 8)] == 0
        same[live[~good]] = False
        at += 8
        live = live[good & (size[live] > at)]
    return same


def ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of `count` items each: the row and the place in it of every item."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def whole_runs(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by key; a run must fit in memory. `least`: rows a table waits for."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        same = np.ones(t.num_rows - 1, bool)
        for k in key:
            v = t[k].combine_chunks()
            v = v.to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same)
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1)
            t = t.slice(int(cut[-1]) + 1)
        held, rows = [t], t.num_rows
    if rows:
        yield pa.concat_tables(held).combine_chunks()
