"""Byte buffers of Arrow text columns, cut into slices of bounded size, as NumPy arrays."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that NumPy works on at a time; a longer text is worked on in pieces.
SLICE_BYTES = 1 << 20


def release() -> None:
    """Give memory that is not in use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A task's function on Arrow batches that gives memory back after each batch and at its end.

    Python workers are reused from task to task and stage to stage, and what they keep counts against their executor.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        try:
            yield from run(watched())
        finally:
            release()

    return task


_sole: list = [None, None]


def sole(load: Callable) -> Callable:
    """A cached loader of something large. A worker keeps one such thing at a time, whichever loader made it last."""

    @functools.wraps(load)
    def loaded(*args):
        name = (load.__module__, load.__name__, args)
        if _sole[0] != name:
            _sole[:] = [None, None]
            _sole[:] = [name, load(*args)]
        return _sole[1]

    return loaded


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array without nulls; offsets start at 0."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay under limit, or a single longer row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] (first axis) in float64; empty segments give 0."""
    out = np.zeros((len(starts), *values.shape[1:]))
    some = ends > starts
    if some.any():
        cuts = np.empty(2 * int(some.sum()), np.int64)
        cuts[0::2], cuts[1::2] = starts[some], ends[some]
        tail = cuts[-1] == len(values)
        sums = np.add.reduceat(values, cuts[:-1] if tail else cuts, axis=0, dtype=np.float64)
        out[some] = sums[0::2]
    return out


def spaced(raw: np.ndarray, offsets: np.ndarray, gap: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Copy of raw with gap bytes of fill before each row; the new start of each row."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] + gap * np.arange(1, len(sizes) + 1)
    out = np.full(len(raw) + gap * len(sizes), fill, np.uint8)
    out[np.arange(len(raw)) + np.repeat(gap * np.arange(1, len(sizes) + 1), sizes)] = raw
    return out, starts


#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(runs without ASCII white space of all rows, how many each row has). cuts: places where a run is cut, too."""
    n = len(raw)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[raw]
    new = np.zeros(n + 1, bool)
    if cuts is not None:
        new[:n] = cuts
    new[offsets] = True
    begins, ends = new[:-1].copy(), new[1:].copy()
    begins[1:] |= ~inside[:-1]
    ends[:-1] |= ~inside[1:]
    starts = np.flatnonzero(begins & inside)
    sizes = np.flatnonzero(ends & inside) + 1 - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
    return found, np.diff(np.searchsorted(starts, offsets))
