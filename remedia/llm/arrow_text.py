"""Small helpers for text columns in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@cache
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives free memory back when a task ends: workers serve one stage after another, and what
    allocators keep for themselves adds up beside the executor's own memory."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return inner


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least); all rows, in order."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def code_points(words: list[str]) -> np.ndarray:
    """All code points of the words, one after another."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, indices and code points (as rows) of the words of each length, empty words left out."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes, starts = code_points(words), np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths):
        if length:
            at = np.flatnonzero(lengths == length)
            yield int(length), at, codes[starts[at][:, None] + np.arange(length)]


def encoded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a list column, the distinct word at each place, and the row of each place."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else lists.values
    if not len(flat):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    numbered = flat.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(offsets))
