"""Helpers for Arrow columns inside tasks: slices by size, distinct items, runs of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once.
SLICE_BYTES = 32 << 20


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches into runs of rows of about ``most`` bytes of text; null texts become empty ones.

    A text longer than that is a slice of its own.  Empty batches give nothing.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def distinct(items: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct items and the place of each item among them."""
    coded = items.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def row_lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of the runs that begin at ``starts``, one run after the other."""
    shift = starts - starts_of(lengths)
    total = int(lengths.sum())
    small = total + int(np.abs(starts).max(initial=0)) < 2**31  # half the memory
    kind = np.int32 if small else np.int64
    places = np.repeat(shift.astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return places


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def glued(values: pa.Array, lists: pa.LargeListArray) -> pa.Array:
    """Texts of the lists' runs of ``values`` (large strings, one for each item), one after the other."""
    if not len(values):
        return pa.array([""] * len(lists), pa.large_string())
    _, offsets, data = values.buffers()
    places = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    bounds = np.ascontiguousarray(places[lists.offsets.to_numpy()])
    return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(bounds), data)
