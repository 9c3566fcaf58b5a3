"""Sparse rows inside tasks: runs of (column, value) out of Arrow lists, and products with dense blocks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Cells times width of a block that one product makes at once.
CELLS = 1 << 22


class Rows(NamedTuple):
    """Rows one after the other: ``lengths`` cells each, with their columns and values."""

    lengths: np.ndarray
    cols: np.ndarray
    xs: np.ndarray

    def squares(self) -> np.ndarray:
        return self.sums((self.xs * self.xs)[:, None])[:, 0]

    def sums(self, cells: np.ndarray) -> np.ndarray:
        """Sum of the cells' rows for each row; zero for an empty one."""
        out = np.zeros((len(self.lengths), cells.shape[1]))
        some = self.lengths > 0
        if some.any():
            out[some] = np.add.reduceat(cells, (np.cumsum(self.lengths) - self.lengths)[some], axis=0)
        return out


def rows_of(batch: pa.RecordBatch, cols: str = "cols", xs: str = "xs") -> Rows:
    """The rows of two list columns of equal lengths."""
    lists, values = batch.column(cols), batch.column(xs)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return Rows(lengths, lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float))


def stacked(rows: list) -> Rows:
    """Rows collected from Spark, each with cols and xs."""
    lengths = np.array([len(r["cols"]) for r in rows], np.int64)
    flat = lambda name, kind: np.concatenate([np.array(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)
    return Rows(lengths, flat("cols", np.int64), flat("xs", float))


class Block:
    """A bounded number of sparse vectors as a dense matrix over the columns they use."""

    def __init__(self, rows: Rows):
        self.count = len(rows.lengths)
        self.used = np.unique(rows.cols)
        self.matrix = np.zeros((len(self.used), self.count))
        self.matrix[np.searchsorted(self.used, rows.cols), np.repeat(np.arange(self.count), rows.lengths)] = rows.xs
        self.norms = np.sqrt(rows.squares())

    def products(self, rows: Rows) -> np.ndarray:
        """Inner products of sparse rows with the block's vectors."""
        out = np.zeros((len(rows.lengths), self.count))
        if not len(self.used) or not self.count:
            return out
        ends = np.cumsum(rows.lengths)
        begin = 0
        while begin < len(rows.lengths):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + CELLS // self.count, side="right")))
            cols, xs = rows.cols[base : ends[end - 1]], rows.xs[base : ends[end - 1]]
            at = np.minimum(np.searchsorted(self.used, cols), len(self.used) - 1)
            known = self.used[at] == cols
            part = Rows(rows.lengths[begin:end], cols, xs)
            out[begin:end] = part.sums(self.matrix[at] * np.where(known, xs, 0.0)[:, None])
            begin = end
        return out
