"""Helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batches, text_col: int | str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``max_bytes`` of text.

    Rows are never cut: a text longer than that is a piece of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        if len(sizes) == 0:
            continue
        block = (np.cumsum(sizes, dtype=np.int64) - sizes) // max_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
            yield batch.slice(int(a), int(b - a))


def texts_of(column) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if len(sorted_values) == 0:
        none = np.zeros(0, np.int64)
        return none, none
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.r_[starts[1:], len(sorted_values)]
