"""Arrow helpers for the operators that work on whole texts in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is taken up at once.
SLICE_BYTES = 8 << 20


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut to about ``most`` bytes of text (at least one row), with the texts as an array; null counts as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        bins = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low), texts.slice(low, high - low)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for an empty row."""
    totals = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return totals[offsets[1:]] - totals[offsets[:-1]]


def lengths_to_starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def gather(starts: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists at[0], at[1], ... one after the other; list k is flat[starts[k]:starts[k + 1]]. Gives their starts and values."""
    lengths = (starts[1:] - starts[:-1])[at]
    until = lengths_to_starts(lengths)
    return until, flat[np.repeat(starts[at] - until[:-1], lengths) + np.arange(until[-1])]
