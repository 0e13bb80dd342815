"""Rows that share a key, from sorted Arrow batches in which a key may go on from one batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that no run is cut by, with the bounds of their runs (number of runs + 1).

    A run is a series of rows alike in the first `keys` columns, none of which is null.  At most one run is
    held back at a time, so memory is that of a batch and of the longest run.
    """
    held = None
    for b in batches:
        if held is not None and held.num_rows:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        first = _firsts(b, keys)
        held = b.slice(first[-1])
        if first[-1]:
            yield b.slice(0, first[-1]), first
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _firsts(b: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(b.num_rows, dtype=bool)
    new[0] = True
    for c in b.columns[:keys]:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)
