"""Streaming over groups in Arrow batches that are sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A table for each run of equal keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for col in cols:
            values = col.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            here = tuple(col[a].as_py() for col in cols)
            if held and here != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
