"""Bounded parts of Arrow batches, so that a worker's memory does not depend on how long records are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MOST_ELEMENTS = 1_000_000
MOST_ROWS = 1024
MOST_BYTES = 16 << 20


def binary_offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary or string column start and end in its buffer."""
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]


def by_elements(batch: pa.RecordBatch, column: int, most: int = MOST_ELEMENTS) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``most`` list elements, or as many 8-byte codes of a binary column, or with one row."""
    lists = batch.column(column)
    ends = binary_offsets(lists) // 8 if pa.types.is_binary(lists.type) else lists.offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        stop = min(max(stop, at + 1), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of Arrow data, as far as rows of average size make them up, and ``MOST_ROWS`` rows."""
    for batch in batches:
        rows = max(1, min(MOST_ROWS, batch.num_rows * most // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if part.num_rows > 1 and part.nbytes > 2 * most:  # a few long rows among short ones
                yield from by_bytes(iter([part]), most)
            else:
                yield part
