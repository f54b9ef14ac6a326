"""Vectors in Arrow batches: which rows hold a usable one, and their numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: lengths, offsets into ``values`` (both per row), and the
    flat doubles. A row that is null, empty, or holds a null or non-finite
    component has length 0."""
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    lengths[~np.asarray(column.is_valid())] = 0
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    lengths[bad[offsets[1:]] > bad[offsets[:-1]]] = 0
    return lengths, offsets[:-1], values


def stacked(blobs: pa.Array, dtype: str = "<f8") -> np.ndarray:
    """A matrix of equally long binary rows, in doubles."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=dtype).reshape(len(blobs), -1).astype(np.float64)


def grouped(batches, keys: int):
    """Runs of rows that are equal in the first ``keys`` columns, of sorted
    batches: (key, iterator over record batches of the run). Runs that span
    batches go on; the iterator must be read to its end."""
    held = []

    def pieces():
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.zeros(batch.num_rows, dtype=bool)
            for k in range(keys):
                column = batch.column(k).to_numpy(zero_copy_only=False)
                marks[1:] |= column[1:] != column[:-1]
            cuts = np.concatenate([[0], np.nonzero(marks)[0], [batch.num_rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield tuple(batch.column(k)[int(lo)].as_py() for k in range(keys)), batch.slice(int(lo), int(hi - lo))

    source = pieces()
    held.append(next(source, None))
    while held[0] is not None:
        key = held[0][0]

        def run():
            while held[0] is not None and held[0][0] == key:
                yield held[0][1]
                held[0] = next(source, None)
        yield key, run()
