"""Vectors as binary rows, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of the usable vectors of a list column, for each length among them: those that
    are not null or empty, hold no null and only finite components. Values are double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
        finite = np.isfinite(x).all(axis=1)
        if finite.any():
            yield rows[finite], x[finite]


def rows_of(column: pa.Array, dtype) -> np.ndarray:
    """The matrix whose rows are the entries of a binary column, all of one length."""
    data = b"".join(column.to_pylist())
    n = len(column)
    return np.frombuffer(data, dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)
