"""Vector columns as matrices, for the embedding operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, float64 matrix) per vector length; rows that are null, empty or hold null are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    values = column.values
    if values.null_count:
        holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        usable &= holes[offsets[1:]] == holes[offsets[:-1]]
    flat = values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == size))
        yield rows, flat[offsets[rows][:, None] + np.arange(size)].astype(np.float64)


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a direction, their unit vectors): rows of zeros or non-finite numbers have none."""
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    some = matrix[good]
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    some = some / np.abs(some).max(axis=1, keepdims=True, initial=0)
    return np.flatnonzero(good), some / np.linalg.norm(some, axis=1, keepdims=True)
