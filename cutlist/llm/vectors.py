"""Vectors as packed blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector exists and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(starts[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size)
