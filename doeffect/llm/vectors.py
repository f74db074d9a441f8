"""Embedding columns as matrices of whole rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_column(table: DataFrame, vec_col: str) -> Column:
    """The vectors as lists of floats, or of doubles for any other element type."""
    return F.col(vec_col).cast("array<float>" if element(table, vec_col) == np.dtype("<f4") else "array<double>")


def element(table: DataFrame, vec_col: str) -> np.dtype:
    """The numpy type of the entries of :func:`vector_column`."""
    kind = table.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return np.dtype("<f4" if single else "<f8")


def dimension(table: DataFrame, vec_col: str) -> int:
    """The commonest length of the non-empty vectors (of equally common ones the
    largest); 0 if there are none.  Two vectors of different lengths have no
    inner product, so rows of other lengths take no part."""
    size = F.size(F.col(vec_col))
    most = (
        table.where(F.col(vec_col).isNotNull() & (size > 0))
        .groupBy(size.alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max(F.struct("n", "d")).alias("most"))
        .first()["most"]
    )
    return 0 if most is None else int(most["d"])


def finite_rows(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): which rows are vectors of ``d`` finite entries, and these."""
    if not len(column) or not d:
        return np.zeros(0, np.int64), np.zeros((0, d))
    start = column.offsets.to_numpy()
    valid = np.diff(start) == d
    if column.null_count:
        valid &= column.is_valid().to_numpy(zero_copy_only=False)
    # NULL entries become NaN here.
    entries = column.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid)
    if len(rows) == len(column):
        matrix = entries[start[0] : start[-1]].reshape(-1, d)
    else:
        matrix = entries[start[rows][:, None] + np.arange(d)]
    finite = np.isfinite(matrix).all(axis=1)
    return (rows, matrix) if finite.all() else (rows[finite], matrix[finite])
