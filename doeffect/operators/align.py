"""Schema alignment of differently shaped evidence frames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing from a frame is NULL there.

    Narrow (no shuffle, no dedupe): each branch keeps its own scan, so
    filters and column pruning still reach every source's Parquet reader.
    """
    if not frames:
        raise ValueError("nothing to union")
    return functools.reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), frames
    )


def ensure_columns(
    df: DataFrame, columns: Sequence[str], dtype: T.DataType = T.LongType()
) -> DataFrame:
    """Add each listed column that ``df`` lacks as a typed NULL."""
    present = {c.lower() for c in df.columns}
    missing = {c: F.lit(None).cast(dtype) for c in columns if c.lower() not in present}
    return df.withColumns(missing) if missing else df
