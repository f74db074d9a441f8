"""Embedding rows that the vector operators must take."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T


def schema(element=None):
    return T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("embedding", T.ArrayType(element or T.FloatType())),
            # Names that operators use inside; they must not clash.
            T.StructField("id", T.StringType()),
            T.StructField("vec", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("block", T.LongType()),
            T.StructField("rank", T.LongType()),
        ]
    )


def rows(n=120, d=6, seed=3, unit=False):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, d)) * np.linspace(3, 0.5, d)
    if unit:
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    return [(i, [float(np.float32(x)) for x in v], "x", "y", 1, 2, 3) for i, v in enumerate(m)]


def odd_rows(d=6):
    """Rows that take no part: NULL, empty, NULL entry, non-finite, another length."""
    bad = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d + 1)]
    return [(1000 + 20 * i, v, None, None, None, None, None) for i, v in enumerate(bad)]


def frame(spark, data, element=None):
    return spark.createDataFrame(data, schema(element))
