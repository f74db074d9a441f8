"""Contingency margins of comparison labels against prediction labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V

KEY = "targetIdC"
CONTINGENCY_COLUMNS = [
    "dataset",
    "comparisonColumn",
    "predictionColumn",
    "prediction",
    "comparison",
    "comparisonType",
    "predictionType",
    "a",
    "predictionTotal",
    "comparisonTotal",
    "total",
]
# The columns of scored rows that the reports read, whatever their comparison and prediction.
LABEL_COLUMNS = ["dataset", KEY, "diseaseIdC", *[c for c, _ in V.COMPARISONS], *[p for p, _ in V.PREDICTIONS]]


def pair_total(scored: DataFrame) -> DataFrame:
    """``dataset, total``: distinct (target, disease) drug pairs per subset.

    Counted as distinct rows of the pair, so a NULL key still counts.
    """
    return scored.groupBy("dataset").agg(
        F.count_distinct(F.struct("targetIdC", "diseaseIdC")).alias("total")
    )


def _label_cells(columns: Sequence[tuple[str, str]], name: str, kind: str, value: str):
    return F.array(
        *[
            F.struct(
                F.lit(col).alias(name), F.lit(typ).alias(kind), F.col(col).alias(value)
            )
            for col, typ in columns
        ]
    )


def contingency_grid(
    scored: DataFrame,
    comparisons: Sequence[tuple[str, str]] = V.COMPARISONS,
    predictions: Sequence[tuple[str, str]] = V.PREDICTIONS,
    pair_flag: str | None = None,
) -> DataFrame:
    """All (subset, comparison, prediction) contingency tables in one job.

    For each cell: ``a`` = spine rows with that (comparison, prediction)
    value pair, ``predictionTotal`` = rows with that prediction value
    (including rows whose comparison is NULL), ``comparisonTotal`` = rows
    with that comparison value, ``total`` = distinct drug pairs of the
    subset.  Rows with a NULL comparison or prediction are dropped after the
    margins are taken.

    Plan: the scored rows are first counted per combination of all label
    columns (partial aggregation, few distinct combinations), only then
    fanned out to the comparison x prediction grid, so the fan-out works on
    a small table; the margins are sums over that small table.

    ``pair_flag`` names a boolean column that is true on exactly one scored
    row per (subset, pair); ``total`` is then counted in the same pass.
    Without it ``total`` is a separate distinct count over ``scored``
    (which re-reads the scored lineage).
    """
    ccols = [c for c, _ in comparisons]
    pcols = [p for p, _ in predictions]
    counted = [F.count(KEY).alias("_n")]
    if pair_flag:
        counted.append(F.count_if(F.col(pair_flag)).alias("_pairs"))
    combos = scored.groupBy("dataset", *ccols, *pcols).agg(*counted)
    carried = ["_n", "_pairs"] if pair_flag else ["_n"]
    by_comparison = combos.select(
        "dataset",
        *carried,
        *pcols,
        F.explode(_label_cells(comparisons, "comparisonColumn", "comparisonType", "comparison")).alias("_c"),
    ).select("dataset", *carried, "_c.*", *pcols)
    long = by_comparison.select(
        "dataset",
        *carried,
        "comparisonColumn",
        "comparisonType",
        "comparison",
        F.explode(_label_cells(predictions, "predictionColumn", "predictionType", "prediction")).alias("_p"),
    ).select("dataset", *carried, "comparisonColumn", "comparisonType", "comparison", "_p.*")
    cell = ["dataset", "comparisonColumn", "predictionColumn"]
    sums = [F.sum("_n").alias("a")] + ([F.sum("_pairs").alias("_pairs")] if pair_flag else [])
    counts = long.groupBy(*cell, "comparisonType", "predictionType", "comparison", "prediction").agg(*sums)
    margins = [
        F.sum("a").over(Window.partitionBy(*cell, "prediction")).alias("predictionTotal"),
        F.sum("a").over(Window.partitionBy(*cell, "comparison")).alias("comparisonTotal"),
    ]
    if pair_flag:
        # every scored row lands in exactly one value pair of each cell
        margins.append(F.sum("_pairs").over(Window.partitionBy(*cell)).alias("total"))
    with_margins = counts.select("*", *margins).where(
        F.col("prediction").isNotNull() & F.col("comparison").isNotNull()
    )
    if pair_flag:
        return with_margins.select(*CONTINGENCY_COLUMNS)
    # One row per subset: bounded by the number of subsets, safe to broadcast.
    totals = F.broadcast(pair_total(scored))
    return with_margins.join(totals, "dataset").select(*CONTINGENCY_COLUMNS)


def contingency(
    scored: DataFrame,
    comparison: str,
    prediction: str,
    comparison_type: str = "byDatatype",
    prediction_type: str = "clinical",
    pair_flag: str | None = None,
) -> DataFrame:
    """One comparison x one prediction, every subset."""
    return contingency_grid(
        scored, [(comparison, comparison_type)], [(prediction, prediction_type)], pair_flag
    )
