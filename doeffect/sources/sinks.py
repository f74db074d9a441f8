"""Contingency report sink: one partitioned Parquet table instead of a folder per cell."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V

PARTITIONS = ["run_date", "dataset", "comparisonColumn"]
# Declared, so that a run date that looks like a date stays the text it is.
SCHEMA = (
    "predictionColumn string, prediction string, comparison string, comparisonType string, predictionType string, "
    "a long, predictionTotal long, comparisonTotal long, total long, run_date string, dataset string, comparisonColumn string"
)


def write_contingency(report: DataFrame, path: str, run_date: str) -> None:
    """Write the report under ``path`` partitioned by run date, subset and comparison.

    The run date's folder is overwritten as a whole, so a run that is repeated
    leaves exactly its own rows, also where it has fewer cells than the run
    before; other run dates are not touched.  The report is small (a few rows
    per cell), so each partition is written as one file.
    """
    within = PARTITIONS[1:]
    (
        report.repartition(*within)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*within)
        # The folder's name as Spark escapes it: a date or a plain word stays as it is.
        .parquet(f"{path.rstrip('/')}/run_date={quote(run_date, safe=' -_.!~()@$,;&+')}")
    )


def read_contingency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def contingency_manifest(
    written: DataFrame,
    run_date: str,
    datasets: Sequence[str] = V.SUBSET_NAMES,
    comparisons: Sequence[tuple[str, str]] = V.COMPARISONS,
    predictions: Sequence[tuple[str, str]] = V.PREDICTIONS,
) -> DataFrame:
    """One row per cell of the report, empty ones included, with its rows and
    its path ``<run date>_original/_<subset>_<comparison>_<prediction>.parquet``."""
    keys = ["dataset", "comparisonColumn", "predictionColumn"]
    names = [list(datasets), [c for c, _ in comparisons], [p for p, _ in predictions]]
    cells = written.sparkSession.range(1).select(F.lit(run_date).alias("run_date"))
    for key, values in zip(keys, names):
        cells = cells.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    rows = written.where(F.col("run_date") == run_date).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    name = F.concat(F.lit("_"), F.concat_ws("_", *keys))
    return cells.join(rows, keys, "left").select(
        "run_date",
        *keys,
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.concat("run_date", F.lit("_original/"), name, F.lit(".parquet")).alias("path"),
    )


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the report with what is in it, from the files
    themselves: ``run_date, dataset, comparisonColumn, folder`` (below
    ``path``), ``file_path, file_bytes, rows``."""
    file = F.col("_metadata.file_path")
    below = F.regexp_extract(file, "(run_date=[^/]*/dataset=[^/]*/comparisonColumn=[^/]*)/[^/]*$", 1)
    return (
        read_contingency(spark, path)
        .groupBy(*PARTITIONS, below.alias("folder"), file.alias("file_path"), F.col("_metadata.file_size").alias("file_bytes"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
