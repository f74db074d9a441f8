"""Readers for evidence, entity tables, CSV annotations and inline reference data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..operators.align import union_aligned

PARTITION_COLUMN = "sourceId"
# Fixed value: the partition folder of rows without a source.
NO_SOURCE = "__HIVE_DEFAULT_PARTITION__"


def read_sources(
    spark: SparkSession,
    root: str,
    source_ids: Sequence[str | None] = V.EVIDENCE_SOURCES,
) -> dict[str | None, DataFrame]:
    """Evidence stored as ``<root>/sourceId=<name>/`` Parquet folders, by source.

    Every source is read with its own footer schema (sources differ in
    columns) and keeps ``sourceId`` as a partition column.  ``None`` is the
    folder of the rows without a source.
    """
    folder = f"{root.rstrip('/')}/{PARTITION_COLUMN}="
    return {
        s: spark.read.option("basePath", root).parquet(folder + (NO_SOURCE if s is None else s)) for s in source_ids
    }


def scan_evidence(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All sources under ``root`` as one relation, partitioned by ``sourceId``.

    The schema is that of all sources together; columns that a source lacks
    are NULL.  Without a declared ``schema`` the files' footers are read and
    merged first (a distributed pass over all footers); with one, nothing is
    read before the query.  A filter on ``sourceId`` prunes folders while the
    query is planned, a join on it while the query runs.
    """
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(root)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if PARTITION_COLUMN not in wanted.fieldNames():
        wanted = T.StructType([*wanted.fields, T.StructField(PARTITION_COLUMN, T.StringType())])
    return spark.read.schema(wanted).parquet(root)


def read_evidence(
    spark: SparkSession,
    root: str,
    source_ids: Sequence[str | None] = V.EVIDENCE_SOURCES,
) -> DataFrame:
    """The sources as one frame, aligned by name; columns a source lacks are NULL.

    A filter on ``sourceId`` leaves the other sources' scans without files; a
    caller that wants one source only reads it with :func:`read_sources`.
    """
    return union_aligned(list(read_sources(spark, root, source_ids).values()))


def read_entity(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One entity table (targets, diseases, indication, mechanismOfAction)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def read_annotations_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    bad_lines: str | None = None,
    header: bool = True,
) -> DataFrame:
    """CSV with a header (unless told otherwise), every column a string unless a schema is given.

    An empty first header cell becomes ``_c0``; quoted cells may hold commas.
    With a schema, ``bad_lines`` names a column that has the whole line where
    a cell does not fit its type, or cells are missing or too many; the cells
    that fit are kept, the others are NULL.  All other lines have NULL there.
    """
    reader = spark.read.option("header", header)
    if schema is None:
        return reader.csv(path)
    if bad_lines:
        schema = T.StructType([*schema.fields, T.StructField(bad_lines, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_lines)
    return reader.schema(schema).csv(path)


def read_study_inclusion(spark: SparkSession, path: str) -> DataFrame:
    """Hand-curated gene-burden study list: ``stMethod, count, comment, whatToDo``."""
    return read_annotations_csv(spark, path).select(
        F.col("statisticalMethodOverview").alias("stMethod"), "count", "comment", "whatToDo"
    )


def read_sequence_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Sequence ontology export: ``Accession`` and comma-separated ``Parents``."""
    return read_annotations_csv(spark, path).select("Accession", "Parents")


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def inline_table(spark: SparkSession, rows, columns: list[str], types: list[str]) -> DataFrame:
    """A small constant table as SQL ``VALUES``.

    The plan is a local relation, known in size, that Spark can broadcast.
    """
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(columns)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({cols})")


def therapeutic_areas(spark: SparkSession) -> DataFrame:
    """The 25 ranked therapeutic areas; rank is the 0-based list position."""
    rows = [(ta, label, simple, rank) for rank, (ta, label, simple) in enumerate(V.THERAPEUTIC_AREAS)]
    return inline_table(
        spark, rows, ["taId", "taLabel", "taLabelSimple", "taRank"], ["string", "string", "string", "bigint"]
    )
