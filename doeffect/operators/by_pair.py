"""Evidence laid out by (target, disease) pair: bucketed tables.

Every value of the report is an aggregate over the rows of a pair.  Evidence
that is written once into buckets of its pair is then read as it is grouped:
the semi join with the drug pairs, the consequence counts and the label counts
need no exchange, in this run and in every later one.

NULL keys are a pair like any other here, as in grouping, so the buckets are
of two key columns that are never NULL.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import vocab as V
from .annotate import consequence_count
from .assess import NEEDS, Sides, branch
from .align import union_aligned

KEYS = ("pairTarget", "pairDisease")


def with_pair_keys(evidence: DataFrame) -> DataFrame:
    """Add the pair's keys: the id after an equals sign, or nothing for NULL."""
    keys = {k: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for k, c in zip(KEYS, (R.TARGET, R.DISEASE))}
    return evidence.withColumns(keys)


def pair_ids() -> list[Column]:
    """The pair's ids from its keys."""
    ids = zip(KEYS, (R.TARGET, R.DISEASE))
    return [F.when(F.col(k) != "", F.substring(k, 2, 2**31 - 1)).alias(c) for k, c in ids]


def write_by_pair(frames: Mapping[str, DataFrame], folder: str, buckets: int) -> dict[str, str]:
    """Write each source as a table in ``buckets`` buckets of the pair, sorted by
    it, under ``folder``; returns the tables' names by source.

    The tables are external: dropping them from the catalog leaves the files to
    the folder's owner.  One shuffle by bucket each, so that a bucket is one file.  Rows of a hot
    pair share a bucket: choose this layout where pairs are small beside a
    bucket, and the counting of ``label_counts`` otherwise.
    """
    names = {}
    for source, frame in frames.items():
        name = f"evidence_by_pair_{source}_{uuid.uuid4().hex}"
        (
            with_pair_keys(frame)
            .repartition(buckets, *KEYS)
            .write.bucketBy(buckets, *KEYS)
            .sortBy(*KEYS)
            .option("path", f"{folder}/{source}")
            .saveAsTable(name)
        )
        names[source] = name
    return names


def read_by_pair(spark: SparkSession, names: Mapping[str, str]) -> dict[str, DataFrame]:
    return {source: spark.table(name) for source, name in names.items()}


def drug_pair_label_counts(frames: Mapping[str, DataFrame], sides: Sides, params: R.RuleParams) -> DataFrame:
    """:func:`doeffect.operators.matrix.label_counts` of the assessed evidence of
    drug pairs, from frames that :func:`read_by_pair` gives.

    Sides that Spark broadcasts leave the rows in their buckets; then nothing
    of the evidence is exchanged.  A source is in one frame, so each frame is
    counted on its own.
    """
    drug = frames[V.DRUG_SOURCE]
    pairs = drug.where(F.col(R.SOURCE) == V.DRUG_SOURCE).select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
    here = [F.col(k) == F.col(f"_{k}") for k in KEYS]
    tables = {"study": sides.study, "label": sides.label, "mechanisms": sides.mechanisms}
    out = []
    for source, frame in frames.items():
        kept = frame.join(pairs, here, "left_semi")
        joined = {}
        if NEEDS.get(source) == "counts":
            counts = consequence_count(kept, keys=KEYS)
            own = counts.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "own")
            kept = kept.join(own, here, "left").withColumn(R.CONSEQUENCE_COUNT, F.coalesce("own", F.lit(0)))
            kept = kept.drop("own", *[f"_{k}" for k in KEYS])
        elif source in NEEDS:
            joined[NEEDS[source]] = tables[NEEDS[source]]
        # The two ids follow from the keys, after the grouping: it has no strings to keep and needs no sort.
        counted = branch(source, kept, joined, params).groupBy(*KEYS, R.SOURCE, "unified").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(R.TARGET).alias("n"),
            F.max("clinicalPhase").alias("phase"),
        )
        out.append(counted.select(*pair_ids(), R.SOURCE, "unified", "rows", "n", "phase"))
    return union_aligned(out)
