"""Presence matrices: (target, disease) x label -> count, NULL when absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import vocab as V
from .assess import with_mechanisms


def count_where(cond: Column, counted: str = R.TARGET) -> Column:
    """Rows where ``cond`` holds, counting non-null ``counted``; NULL if no row holds.

    One aggregate per cell, equal to a pivot cell of ``count(counted)``: an
    absent (group, label) cell is NULL, a present one counts (possibly 0).
    """
    return F.sum(F.when(cond, F.when(F.col(counted).isNotNull(), 1).otherwise(0)))


def direction_matrix(
    df: DataFrame,
    keys: Sequence[str] = (R.TARGET, R.DISEASE),
    label: str = "unified",
    values: Sequence[str] = V.UNIFIED_VALUES,
) -> DataFrame:
    """Group by ``keys`` and count rows per label value, one column per value.

    Values are explicit (no value-discovery job, no column named after a
    NULL label).  One hash aggregation with map-side partial aggregation.
    """
    lab = F.col(label)
    return df.groupBy(*keys).agg(*[count_where(lab == v).alias(v) for v in values])


def subset_predicates() -> list[tuple[str, Column]]:
    """(subset name, row predicate) for the 13 evidence subsets, in report order."""
    src = F.col(R.SOURCE)
    preds = [(s, src == s) for s in V.SINGLE_SOURCE_SUBSETS]
    preds += [
        ("!chembl", src != V.DRUG_SOURCE),  # NULL source is excluded
        ("WOcgc", src.isin(V.WITHOUT_CGC)),
        ("somatic", src.isin(V.SOMATIC)),
        ("germline", src.isin(V.GERMLINE)),
    ]
    return preds


def label_counts(assessed: DataFrame) -> DataFrame:
    """Rows per (target, disease, source, unified label): ``rows, n, phase``.

    ``n`` counts rows with a target, ``phase`` is the largest trial phase.  At
    most one row per source and label of a pair, whatever its evidence; all
    per-pair values are folded from this table.
    """
    return assessed.groupBy(R.TARGET, R.DISEASE, R.SOURCE, "unified").agg(
        F.count(F.lit(1)).alias("rows"), F.count(R.TARGET).alias("n"), F.max("clinicalPhase").alias("phase")
    )


# Of a row of :func:`counts_by_pair`: its subsets as bits, and its label's place among the values.
SUBSETS, LABEL = "_subsets", "_label"


def counts_by_pair(counts: DataFrame, values: Sequence[str] = V.UNIFIED_VALUES) -> DataFrame:
    """:func:`label_counts` with the rows of a pair together, subsets and label as numbers.

    A pair has at most one row per source and label, so a hot pair is as small
    as any.  What moves are these narrow rows: groupings by pair above need no
    exchange of their wide rows, and their sums compare numbers, not names.
    """
    bits = F.lit(0)
    for i, (_, pred) in enumerate(subset_predicates()):
        bits = bits.bitwiseOR(F.when(pred, F.lit(1 << i)).otherwise(F.lit(0)))
    label = F.array_position(F.array(*[F.lit(v) for v in values]), F.col("unified"))
    return counts.repartition(R.TARGET, R.DISEASE).select("*", bits.alias(SUBSETS), label.cast("int").alias(LABEL))


def in_subset(index: int) -> Column:
    return F.col(SUBSETS).bitwiseAND(F.lit(1 << index)) != 0


def subset_cells(values: Sequence[str] = V.UNIFIED_VALUES) -> list[Column]:
    """Sums over the rows of :func:`counts_by_pair`: every cell of every subset's matrix (NULL = absent)."""
    return [
        F.sum(F.when(in_subset(i) & (F.col(LABEL) == k), F.col("n"))).alias(subset_column(i, v))
        for i in range(len(subset_predicates()))
        for k, v in enumerate(values, 1)
    ]


def subset_column(index: int, label: str) -> str:
    return f"s{index}_{label}"


def subset_matrix(counts: DataFrame, values: Sequence[str] = V.UNIFIED_VALUES) -> DataFrame:
    """Presence matrix of every subset at once: ``dataset, targetId, diseaseId, <values>``.

    Folded from :func:`label_counts` to one row per pair, and only then turned
    into a row for each subset that the pair is in: the copies are never
    grouped or exchanged.
    """
    pairs = counts_by_pair(counts, values).groupBy(R.TARGET, R.DISEASE).agg(*subset_cells(values), F.bit_or(SUBSETS).alias(SUBSETS))
    entries = [
        F.struct(F.lit(name).alias("dataset"), in_subset(i).alias("_in"), *[F.col(subset_column(i, v)).alias(v) for v in values])
        for i, (name, _) in enumerate(subset_predicates())
    ]
    rows = pairs.select(R.TARGET, R.DISEASE, F.explode(F.array(*entries)).alias("_m"))
    return rows.where("_m._in").select("_m.dataset", R.TARGET, R.DISEASE, *[f"_m.{v}" for v in values])


def drug_actions(drug_evidence: DataFrame, mech_pairs: DataFrame) -> DataFrame:
    """Drug evidence with its mechanism(s) and action class ``twoCategories_new``."""
    rows = drug_evidence.select(R.TARGET, "drugId", R.DISEASE, "diseaseFromSourceId", "clinicalPhase")
    joined = with_mechanisms(rows, mech_pairs)
    return joined.withColumn("twoCategories_new", R.action_class(F.col(R.ACTION)))


def action_matrix(drug_evidence: DataFrame, mech_pairs: DataFrame) -> DataFrame:
    """Per (target, disease): drug rows acting as activator / inhibitor, and
    ``coherency`` = dispar when both occur (else NULL).  Non-evaluable
    actions are left out."""
    classified = drug_actions(drug_evidence, mech_pairs).where(
        F.col("twoCategories_new") != "noEvaluable"
    )
    m = direction_matrix(
        classified, (R.TARGET, R.DISEASE), "twoCategories_new", ["activator", "inhibitor"]
    )
    return m.select(
        R.TARGET,
        R.DISEASE,
        F.col("activator").cast("int").alias("activator"),
        F.col("inhibitor").cast("int").alias("inhibitor"),
        F.when(
            F.col("activator").isNotNull() & F.col("inhibitor").isNotNull(), F.lit("dispar")
        ).alias("coherency"),
    )
