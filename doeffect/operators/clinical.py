"""Drug-side ("clinical") operators and the per-pair evidence profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coherence as C
from ..functions import rules as R
from ..functions import vocab as V
from .matrix import LABEL, counts_by_pair, subset_cells, subset_column

# Internal flag: true on exactly one spine row per (target, disease) pair.
PAIR_FLAG = "_pair_first"

SPINE_COLUMNS = [
    "targetIdC",
    "datasourceIdC",
    "diseaseIdC",
    "LoF_protectC",
    "GoF_protectC",
    "coherency_chembl",
    "maxClinPhase_ext",
    "Nr_evidences",
    "geneticEvidence",
    "taLabelSimple",
    "geneticEvidenceAssessment",
]


def _is_drug() -> Column:
    return F.col(R.SOURCE) == V.DRUG_SOURCE


def max_phase(drug_evidence: DataFrame) -> DataFrame:
    """``targetId, diseaseId, maxClinPhase`` over drug evidence."""
    return drug_evidence.groupBy(R.TARGET, R.DISEASE).agg(
        F.max("clinicalPhase").alias("maxClinPhase")
    )


def evidence_presence(assessed: DataFrame) -> DataFrame:
    """``targetId, diseaseId, Nr_evidences, geneticEvidence`` from non-drug rows.

    Every row counts, evaluable or not; rows with a NULL source are left out.
    """
    return (
        assessed.where(F.col(R.SOURCE) != V.DRUG_SOURCE)
        .groupBy(R.TARGET, R.DISEASE)
        .agg(F.count(R.TARGET).alias("Nr_evidences"))
        .withColumn("geneticEvidence", F.lit("hasGeneticEvidence"))
    )


def evaluable_sources(counts: DataFrame) -> DataFrame:
    """``targetId, diseaseId, datasourceIds``: sorted non-drug sources with a
    directional (or bivalent-intogen) assessment, from :func:`label_counts`.

    The unified label of every other assessment is ``evidenceDif``.  At most
    one entry per source, so the collected set is bounded.
    """
    usable = (F.col("unified") != "evidenceDif") & (F.col(R.SOURCE) != V.DRUG_SOURCE)
    return (
        counts.groupBy(R.TARGET, R.DISEASE)
        .agg(F.sort_array(F.collect_set(F.when(usable, F.col(R.SOURCE)))).alias("datasourceIds"))
        .where(F.size("datasourceIds") > 0)
    )


def drug_pairs(drug_evidence: DataFrame) -> DataFrame:
    """Distinct (target, disease) pairs with drug evidence: the spine keys."""
    return (
        drug_evidence.where(_is_drug())
        .select(F.col(R.TARGET).alias("_pt"), F.col(R.DISEASE).alias("_pd"))
        .distinct()
    )


def restrict_to_drug_pairs(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of every source whose pair has drug evidence.

    Every value of the spine and of the scoring is an aggregate over the rows
    of one drug pair, so rows of other pairs leave before anything is joined
    to them.  NULL keys match NULL keys, as grouping does.  The semi join has
    no hint: Spark broadcasts the pairs if they are small in bytes.
    """
    pairs = drug_pairs(frames[V.DRUG_SOURCE])
    same = F.col(R.TARGET).eqNullSafe(F.col("_pt")) & F.col(R.DISEASE).eqNullSafe(F.col("_pd"))
    return {source: frame.join(pairs, same, "left_semi") for source, frame in frames.items()}


def pair_profile(counts: DataFrame) -> DataFrame:
    """Everything the scoring needs, per (target, disease), from :func:`label_counts`.

    For each of the 13 subsets and each unified label: the cell of that
    subset's presence matrix (NULL = absent).  For the drug rows: row count,
    protective-direction counts, max trial phase.  For non-drug rows: the
    evidence count.
    """
    n, label = F.col("n"), {v: F.col(LABEL) == k for k, v in enumerate(V.UNIFIED_VALUES, 1)}
    # Each computed once per row, not once per sum.
    rows = counts_by_pair(counts).withColumns({"_drug": _is_drug(), "_other": F.col(R.SOURCE) != V.DRUG_SOURCE})
    drug = F.col("_drug")
    aggs = [
        *subset_cells(),
        F.coalesce(F.sum(F.when(drug, F.col("rows"))), F.lit(0)).alias("drug_rows"),
        # The drug rules give directions whose unified label is the same.
        F.sum(F.when(drug & label["LoF_protect"], n)).alias("LoF_protectC"),
        F.sum(F.when(drug & label["GoF_protect"], n)).alias("GoF_protectC"),
        F.max(F.when(drug, F.col("phase"))).alias("maxClinPhase"),
        F.sum(F.when(F.col("_other"), n)).alias("Nr_evidences"),
    ]
    return rows.groupBy(R.TARGET, R.DISEASE).agg(*aggs)


def clinical_spine(profile: DataFrame, area: DataFrame, keep_subsets: bool = False) -> DataFrame:
    """Drug (target, disease) pairs with drug directions, phase, evidence flag and area.

    ``area`` is :func:`primary_area` output; a disease with tied areas gives
    one spine row per area.  Pairs whose drugs have no usable action stay in
    as ``noData``.  Side values joined by key equality are NULL for a pair
    with a NULL key.  With ``keep_subsets`` the rows also carry the subset
    cells of :func:`pair_profile` and the one-row-per-pair flag ``PAIR_FLAG``.
    """
    known = F.col(R.TARGET).isNotNull() & F.col(R.DISEASE).isNotNull()
    subset_cols = [c for c in profile.columns if c.startswith("s") and c[1:2].isdigit()]
    spine = profile.where(F.col("drug_rows") > 0).select(
        F.col(R.TARGET).alias("targetIdC"),
        F.lit(V.DRUG_SOURCE).alias("datasourceIdC"),
        F.col(R.DISEASE).alias("diseaseIdC"),
        F.col("LoF_protectC").cast("int").alias("LoF_protectC"),
        F.col("GoF_protectC").cast("int").alias("GoF_protectC"),
        F.when(known, F.col("maxClinPhase")).alias("maxClinPhase_ext"),
        F.when(known, F.col("Nr_evidences")).alias("Nr_evidences"),
        F.when(known & F.col("Nr_evidences").isNotNull(), F.lit("hasGeneticEvidence")).alias(
            "geneticEvidence"
        ),
        *(subset_cols if keep_subsets else []),
    )
    spine = spine.withColumn("coherency_chembl", C.drug_coherence())
    # Tied areas repeat a pair; flag one row per pair so distinct pairs can
    # be counted later without a second pass over the evidence.
    first = Window.partitionBy("diseaseId").orderBy("taLabelSimple")
    side = area.select(
        F.col("diseaseId").alias("_area_disease"),
        "taLabelSimple",
        (F.row_number().over(first) == 1).alias("_first_area"),
    )
    spine = spine.join(side, F.col("diseaseIdC") == F.col("_area_disease"), "left").drop("_area_disease")
    spine = spine.withColumns(
        {
            "geneticEvidenceAssessment": F.when(
                F.col("geneticEvidence").isNotNull(), F.lit("hasGenetics")
            ).otherwise(F.lit("noGenetics")),
            PAIR_FLAG: F.coalesce(F.col("_first_area"), F.lit(True)),
        }
    )
    extra = [PAIR_FLAG, *subset_cols] if keep_subsets else []
    return spine.select(*SPINE_COLUMNS, *extra)
