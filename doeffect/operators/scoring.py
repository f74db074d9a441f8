"""Score every evidence subset against the drug spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coherence as C
from ..functions import rules as R
from ..functions import vocab as V
from .clinical import PAIR_FLAG, SPINE_COLUMNS, subset_column
from .matrix import subset_predicates

EVIDENCE_COLUMNS = ["targetIdO", "diseaseIdO", *V.MATRIX_COLUMNS, "coherency_others"]
SCORE_COLUMNS = [
    "coherency_inter",
    "coherency_inter_oneCell",
    "coherencyOnlyDOE_inter",
    "coherencyOnlyDOE_inter_oneCell",
    "hasGeneticsFromDS",
    "oncologyHasGeneticsFromDS",
    "otherHasGeneticsFromDS",
]
STRATIFIED_COLUMNS = [
    C.AREA_PREFIX[area] + suffix for area in ("Oncology", "Other") for suffix, _ in C.STRATIFIED
]
PHASE_COLUMNS = [name for name, _, _ in V.PHASE_EXACT + V.PHASE_AT_LEAST]
SCORED_COLUMNS = ["dataset", *EVIDENCE_COLUMNS, *SPINE_COLUMNS, *SCORE_COLUMNS,
                  *STRATIFIED_COLUMNS, *PHASE_COLUMNS]


def _finish(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Add the 25 derived columns to rows that hold spine + evidence columns."""
    step1 = rows.select("*", *C.score_columns())
    step2 = step1.select("*", *C.stratified_columns(), *R.phase_flags(F.col("maxClinPhase_ext")))
    return step2.select(*SCORED_COLUMNS, *(extra or []))


def score(spine_with_subsets: DataFrame, keep_pair_flag: bool = False) -> DataFrame:
    """One scored row per (subset, spine row): every subset keeps every spine row.

    Input: :func:`clinical_spine` with ``keep_subsets=True``.  The 13 subset
    cells of a row are turned into 13 rows by one generator (no join and no
    shuffle).  The evidence side is present when the subset has any row for
    the pair; its key and counts are NULL otherwise (and for NULL keys,
    which never match by equality).  ``keep_pair_flag`` keeps the
    one-row-per-pair flag for :func:`contingency_grid`.
    """
    entries = []
    for i, (name, _) in enumerate(subset_predicates()):
        fields = [F.lit(name).alias("dataset")]
        fields += [F.col(subset_column(i, v)).alias(v) for v in V.UNIFIED_VALUES]
        entries.append(F.struct(*fields))
    carried = [*SPINE_COLUMNS, PAIR_FLAG]
    rows = spine_with_subsets.select(*carried, F.explode(F.array(*entries)).alias("_m"))
    rows = rows.select(*carried, "_m.*")
    return _finish(_evidence_side(rows, [PAIR_FLAG]), [PAIR_FLAG] if keep_pair_flag else None)


def _evidence_side(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    known = F.col("targetIdC").isNotNull() & F.col("diseaseIdC").isNotNull()
    present: Column = F.lit(False)
    for v in V.UNIFIED_VALUES:
        present = present | F.col(v).isNotNull()
    has = known & present
    counts = [F.when(has, F.col(v)).alias(v) for v in V.MATRIX_COLUMNS]
    keyed = rows.select(
        "dataset",
        *SPINE_COLUMNS,
        *(extra or []),
        F.when(has, F.col("targetIdC")).alias("targetIdO"),
        F.when(has, F.col("diseaseIdC")).alias("diseaseIdO"),
        *counts,
    )
    return keyed.withColumn(
        "coherency_others", F.when(F.col("targetIdO").isNotNull(), C.evidence_coherence())
    )
