"""Coherence of genetic evidence with drug evidence, as Columns.

Column conventions of a scored row: the evidence side carries the counts
``GoF_risk, LoF_risk, GoF_protect, LoF_protect`` (NULL = absent) and the key
``targetIdO`` (NULL when the drug pair has no evidence in the subset); the
drug side carries ``GoF_protectC, LoF_protectC`` and ``coherency_chembl``;
``taLabelSimple`` is the disease's primary area.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DOE = "noDoE/noGenetics"


def _has(name: str) -> Column:
    return F.col(name).isNotNull()


def evidence_coherence() -> Column:
    """``coherency_others``: evidenceDif / dispar / coherent.

    Opposite directions on one axis conflict: GoF and LoF risk together,
    risk and protection of one kind together.  GoF risk with LoF protection
    (and LoF risk with GoF protection) agree.
    """
    gr, lr, gp, lp = _has("GoF_risk"), _has("LoF_risk"), _has("GoF_protect"), _has("LoF_protect")
    conflict = (gr & lr) | (lp & lr) | (gp & gr) | (gp & lp)
    return (
        F.when(~(gr | lr | gp | lp), F.lit("evidenceDif"))
        .when(conflict, F.lit("dispar"))
        .otherwise(F.lit("coherent"))
    )


def drug_coherence(gof: str = "GoF_protectC", lof: str = "LoF_protectC") -> Column:
    """``coherency_chembl``: both drug directions -> dispar, one -> coherent."""
    gp, lp = _has(gof), _has(lof)
    return (
        F.when(gp & lp, F.lit("dispar"))
        .when(gp | lp, F.lit("coherent"))
        .otherwise(F.lit("noData"))
    )


def _both_coherent() -> Column:
    return (
        _has("targetIdO")
        & (F.col("coherency_others") == "coherent")
        & (F.col("coherency_chembl") == "coherent")
    )


def _diagonal_conflict() -> Column:
    """Drug direction contradicted by genetics (either cell of its diagonal)."""
    return (_has("GoF_protectC") & (_has("LoF_protect") | _has("GoF_risk"))) | (
        _has("LoF_protectC") & (_has("GoF_protect") | _has("LoF_risk"))
    )


def _same_cell() -> Column:
    return (_has("GoF_protectC") & _has("GoF_protect")) | (
        _has("LoF_protectC") & _has("LoF_protect")
    )


def agreement(mode: str, only_doe: bool = False) -> Column:
    """Drug/genetics agreement.

    ``mode="diagonal"`` accepts any genetic cell that does not contradict the
    drug direction; ``mode="one_cell"`` needs the very same protective cell.
    With ``only_doe`` the label is coherent/dispar and NULL unless both sides
    are coherent; otherwise coherentDoE or noDoE/noGenetics.
    """
    both = _both_coherent()
    if mode == "diagonal":
        agree = ~_diagonal_conflict()
    elif mode == "one_cell":
        agree = _same_cell()
    else:
        raise ValueError(f"unknown agreement mode {mode!r}")
    if only_doe:
        return F.when(both, F.when(agree, F.lit("coherent")).otherwise(F.lit("dispar")))
    return F.when(both & agree, F.lit("coherentDoE")).otherwise(F.lit(NO_DOE))


def has_evidence() -> Column:
    return F.when(_has("targetIdO"), F.lit("GeneticEvidenceFromDS")).otherwise(
        F.lit("noGeneticEvidence")
    )


def presence_in_area(area: str) -> Column:
    """Evidence presence, only for drug pairs of the given primary area."""
    return F.when(
        F.col("taLabelSimple") == area,
        F.when(_has("targetIdO"), F.lit("hasGeneticEvidence")).otherwise(
            F.lit("noGeneticEvidence")
        ),
    )


def stratify(column: str, area: str) -> Column:
    """Keep ``column`` for pairs of the given primary area, NULL elsewhere."""
    return F.when(F.col("taLabelSimple") == area, F.col(column))


def score_columns() -> list[Column]:
    """Every derived column of a scored row, in report order, named.

    The stratified columns refer to the unstratified ones by name, so they
    must be added in a second projection (see ``operators.scoring``).
    """
    first = [
        agreement("diagonal").alias("coherency_inter"),
        agreement("one_cell").alias("coherency_inter_oneCell"),
        agreement("diagonal", only_doe=True).alias("coherencyOnlyDOE_inter"),
        agreement("one_cell", only_doe=True).alias("coherencyOnlyDOE_inter_oneCell"),
        has_evidence().alias("hasGeneticsFromDS"),
        presence_in_area("Oncology").alias("oncologyHasGeneticsFromDS"),
        presence_in_area("Other").alias("otherHasGeneticsFromDS"),
    ]
    return first


# (new column, source column) pairs; each is made for both areas.
STRATIFIED = [
    ("Ind_genetics", "geneticEvidenceAssessment"),
    ("Ind_coherency_inter", "coherency_inter"),
    ("Ind_coherency_interOneCell", "coherency_inter_oneCell"),
    ("IndOnlyDoe_coherency_inter", "coherencyOnlyDOE_inter"),
    ("IndOnlyDoe_coherency_interOneCell", "coherencyOnlyDOE_inter_oneCell"),
]
AREA_PREFIX = {"Oncology": "oncology", "Other": "other"}


def stratified_columns() -> list[Column]:
    return [
        stratify(src, area).alias(AREA_PREFIX[area] + suffix)
        for area in ("Oncology", "Other")
        for suffix, src in STRATIFIED
    ]
