"""Direction-of-effect assessment, source by source.

Evidence comes as one frame per source (as it is stored), so every source
has a short plan of its own: its folder, the one side table its rules need,
and one CASE.  A query for one source reads that source alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from .align import union_aligned
from .annotate import consequence_count
from .skew import split_left_join

CONSEQUENCE_SCHEMA = T.ArrayType(
    T.StructType([T.StructField("functionalConsequenceId", T.StringType(), True)])
)

# Columns the rules read, with the type used when a source lacks them.
RULE_INPUTS = {
    R.BETA: T.DoubleType(),
    R.ODDS: T.DoubleType(),
    R.VARIANT: T.StringType(),
    R.QTL: T.StringType(),
    R.SIGNIFICANCE: T.ArrayType(T.StringType()),
    R.METHOD: T.StringType(),
    "mutatedSamples": CONSEQUENCE_SCHEMA,
    "drugId": T.StringType(),
    "clinicalPhase": T.DoubleType(),
}
# The side table that a source's rules read.
NEEDS = {
    "gene_burden": "study",
    "cancer_gene_census": "label",
    "intogen": "counts",
    "chembl": "mechanisms",
}


@dataclass
class Sides:
    """Side tables of the annotation."""

    label: DataFrame  # target_id, approvedSymbol, description, TSorOncogene
    study: DataFrame  # stMethod, whatToDo, ...
    mechanisms: DataFrame  # drugId2, targetId2, actionType, mechanismOfAction


def prepare(evidence: DataFrame) -> DataFrame:
    """Typed rule inputs: float effect sizes, joined significances.

    ``try_cast`` keeps a malformed effect size NULL instead of failing the
    job under ANSI mode.  Missing rule inputs are added as typed NULLs.
    """
    columns = evidence.columns
    present = {c.lower() for c in columns}
    typed = {
        R.BETA: lambda c: c.try_cast("float"),
        R.ODDS: lambda c: c.try_cast("float"),
        R.SIGNIFICANCE: lambda c: F.concat_ws(",", c),
    }
    inputs = {c: F.col(c) if c.lower() in present else F.lit(None).cast(t) for c, t in RULE_INPUTS.items()}
    inputs = {c: typed[c](x).alias(c) if c in typed else x.alias(c) for c, x in inputs.items()}
    read = {c.lower() for c in inputs}
    return evidence.select(*[c for c in columns if c.lower() not in read], *inputs.values())


def with_counts(evidence: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the consequence count: rows of the drivers' source see that source's
    arrays, all others every array of the pair; 0 where there are none."""
    side = counts.select(F.col(R.TARGET).alias("_ct"), F.col(R.DISEASE).alias("_cd"), "own", "every")
    same = F.col(R.TARGET).eqNullSafe(F.col("_ct")) & F.col(R.DISEASE).eqNullSafe(F.col("_cd"))
    own = F.col(R.SOURCE).eqNullSafe("intogen")
    count = F.coalesce(F.when(own, F.col("own")).otherwise(F.col("every")), F.lit(0))
    return evidence.join(side, same, "left").withColumn(R.CONSEQUENCE_COUNT, count).drop("_ct", "_cd", "own", "every")


def _left(evidence: DataFrame, side: DataFrame, on: list[tuple[str, str]], split: int) -> DataFrame:
    """Left join without the side's keys; hot keys are dealt over ``split`` places if it is given."""
    if split:
        joined = split_left_join(evidence, side, on, split)
    else:
        joined = evidence.join(side, [F.col(a) == F.col(b) for a, b in on], "left")
    return joined.drop(*[b for _, b in on])


def with_label(evidence: DataFrame, label: DataFrame, split: int = 0) -> DataFrame:
    return _left(evidence, label, [(R.TARGET, "target_id")], split)


def with_study(evidence: DataFrame, study: DataFrame, split: int = 0) -> DataFrame:
    return _left(evidence, study, [(R.METHOD, "stMethod")], split)


def with_mechanisms(evidence: DataFrame, mechanisms: DataFrame, split: int = 0) -> DataFrame:
    """Add the drug's mechanisms on the target (a row for each)."""
    return _left(evidence, mechanisms, [("drugId", "drugId2"), (R.TARGET, "targetId2")], split)


JOINS = {"counts": with_counts, "label": with_label, "study": with_study, "mechanisms": with_mechanisms}


def normal_forms() -> list[Column]:
    """``homogenized, tendency, variation, unified`` of ``Assessment``."""
    homogenized = F.col("homogenized")
    return [
        R.homogenize(F.col("Assessment")).alias("homogenized"),
        R.tendency(homogenized).alias("tendency"),
        R.variation(homogenized).alias("variation"),
        R.unify(F.col("Assessment"), homogenized).alias("unified"),
    ]


def label(annotated: DataFrame, source: str, params: R.RuleParams) -> DataFrame:
    """Add ``Assessment`` by the rules of ``source`` (NULL without rules) and its normal forms."""
    assessment = F.lit(None).cast("string")
    if source in R.SOURCE_RULES:
        assessment = F.when(F.col(R.SOURCE) == source, R.source_assessment(source, params))
    # Each column may use those before it in the list.
    return annotated.select("*", assessment.alias("Assessment"), *normal_forms())


def branch(
    source: str, evidence: DataFrame, sides: Mapping[str, DataFrame], params: R.RuleParams, split: int = 0
) -> DataFrame:
    """The assessed rows of one source, with the given side tables joined (see :func:`assess` for ``split``)."""
    ev = prepare(evidence)
    for name, side in sides.items():
        # The counts are of the pair itself: see ``with_counts``.
        ev = JOINS[name](ev, side) if name == "counts" else JOINS[name](ev, side, split)
    return label(ev, source, params)


def counts_of(frames: Mapping[str, DataFrame]) -> DataFrame | None:
    """Consequence counts over all frames that carry consequences."""
    held = [
        f.select(R.TARGET, R.DISEASE, R.SOURCE, "mutatedSamples") for f in frames.values() if "mutatedSamples" in f.columns
    ]
    return consequence_count(union_aligned(held)) if held else None


def assess(
    frames: Mapping[str, DataFrame],
    sides: Sides,
    params: R.RuleParams,
    full: bool = False,
    only: str | None = None,
    split: int = 0,
) -> DataFrame:
    """Per-source evidence -> assessed evidence (one row per evidence row, or
    more where a drug has several mechanisms on the target).

    Every source is joined with the side its rules need.  With ``full`` every
    row also gets the gene label, the consequence count, and, where the source
    has a study method or a drug, the study's and the mechanism's columns.
    ``only`` assesses a single source.  Frames of sources without rules are
    kept with a NULL assessment.  With ``split`` the joins with genes, studies
    and mechanisms deal the rows of hot keys over that many places (see
    ``operators.skew``) instead of resting on a broadcast or the adaptive plan.
    """
    tables = {"label": sides.label, "study": sides.study, "mechanisms": sides.mechanisms}
    every_count = counts_of(frames) if full else None
    out = []
    for source, frame in frames.items():
        if only is not None and source != only:
            continue
        wanted = [NEEDS[source]] if source in NEEDS else []
        if full:
            own = [("study", R.METHOD), ("mechanisms", "drugId")]
            wanted = ["counts", "label", *[name for name, column in own if column in frame.columns]]
        joined = {name: tables[name] for name in wanted if name in tables}
        # Rules that read the count see their own source's arrays alone.
        if "counts" in wanted and (counts := every_count if full else counts_of({source: frame})) is not None:
            joined["counts"] = counts
        out.append(branch(source, frame, joined, params, split))
    return union_aligned(out)
