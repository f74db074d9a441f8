"""Direction-of-effect rules as data, folded into Spark Columns.

Each evidence source has an ordered list of ``(condition, outcome)`` rules
and a default.  The first rule whose condition is true decides the label.
An outcome can itself be a conditional Column that yields NULL (for example
"risk if the odds ratio is above 1, protective if below"): that NULL is the
final answer for the row, it does not fall through to the next rule.

All functions return Columns built from ``pyspark.sql.functions`` so a
source's assessment compiles into one projection inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

Rule = tuple[Column, Column]

# Input column names of the unified evidence frame.
TARGET = "targetId"
DISEASE = "diseaseId"
SOURCE = "datasourceId"
BETA = "beta"
ODDS = "oddsRatio"
VARIANT = "variantFunctionalConsequenceId"
QTL = "variantFunctionalConsequenceFromQtlId"
SIGNIFICANCE = "clinicalSignificances"
METHOD = "statisticalMethodOverview"
CONSEQUENCES = "mutatedSamples.functionalConsequenceId"
ONCO_LABEL = "TSorOncogene"
STUDY_DECISION = "whatToDo"
ACTION = "actionType"
CONSEQUENCE_COUNT = "intogenAnnot"


@dataclass(frozen=True)
class RuleParams:
    """Vocabularies the rules need.

    ``var_filter_lof`` (variant consequences counted as loss of function) has
    no default and must be given.  ``gof``/``lof`` are the consequence ids the
    somatic-driver rule looks for.
    """

    var_filter_lof: Sequence[str]
    gof: Sequence[str] = field(default_factory=lambda: list(V.DEFAULT_GOF))
    lof: Sequence[str] = field(default_factory=lambda: list(V.DEFAULT_LOF))


def first_match(rules: Sequence[Rule], default: Column | str | None = None) -> Column:
    """Fold ordered rules into one CASE WHEN ... [ELSE default] END."""
    if not rules:
        raise ValueError("at least one rule is needed")
    cond, out = rules[0]
    expr = F.when(cond, out)
    for cond, out in rules[1:]:
        expr = expr.when(cond, out)
    if default is not None:
        expr = expr.otherwise(F.lit(default) if isinstance(default, str) else default)
    return expr


def _lit(label: str) -> Column:
    return F.lit(label)


def effect_from_odds(kind: str, odds: Column | None = None) -> Column:
    """``<kind>_risk`` above 1, ``<kind>_protect`` below 1, NULL at 1 or NULL."""
    o = F.col(ODDS) if odds is None else odds
    return F.when(o > 1, _lit(f"{kind}_risk")).when(o < 1, _lit(f"{kind}_protect"))


def effect_from_beta(kind: str, beta: Column | None = None) -> Column:
    """``<kind>_risk`` above 0, ``<kind>_protect`` below 0, NULL at 0 or NULL."""
    b = F.col(BETA) if beta is None else beta
    return F.when(b > 0, _lit(f"{kind}_risk")).when(b < 0, _lit(f"{kind}_protect"))


# ---------------------------------------------------------------------------
# Rule sets, one per source.  Each returns (rules, default).
# ---------------------------------------------------------------------------


def genetics_portal_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    v, q = F.col(VARIANT), F.col(QTL)
    b_missing, o_missing = F.col(BETA).isNull(), F.col(ODDS).isNull()
    in_lof = v.isin(list(p.var_filter_lof))
    # Three-valued: a NULL variant is neither in nor out of the list.
    out_lof = in_lof == F.lit(False)
    level_unresolved = (q == V.SO_NO_LEVEL_CHANGE) | q.isNull()
    # (QTL condition, variant condition, effect class), in priority order.
    # Each case yields two rules: the odds ratio decides when beta is
    # missing, beta decides when the odds ratio is missing.
    cases = [
        (q == V.SO_INCREASED_LEVEL, out_lof, "GoF"),
        (q == V.SO_DECREASED_LEVEL, in_lof, "LoF"),
        (q == V.SO_DECREASED_LEVEL, out_lof, "LoF"),
        (level_unresolved, in_lof, "LoF"),
    ]
    # A QTL raising expression next to a loss-of-function variant contradicts.
    rules: list[Rule] = [((q == V.SO_INCREASED_LEVEL) & in_lof, _lit("dispar"))]
    for qtl_cond, var_cond, kind in cases:
        rules.append((b_missing & qtl_cond & var_cond, effect_from_odds(kind)))
        rules.append((o_missing & qtl_cond & var_cond, effect_from_beta(kind)))
    return rules, "noEvaluable"


def gene_burden_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    b, o = F.col(BETA), F.col(ODDS)
    kept = F.col(STUDY_DECISION) == "get"
    rules = [
        (kept & b.isNull() & (o > 1), _lit("LoF_risk")),
        (kept & b.isNull() & (o < 1), _lit("LoF_protect")),
        (kept & o.isNull() & (b > 0), _lit("LoF_risk")),
        (kept & o.isNull() & (b < 0), _lit("LoF_protect")),
    ]
    return rules, "noEvaluable"


def clinvar_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    """Germline and somatic clinical-variant sources share one rule set.

    ``clinicalSignificances`` is the comma-joined list, so the end-anchored
    pattern looks at the last listed significance only.
    """
    in_lof = F.col(VARIANT).isin(list(p.var_filter_lof))
    sig = F.col(SIGNIFICANCE)
    rules = [
        (in_lof & sig.rlike("(pathogenic)$"), _lit("LoF_risk")),
        (sig.contains("protective") & in_lof, _lit("LoF_protect")),
    ]
    return rules, "noEvaluable"


def gene2phenotype_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    v = F.col(VARIANT)
    rules = [
        (v == V.SO_ABSENT_PRODUCT, _lit("LoF_risk")),
        (v == V.SO_INCREASED_LEVEL, _lit("GoF_risk")),
    ]
    return rules, "noEvaluable"


def orphanet_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    v = F.col(VARIANT)
    rules = [
        (v == V.SO_LOSS_OF_FUNCTION, _lit("LoF_risk")),
        (v == V.SO_GAIN_OF_FUNCTION, _lit("GoF_risk")),
    ]
    return rules, "noEvaluable"


def cancer_census_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    label = F.col(ONCO_LABEL)
    rules = [
        (label == "oncogene", _lit("GoF_risk")),
        (label == "TSG", _lit("LoF_risk")),
        (label == "bivalent", _lit("bivalent_risk")),
    ]
    return rules, None  # unlabelled genes stay NULL


def intogen_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    n = F.col(CONSEQUENCE_COUNT)
    ids = F.col(CONSEQUENCES)

    def hits(values: Sequence[str]) -> Column:
        return F.arrays_overlap(ids, F.array(*[F.lit(x) for x in values]))

    one_kind = F.when(hits(p.gof), _lit("GoF_risk")).when(hits(p.lof), _lit("LoF_risk"))
    rules = [
        (n == 1, one_kind),
        (n > 1, _lit("bivalentIntogen")),
    ]
    return rules, "noEvaluable"


def mouse_model_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    return [(F.col(DISEASE).isNotNull(), _lit("KO_risk"))], "noEvaluable"


def drug_rules(p: RuleParams) -> tuple[list[Rule], str | None]:
    action = F.col(ACTION)
    rules = [
        (action.isin(V.INHIBITORS), _lit("LoF_protect")),
        (action.isin(V.ACTIVATORS), _lit("GoF_protect")),
    ]
    return rules, "noEvaluable"


SOURCE_RULES = {
    "ot_genetics_portal": genetics_portal_rules,
    "gene_burden": gene_burden_rules,
    "eva": clinvar_rules,
    "eva_somatic": clinvar_rules,
    "gene2phenotype": gene2phenotype_rules,
    "orphanet": orphanet_rules,
    "cancer_gene_census": cancer_census_rules,
    "intogen": intogen_rules,
    "impc": mouse_model_rules,
    "chembl": drug_rules,
}


def source_assessment(source: str, params: RuleParams) -> Column:
    """The label of one source's rule set."""
    rules, default = SOURCE_RULES[source](params)
    return first_match(rules, default)


# ---------------------------------------------------------------------------
# Label normalisation.
# ---------------------------------------------------------------------------


def homogenize(label: Column) -> Column:
    return (
        F.when(label == "KO_risk", _lit("LoF_risk"))
        .when(label == "bivalentIntogen", _lit("bivalent_risk"))
        .otherwise(label)
    )


def tendency(homogenized: Column) -> Column:
    return (
        F.when(homogenized.contains("risk"), _lit("Risk"))
        .when(homogenized.contains("protect"), _lit("Protect"))
        .otherwise(_lit("noEvaluable"))
    )


def variation(homogenized: Column) -> Column:
    return (
        F.when(homogenized.contains("LoF"), _lit("LoF"))
        .when(homogenized.contains("GoF"), _lit("GoF"))
        .otherwise(_lit("noEvaluable"))
    )


def unify(label: Column, homogenized: Column) -> Column:
    """Label used by the presence matrix: every non-direction is evidenceDif."""
    return (
        F.when(label.isin(V.NON_DIRECTIONAL_TERMS), _lit("evidenceDif"))
        .when(label.isNull(), _lit("evidenceDif"))
        .when(label == "KO_risk", _lit("LoF_risk"))
        .otherwise(homogenized)
    )


def action_class(action: Column) -> Column:
    return (
        F.when(action.isin(V.INHIBITORS), _lit("inhibitor"))
        .when(action.isin(V.ACTIVATORS), _lit("activator"))
        .otherwise(_lit("noEvaluable"))
    )


def onco_class(descriptions: Column) -> Column:
    """Classify a gene from its set of hallmark descriptions.

    Element-wise and so independent of set order: both an oncogene term and
    a TSG term anywhere -> bivalent; an element with "ncogene" at a word end
    -> oncogene; an element with "TSG" at a word end -> TSG.
    """

    def any_match(pattern: str) -> Column:
        return F.exists(descriptions, lambda d: d.rlike(pattern))

    return (
        F.when(any_match("ncogene") & any_match("TSG"), _lit("bivalent"))
        .when(any_match(r"ncogene(\s|$)"), _lit("oncogene"))
        .when(any_match(r"TSG(\s|$)"), _lit("TSG"))
        .otherwise(_lit("noEvaluable"))
    )


def phase_flags(phase: Column) -> list[Column]:
    """The eight trial-phase flag columns, named."""
    cols = [
        F.when(phase == value, _lit(label)).otherwise(_lit(V.PHASE_OTHER)).alias(name)
        for name, value, label in V.PHASE_EXACT
    ]
    cols += [
        F.when(phase >= value, _lit(label)).otherwise(_lit(V.PHASE_OTHER)).alias(name)
        for name, value, label in V.PHASE_AT_LEAST
    ]
    return cols
