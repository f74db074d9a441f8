"""DuckDB SQL oracle for every registered query.

Written in the literal shape of the analysis (one pivot per subset as a
UNION ALL arm, the drug spine by joins, contingency margins by three
windows and DISTINCT), independent of the Spark plans in ``registry``.
Tables ``lineitem``, ``part`` and ``nation`` are the driver's views.
"""

from __future__ import annotations

from ..functions import vocab as V
from ..sources.fixtures import FIXTURE_VAR_FILTER_LOF
from .registry import ASSESSED_BASE, OTHER_RUN, RERUN_SUBSETS, ROUNDTRIP_RUN, SOURCE_EXTRA


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _joined(expr: str) -> str:
    """Array -> 'a|b' with NULL entries spelled NULL (the Spark side's array_join)."""
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(x, 'NULL')), '|')"


L = _list(FIXTURE_VAR_FILTER_LOF)
INHIBITORS = _list(V.INHIBITORS)
ACTIVATORS = _list(V.ACTIVATORS)
TERMS = _list(V.NON_DIRECTIONAL_TERMS)

_TA_ROWS = ",\n    ".join(
    f"('{ta}', '{label}', '{simple}', {rank})"
    for rank, (ta, label, simple) in enumerate(V.THERAPEUTIC_AREAS)
)

# --- derived inputs ----------------------------------------------------------
BASE = f"""
ev_k AS (
  SELECT *,
    l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31 + l_suppkey * 3 AS k0,
    CAST(floor((l_orderkey * 11 + l_partkey * 17 + l_linenumber * 5) / 3.0) AS BIGINT) AS k2
  FROM lineitem),
ev_k1 AS (SELECT *, CAST(floor(k0 / 10.0) AS BIGINT) AS k1 FROM ev_k),
ev_s AS (SELECT *,
    CASE WHEN k0 % 101 = 0 THEN CASE (k0 // 101) % 4 WHEN 0 THEN 'genomics_england' WHEN 1 THEN 'uniprot_literature'
      WHEN 2 THEN 'uniprot_variants' ELSE 'clingen' END WHEN k0 % 103 = 1 THEN NULL ELSE CASE k0 % 10 WHEN 0 THEN 'ot_genetics_portal' WHEN 1 THEN 'gene_burden' WHEN 2 THEN 'eva'
      WHEN 3 THEN 'eva_somatic' WHEN 4 THEN 'gene2phenotype' WHEN 5 THEN 'orphanet'
      WHEN 6 THEN 'cancer_gene_census' WHEN 7 THEN 'intogen' WHEN 8 THEN 'impc' ELSE 'chembl' END END AS src
  FROM ev_k1),
evidence AS (
  SELECT
    'T' || CAST(l_partkey // 10 AS VARCHAR) AS targetId,
    CASE WHEN k2 % 97 <> 0 THEN 'D' || CAST(l_partkey // 2000 * 60 + l_orderkey % 60 AS VARCHAR) END AS diseaseId,
    src AS datasourceId,
    CASE WHEN src IN ('ot_genetics_portal', 'gene_burden') AND k1 % 4 IN (0, 3) THEN l_discount - 0.05 END AS beta,
    CASE WHEN src IN ('ot_genetics_portal', 'gene_burden') THEN
      CASE WHEN k1 % 4 = 1 THEN l_quantity / 25.0 WHEN k1 % 4 = 3 THEN 1.5 END END AS oddsRatio,
    CASE WHEN src IN ('ot_genetics_portal', 'eva', 'eva_somatic', 'gene2phenotype', 'orphanet') THEN CASE k2 % 8 WHEN 0 THEN 'SO_0001587' WHEN 1 THEN 'SO_0001589' WHEN 2 THEN 'SO_0002315'
      WHEN 3 THEN 'SO_0002317' WHEN 4 THEN 'SO_0002053' WHEN 5 THEN 'SO_0002054'
      WHEN 6 THEN 'SO_0001583' END END AS v,
    CASE WHEN src = 'ot_genetics_portal' THEN CASE CAST(floor(k1 / 4.0) AS BIGINT) % 4 WHEN 0 THEN 'SO_0002314'
      WHEN 1 THEN 'SO_0002315' WHEN 2 THEN 'SO_0002316' END END AS q,
    CASE WHEN src IN ('eva', 'eva_somatic') THEN CASE k1 % 5 WHEN 0 THEN ['pathogenic'] WHEN 1 THEN ['benign', 'likely pathogenic']
      WHEN 2 THEN ['protective'] WHEN 3 THEN ['pathogenic', 'risk factor'] END END AS sigs,
    CASE WHEN src IN ('intogen', 'cancer_gene_census') THEN CASE k2 % 6 WHEN 0 THEN ['SO_0002053'] WHEN 1 THEN ['SO_0002054']
      WHEN 2 THEN ['SO_0002053', 'SO_0002054'] WHEN 3 THEN ['SO_0001583', NULL]
      WHEN 4 THEN ['SO_0001583'] END END AS cids,
    CASE WHEN src = 'gene_burden' THEN 'M' || CAST(l_partkey // 50 AS VARCHAR) END AS method,
    CASE WHEN src = 'chembl' THEN 'C' || CAST(l_suppkey AS VARCHAR) END AS drugId,
    CASE WHEN src = 'chembl' THEN CAST(CASE l_linenumber WHEN 1 THEN 0.5 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3
      WHEN 5 THEN 4 END AS DOUBLE) END AS clinicalPhase,
    CASE WHEN src = 'chembl' THEN 'S' || CAST(l_orderkey % 500 AS VARCHAR) END AS diseaseFromSourceId
  FROM ev_s),
drug_ev AS (SELECT * FROM evidence WHERE datasourceId = 'chembl'),
mechanisms AS (
  SELECT DISTINCT
    CASE l_partkey % 3 WHEN 0 THEN ['C' || CAST(l_suppkey AS VARCHAR)] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS chemblIds,
    CASE (l_suppkey + l_partkey // 10) % 5 WHEN 0 THEN 'INHIBITOR' WHEN 1 THEN 'AGONIST'
      WHEN 2 THEN 'BLOCKER' WHEN 3 THEN 'BINDING AGENT' END AS actionType,
    'moa-' || CAST(l_linenumber % 2 AS VARCHAR) AS mechanismOfAction,
    CASE l_partkey % 11 WHEN 5 THEN CAST([] AS VARCHAR[]) WHEN 6 THEN NULL
      ELSE ['T' || CAST(l_partkey // 10 AS VARCHAR), 'T' || CAST(l_partkey // 10 + 1 AS VARCHAR)] END AS targets
  FROM lineitem),
mech_drug AS (
  SELECT unnest(CASE WHEN len(chemblIds) > 0 THEN chemblIds ELSE [NULL::VARCHAR] END) AS drugId2,
    actionType, mechanismOfAction, targets
  FROM mechanisms),
mech_pairs AS (
  SELECT DISTINCT
    unnest(CASE WHEN len(targets) > 0 THEN targets ELSE [NULL::VARCHAR] END) AS targetId2,
    drugId2, actionType, mechanismOfAction
  FROM mech_drug),
target_rows AS (
  SELECT 'T' || CAST(p_partkey // 10 AS VARCHAR) AS id,
    'SYM' || CAST(p_partkey // 10 AS VARCHAR) AS approvedSymbol,
    CASE (p_partkey // 10 + (p_size % 2) * ((p_partkey // 10) % 3)) % 9 WHEN 0 THEN 'TSG' WHEN 1 THEN 'oncogene'
      WHEN 2 THEN 'oncogene,fusion' WHEN 3 THEN 'fusion,oncogene' WHEN 4 THEN 'TSG,oncogene' WHEN 5 THEN 'Oncogene'
      ELSE p_type END AS description
  FROM part),
onco AS (
  SELECT id AS target_id, approvedSymbol,
    list_sort(list(DISTINCT description)) AS description,
    CASE
      WHEN bool_or(contains(description, 'ncogene')) AND bool_or(contains(description, 'TSG')) THEN 'bivalent'
      WHEN bool_or(regexp_matches(description, 'ncogene(\\s|$)')) THEN 'oncogene'
      WHEN bool_or(regexp_matches(description, 'TSG(\\s|$)')) THEN 'TSG'
      ELSE 'noEvaluable' END AS TSorOncogene
  FROM target_rows WHERE description IN {_list(V.ONCO_TSG_DESCRIPTIONS)}
  GROUP BY id, approvedSymbol),
study AS (
  SELECT CASE WHEN m % 6 < 4 THEN 'M' ELSE 'unused-' END || CAST(m AS VARCHAR) AS stMethod,
    CAST(m AS VARCHAR) AS "count", CASE WHEN m % 2 = 0 THEN 'a note, with comma' END AS "comment",
    CASE m % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'notGet' WHEN 2 THEN 'get' WHEN 3 THEN 'noGet' END AS whatToDo
  FROM (SELECT DISTINCT p_partkey // 50 AS m FROM part)),
cleaned AS (
  SELECT *, list_filter(cids, lambda x, i: x IS NOT NULL AND list_position(cids, x) = i) AS ids FROM evidence),
counted AS (
  SELECT * EXCLUDE (ids), coalesce(CAST(list_sum(list_transform(
      list(DISTINCT ids) FILTER (ids IS NOT NULL) OVER (
        PARTITION BY targetId, diseaseId ORDER BY CASE WHEN datasourceId = 'intogen' THEN 0 ELSE 1 END
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      lambda x: len(x))) AS INTEGER), 0) AS intogenAnnot
  FROM cleaned),
pair_arrays AS (
  SELECT targetId, diseaseId, ids, bool_or(datasourceId = 'intogen') AS mine
  FROM cleaned WHERE ids IS NOT NULL GROUP BY ALL),
pair_counts AS (
  SELECT targetId, diseaseId, CAST(sum(CASE WHEN mine THEN len(ids) ELSE 0 END) AS INTEGER) AS own,
    CAST(sum(len(ids)) AS INTEGER) AS every
  FROM pair_arrays GROUP BY targetId, diseaseId),
annotated AS (
  SELECT e.*,
    CAST(e.beta AS REAL) AS b, CAST(e.oddsRatio AS REAL) AS o,
    coalesce(array_to_string(e.sigs, ','), '') AS sig,
    onco.approvedSymbol, onco.description, onco.TSorOncogene, st.whatToDo, st."count", st."comment",
    mp.actionType, mp.mechanismOfAction
  FROM counted e
  LEFT JOIN onco ON onco.target_id = e.targetId
  LEFT JOIN study st ON st.stMethod = e.method
  LEFT JOIN mech_pairs mp ON mp.drugId2 = e.drugId AND mp.targetId2 = e.targetId),
labelled AS (
  SELECT *,
    CASE datasourceId
      WHEN 'ot_genetics_portal' THEN CASE
        WHEN q = 'SO_0002315' AND v IN {L} THEN 'dispar'
        WHEN b IS NULL AND q = 'SO_0002315' AND NOT (v IN {L})
          THEN CASE WHEN o > 1 THEN 'GoF_risk' WHEN o < 1 THEN 'GoF_protect' END
        WHEN o IS NULL AND q = 'SO_0002315' AND NOT (v IN {L})
          THEN CASE WHEN b > 0 THEN 'GoF_risk' WHEN b < 0 THEN 'GoF_protect' END
        WHEN b IS NULL AND q = 'SO_0002316' AND v IS NOT NULL
          THEN CASE WHEN o > 1 THEN 'LoF_risk' WHEN o < 1 THEN 'LoF_protect' END
        WHEN o IS NULL AND q = 'SO_0002316' AND v IS NOT NULL
          THEN CASE WHEN b > 0 THEN 'LoF_risk' WHEN b < 0 THEN 'LoF_protect' END
        WHEN b IS NULL AND (q = 'SO_0002314' OR q IS NULL) AND v IN {L}
          THEN CASE WHEN o > 1 THEN 'LoF_risk' WHEN o < 1 THEN 'LoF_protect' END
        WHEN o IS NULL AND (q = 'SO_0002314' OR q IS NULL) AND v IN {L}
          THEN CASE WHEN b > 0 THEN 'LoF_risk' WHEN b < 0 THEN 'LoF_protect' END
        ELSE 'noEvaluable' END
      WHEN 'gene_burden' THEN CASE
        WHEN whatToDo = 'get' AND b IS NULL AND o > 1 THEN 'LoF_risk'
        WHEN whatToDo = 'get' AND b IS NULL AND o < 1 THEN 'LoF_protect'
        WHEN whatToDo = 'get' AND o IS NULL AND b > 0 THEN 'LoF_risk'
        WHEN whatToDo = 'get' AND o IS NULL AND b < 0 THEN 'LoF_protect'
        ELSE 'noEvaluable' END
      WHEN 'eva' THEN CASE
        WHEN v IN {L} AND regexp_matches(sig, '(pathogenic)$') THEN 'LoF_risk'
        WHEN contains(sig, 'protective') AND v IN {L} THEN 'LoF_protect'
        ELSE 'noEvaluable' END
      WHEN 'eva_somatic' THEN CASE
        WHEN v IN {L} AND regexp_matches(sig, '(pathogenic)$') THEN 'LoF_risk'
        WHEN contains(sig, 'protective') AND v IN {L} THEN 'LoF_protect'
        ELSE 'noEvaluable' END
      WHEN 'gene2phenotype' THEN CASE
        WHEN v = 'SO_0002317' THEN 'LoF_risk' WHEN v = 'SO_0002315' THEN 'GoF_risk'
        ELSE 'noEvaluable' END
      WHEN 'orphanet' THEN CASE
        WHEN v = 'SO_0002054' THEN 'LoF_risk' WHEN v = 'SO_0002053' THEN 'GoF_risk'
        ELSE 'noEvaluable' END
      WHEN 'cancer_gene_census' THEN CASE TSorOncogene
        WHEN 'oncogene' THEN 'GoF_risk' WHEN 'TSG' THEN 'LoF_risk' WHEN 'bivalent' THEN 'bivalent_risk' END
      WHEN 'intogen' THEN CASE
        WHEN intogenAnnot = 1 THEN CASE
          WHEN list_has_any(cids, ['SO_0002053']) THEN 'GoF_risk'
          WHEN list_has_any(cids, ['SO_0002054']) THEN 'LoF_risk' END
        WHEN intogenAnnot > 1 THEN 'bivalentIntogen'
        ELSE 'noEvaluable' END
      WHEN 'impc' THEN CASE WHEN diseaseId IS NOT NULL THEN 'KO_risk' ELSE 'noEvaluable' END
      WHEN 'chembl' THEN CASE
        WHEN actionType IN {INHIBITORS} THEN 'LoF_protect'
        WHEN actionType IN {ACTIVATORS} THEN 'GoF_protect'
        ELSE 'noEvaluable' END
    END AS Assessment
  FROM annotated),
homog AS (
  SELECT *,
    CASE WHEN Assessment = 'KO_risk' THEN 'LoF_risk'
      WHEN Assessment = 'bivalentIntogen' THEN 'bivalent_risk' ELSE Assessment END AS homogenized
  FROM labelled),
assessed AS (
  SELECT *,
    CASE WHEN contains(homogenized, 'risk') THEN 'Risk'
      WHEN contains(homogenized, 'protect') THEN 'Protect' ELSE 'noEvaluable' END AS tendency,
    CASE WHEN contains(homogenized, 'LoF') THEN 'LoF'
      WHEN contains(homogenized, 'GoF') THEN 'GoF' ELSE 'noEvaluable' END AS variation,
    CASE WHEN Assessment IN {TERMS} OR Assessment IS NULL THEN 'evidenceDif'
      WHEN Assessment = 'KO_risk' THEN 'LoF_risk' ELSE homogenized END AS unified
  FROM homog),
ta AS (
  SELECT * FROM (VALUES
    {_TA_ROWS}
  ) AS t(taId, taLabel, taLabelSimple, taRank)),
disease_rows AS (
  SELECT DISTINCT 'D' || CAST(l_partkey // 2000 * 60 + l_orderkey % 60 AS VARCHAR) AS id,
    CASE WHEN (l_orderkey % 60) % 10 = 9 THEN NULL
      WHEN l_orderkey % 60 < 20 THEN ['D' || CAST(l_partkey // 2000 * 60 + l_orderkey % 60 + 20 AS VARCHAR),
                                      'D' || CAST(l_partkey // 2000 * 60 + l_orderkey % 60 + 40 AS VARCHAR)]
      ELSE CAST([] AS VARCHAR[]) END AS descendants,
    CASE WHEN (l_orderkey % 60) % 15 = 4 THEN ['EFO_0000319', 'EFO_0000319'] ELSE
      CASE (l_orderkey % 60) % 5 WHEN 0 THEN ['EFO_0005741', 'MONDO_0045024']
      WHEN 1 THEN ['EFO_0000319'] WHEN 2 THEN ['EFO_0000540', 'EFO_0000651']
      WHEN 3 THEN ['UNLISTED'] END END AS therapeuticAreas
  FROM lineitem),
disease_ta AS (
  SELECT x.diseaseId, x.taId, ta.taLabel, ta.taLabelSimple, ta.taRank
  FROM (SELECT id AS diseaseId, unnest(therapeuticAreas) AS taId FROM disease_rows) x
  LEFT JOIN ta ON ta.taId = x.taId),
area AS (
  SELECT diseaseId, taId, taLabel, taLabelSimple FROM disease_ta
  QUALIFY taRank = min(taRank) OVER (PARTITION BY diseaseId)),
propagated AS (
  SELECT id, unnest(CASE WHEN descendants IS NULL THEN [NULL::VARCHAR]
                         ELSE list_concat([id], descendants) END) AS propagatedTrait
  FROM disease_rows),
so AS (
  SELECT n_name AS Accession,
    CASE WHEN n_nationkey = 0 THEN NULL
      WHEN n_nationkey % 3 = 0
        THEN 'NATION_' || CAST(CAST(floor((n_nationkey - 1) / 2.0) AS BIGINT) AS VARCHAR) || ',NATION_0'
      WHEN n_nationkey % 5 = 0
        THEN 'NATION_' || CAST(CAST(floor((n_nationkey - 1) / 2.0) AS BIGINT) AS VARCHAR) || ', NATION_1'
      ELSE 'NATION_' || CAST(CAST(floor((n_nationkey - 1) / 2.0) AS BIGINT) AS VARCHAR) END AS Parents
  FROM nation)
"""


def _cell(label: str, col: str = "unified") -> str:
    return (
        f"CASE WHEN count(*) FILTER (WHERE {col} = '{label}') > 0 "
        f"THEN count(targetId) FILTER (WHERE {col} = '{label}') END"
    )


def _cells(values=V.UNIFIED_VALUES, col: str = "unified") -> str:
    return ", ".join(f'{_cell(v, col)} AS "{v}"' for v in values)


SUBSET_WHERE = [(s, f"datasourceId = '{s}'") for s in V.SINGLE_SOURCE_SUBSETS] + [
    ("!chembl", "datasourceId <> 'chembl'"),
    ("WOcgc", f"datasourceId IN {_list(V.WITHOUT_CGC)}"),
    ("somatic", f"datasourceId IN {_list(V.SOMATIC)}"),
    ("germline", f"datasourceId IN {_list(V.GERMLINE)}"),
]

MATRIX = "matrix AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT '{name}' AS dataset, targetId, diseaseId, {_cells()} FROM assessed WHERE {where} "
    "GROUP BY targetId, diseaseId"
    for name, where in SUBSET_WHERE
) + ")"

COHERENCE_OTHERS = """CASE
      WHEN GoF_risk IS NULL AND LoF_risk IS NULL AND GoF_protect IS NULL AND LoF_protect IS NULL
        THEN 'evidenceDif'
      WHEN (GoF_risk IS NOT NULL AND LoF_risk IS NOT NULL)
        OR (LoF_protect IS NOT NULL AND LoF_risk IS NOT NULL)
        OR (GoF_protect IS NOT NULL AND GoF_risk IS NOT NULL)
        OR (GoF_protect IS NOT NULL AND LoF_protect IS NOT NULL) THEN 'dispar'
      ELSE 'coherent' END"""

SPINE = f"""
drug_pivot AS (
  SELECT targetId AS targetIdC, 'chembl' AS datasourceIdC, diseaseId AS diseaseIdC,
    CAST({_cell('LoF_protect', 'homogenized')} AS INTEGER) AS LoF_protectC,
    CAST({_cell('GoF_protect', 'homogenized')} AS INTEGER) AS GoF_protectC
  FROM assessed WHERE datasourceId = 'chembl' GROUP BY targetId, diseaseId),
phase AS (
  SELECT targetId, diseaseId, max(clinicalPhase) AS maxClinPhase FROM drug_ev GROUP BY 1, 2),
presence AS (
  SELECT targetId, diseaseId, count(targetId) AS Nr_evidences, 'hasGeneticEvidence' AS geneticEvidence
  FROM assessed WHERE datasourceId <> 'chembl' GROUP BY 1, 2),
spine AS (
  SELECT dp.targetIdC, dp.datasourceIdC, dp.diseaseIdC, dp.LoF_protectC, dp.GoF_protectC,
    CASE WHEN dp.GoF_protectC IS NOT NULL AND dp.LoF_protectC IS NOT NULL THEN 'dispar'
      WHEN dp.GoF_protectC IS NOT NULL OR dp.LoF_protectC IS NOT NULL THEN 'coherent'
      ELSE 'noData' END AS coherency_chembl,
    ph.maxClinPhase AS maxClinPhase_ext, pr.Nr_evidences, pr.geneticEvidence, ar.taLabelSimple,
    CASE WHEN pr.geneticEvidence IS NOT NULL THEN 'hasGenetics' ELSE 'noGenetics' END
      AS geneticEvidenceAssessment
  FROM drug_pivot dp
  LEFT JOIN phase ph ON ph.targetId = dp.targetIdC AND ph.diseaseId = dp.diseaseIdC
  LEFT JOIN presence pr ON pr.targetId = dp.targetIdC AND pr.diseaseId = dp.diseaseIdC
  LEFT JOIN area ar ON ar.diseaseId = dp.diseaseIdC)
"""

SPINE_COLS = (
    "targetIdC, datasourceIdC, diseaseIdC, LoF_protectC, GoF_protectC, coherency_chembl, "
    "maxClinPhase_ext, Nr_evidences, geneticEvidence, taLabelSimple, geneticEvidenceAssessment"
)

_PHASES = ",\n    ".join(
    [f"CASE WHEN maxClinPhase_ext = {p} THEN '{lab}' ELSE 'dif' END AS {n}" for n, p, lab in V.PHASE_EXACT]
    + [f"CASE WHEN maxClinPhase_ext >= {p} THEN '{lab}' ELSE 'dif' END AS {n}" for n, p, lab in V.PHASE_AT_LEAST]
)

_STRAT_SOURCES = [
    ("Ind_genetics", "geneticEvidenceAssessment"),
    ("Ind_coherency_inter", "coherency_inter"),
    ("Ind_coherency_interOneCell", "coherency_inter_oneCell"),
    ("IndOnlyDoe_coherency_inter", "coherencyOnlyDOE_inter"),
    ("IndOnlyDoe_coherency_interOneCell", "coherencyOnlyDOE_inter_oneCell"),
]
_STRATIFIED = ",\n    ".join(
    f"CASE WHEN taLabelSimple = '{area}' THEN {src} END AS {prefix}{suffix}"
    for area, prefix in (("Oncology", "oncology"), ("Other", "other"))
    for suffix, src in _STRAT_SOURCES
)

SCORED_NAMES = [
    "dataset", "targetIdO", "diseaseIdO", *V.MATRIX_COLUMNS, "coherency_others",
    *[c.strip() for c in SPINE_COLS.split(",")],
    "coherency_inter", "coherency_inter_oneCell", "coherencyOnlyDOE_inter",
    "coherencyOnlyDOE_inter_oneCell", "hasGeneticsFromDS", "oncologyHasGeneticsFromDS",
    "otherHasGeneticsFromDS",
    *[f"{prefix}{suffix}" for prefix in ("oncology", "other") for suffix, _ in _STRAT_SOURCES],
    *[n for n, _, _ in V.PHASE_EXACT + V.PHASE_AT_LEAST],
]

SUBSET_LIST = "[" + ", ".join(f"'{n}'" for n, _ in SUBSET_WHERE) + "]"

SCORED = f"""
{MATRIX},
matrix_scored AS (SELECT *, {COHERENCE_OTHERS} AS coherency_others FROM matrix),
spine_by_subset AS (SELECT unnest({SUBSET_LIST}) AS dataset, * FROM spine),
scored_base AS (
  SELECT d.dataset, m.targetId AS targetIdO, m.diseaseId AS diseaseIdO,
    m.LoF_protect, m.GoF_protect, m.LoF_risk, m.GoF_risk, m.evidenceDif, m.coherency_others,
    d.* EXCLUDE (dataset)
  FROM spine_by_subset d
  LEFT JOIN matrix_scored m
    ON m.dataset = d.dataset AND m.targetId = d.targetIdC AND m.diseaseId = d.diseaseIdC),
scored_flags AS (
  SELECT *,
    coalesce(targetIdO IS NOT NULL AND coherency_others = 'coherent'
             AND coherency_chembl = 'coherent', false) AS both_ok,
    (GoF_protectC IS NOT NULL AND (LoF_protect IS NOT NULL OR GoF_risk IS NOT NULL))
      OR (LoF_protectC IS NOT NULL AND (GoF_protect IS NOT NULL OR LoF_risk IS NOT NULL)) AS clash,
    (GoF_protectC IS NOT NULL AND GoF_protect IS NOT NULL)
      OR (LoF_protectC IS NOT NULL AND LoF_protect IS NOT NULL) AS same_cell
  FROM scored_base),
scored_main AS (
  SELECT *,
    CASE WHEN both_ok AND NOT clash THEN 'coherentDoE' ELSE 'noDoE/noGenetics' END AS coherency_inter,
    CASE WHEN both_ok AND same_cell THEN 'coherentDoE' ELSE 'noDoE/noGenetics' END
      AS coherency_inter_oneCell,
    CASE WHEN both_ok THEN CASE WHEN clash THEN 'dispar' ELSE 'coherent' END END
      AS coherencyOnlyDOE_inter,
    CASE WHEN both_ok THEN CASE WHEN same_cell THEN 'coherent' ELSE 'dispar' END END
      AS coherencyOnlyDOE_inter_oneCell,
    CASE WHEN targetIdO IS NOT NULL THEN 'GeneticEvidenceFromDS' ELSE 'noGeneticEvidence' END
      AS hasGeneticsFromDS,
    CASE WHEN taLabelSimple = 'Oncology' THEN CASE WHEN targetIdO IS NOT NULL
      THEN 'hasGeneticEvidence' ELSE 'noGeneticEvidence' END END AS oncologyHasGeneticsFromDS,
    CASE WHEN taLabelSimple = 'Other' THEN CASE WHEN targetIdO IS NOT NULL
      THEN 'hasGeneticEvidence' ELSE 'noGeneticEvidence' END END AS otherHasGeneticsFromDS
  FROM scored_flags),
scored AS (
  SELECT {", ".join(c for c in SCORED_NAMES if not c.startswith(("oncologyInd", "otherInd", "pro_phase")))},
    {_STRATIFIED},
    {_PHASES}
  FROM scored_main)
"""

_CMP_STRUCTS = ", ".join(
    f"{{'n': '{c}', 't': '{t}', 'v': {c}}}" for c, t in V.COMPARISONS
)
_PRD_STRUCTS = ", ".join(
    f"{{'n': '{p}', 't': '{t}', 'v': {p}}}" for p, t in V.PREDICTIONS
)


def _grid(comparisons: str = _CMP_STRUCTS, predictions: str = _PRD_STRUCTS) -> str:
    return f"""
grid_c AS (
  SELECT dataset, targetIdC, diseaseIdC, {", ".join(p for p, _ in V.PREDICTIONS)},
    unnest([{comparisons}]) AS c
  FROM scored),
grid_rows AS (
  SELECT dataset, targetIdC, diseaseIdC, c.n AS comparisonColumn, c.t AS comparisonType,
    c.v AS comparison, unnest([{predictions}]) AS p
  FROM grid_c),
totals AS (
  SELECT dataset, count(*) AS total
  FROM (SELECT DISTINCT dataset, targetIdC, diseaseIdC FROM scored) GROUP BY dataset),
margins AS (
  SELECT g.dataset, g.comparisonColumn, g.p.n AS predictionColumn, g.p.v AS prediction,
    g.comparison, g.comparisonType, g.p.t AS predictionType,
    count(g.targetIdC) OVER (PARTITION BY g.dataset, g.comparisonColumn, g.p.n, g.comparison, g.p.v) AS a,
    count(g.targetIdC) OVER (PARTITION BY g.dataset, g.comparisonColumn, g.p.n, g.p.v) AS predictionTotal,
    count(g.targetIdC) OVER (PARTITION BY g.dataset, g.comparisonColumn, g.p.n, g.comparison) AS comparisonTotal,
    t.total
  FROM grid_rows g JOIN totals t ON t.dataset = g.dataset),
grid AS (
  SELECT DISTINCT * FROM margins WHERE prediction IS NOT NULL AND comparison IS NOT NULL)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


def _q(*parts: str, select: str) -> str:
    return _with(BASE, *parts) + select


UNION_ARMS = {
    "ot_genetics_portal": "beta, oddsRatio, v AS variantFunctionalConsequenceId, q AS variantFunctionalConsequenceFromQtlId",
    "gene_burden": "beta, oddsRatio, method AS statisticalMethodOverview",
    "eva": "v AS variantFunctionalConsequenceId, sigs AS clinicalSignificances",
    "eva_somatic": "v AS variantFunctionalConsequenceId, sigs AS clinicalSignificances",
    "gene2phenotype": "v AS variantFunctionalConsequenceId",
    "orphanet": "v AS variantFunctionalConsequenceId",
    "cancer_gene_census": "cids AS consequenceIds",
    "intogen": "cids AS consequenceIds",
    "impc": None,
    "chembl": "drugId, clinicalPhase",
}

_UNION = "\nUNION ALL BY NAME\n".join(
    f"SELECT targetId, diseaseId, datasourceId{', ' + cols if cols else ''} "
    f"FROM evidence WHERE datasourceId = '{s}'"
    for s, cols in UNION_ARMS.items()
) + (
    "\nUNION ALL BY NAME\nSELECT targetId, diseaseId, datasourceId FROM evidence "
    f"WHERE datasourceId IS NULL OR datasourceId IN {_list(V.UNASSESSED_SOURCES)}"
)
_EVIDENCE_ROWS = """SELECT datasourceId AS sourceId, targetId, diseaseId, datasourceId, beta, oddsRatio,
  variantFunctionalConsequenceId, variantFunctionalConsequenceFromQtlId,
  """ + _joined("clinicalSignificances") + """ AS clinicalSignificances,
  """ + _joined("consequenceIds") + """ AS consequenceIds,
  statisticalMethodOverview, drugId, clinicalPhase
FROM unioned"""

_ASSESSED_COLUMN_SQL = {
    "variantFunctionalConsequenceId": "v AS variantFunctionalConsequenceId",
    "variantFunctionalConsequenceFromQtlId": "q AS variantFunctionalConsequenceFromQtlId",
    "statisticalMethodOverview": "method AS statisticalMethodOverview",
    "clinicalSignificances": "sig AS clinicalSignificances",
}


def _assess_source_sql(source: str) -> str:
    cols = ASSESSED_BASE + [_ASSESSED_COLUMN_SQL.get(c, c) for c in SOURCE_EXTRA[source]]
    return _q(select=f"SELECT {', '.join(cols)} FROM assessed WHERE datasourceId = '{source}'")


ORACLE: dict[str, str] = {
    "union_aligned": _q(
        f"unioned AS ({_UNION})",
        select="""SELECT targetId, diseaseId, datasourceId, beta, oddsRatio,
  variantFunctionalConsequenceId, variantFunctionalConsequenceFromQtlId,
  """ + _joined("clinicalSignificances") + """ AS clinicalSignificances,
  """ + _joined("consequenceIds") + """ AS consequenceIds,
  statisticalMethodOverview, drugId, clinicalPhase
FROM unioned""",
    ),
    "read_evidence": _q(f"unioned AS ({_UNION})", select=_EVIDENCE_ROWS),
    "scan_evidence": _q(f"unioned AS ({_UNION})", select=_EVIDENCE_ROWS),
    "scan_evidence_group": _q(
        select=f"""SELECT 'germline' AS subset, datasourceId AS sourceId, targetId, count(*) AS n, count(beta) AS n_beta
FROM evidence WHERE datasourceId IN {_list(V.GERMLINE)} GROUP BY ALL"""
    ),
    "read_entity": _q(
        select="SELECT id, approvedSymbol, array_to_string(list_sort(list(description)), '|') AS descriptions "
        "FROM target_rows GROUP BY id, approvedSymbol"
    ),
    "read_mechanisms": _q(select="SELECT targetId2, drugId2, actionType, mechanismOfAction FROM mech_pairs"),
    "read_study_csv": _q(select='SELECT stMethod, "count", "comment", whatToDo FROM study'),
    "read_study_csv_checked": """WITH m AS (SELECT DISTINCT p_partkey // 50 AS m FROM part),
cells AS (SELECT *, 'M' || CAST(m AS VARCHAR) AS a, CASE WHEN m % 7 = 3 THEN CAST(m AS VARCHAR) || ' studies' ELSE CAST(m AS VARCHAR) END AS b,
  CASE WHEN m % 2 = 0 THEN '"a note, with comma"' ELSE '' END AS c FROM m),
lines AS (SELECT *, m % 13 = 5 AS short, m % 11 = 4 AS long, m % 7 = 3 AS word,
  CASE WHEN m % 13 = 5 THEN a || ',' || b WHEN m % 11 = 4 THEN a || ',' || b || ',' || c || ',get,more' ELSE a || ',' || b || ',' || c || ',get' END AS line
  FROM cells)
SELECT a AS statisticalMethodOverview, CASE WHEN NOT word THEN CAST(m AS INTEGER) END AS "count",
  CASE WHEN NOT short AND m % 2 = 0 THEN 'a note, with comma' END AS "comment",
  CASE WHEN NOT short THEN 'get' END AS whatToDo,
  CASE WHEN short OR long OR word THEN line END AS badLine FROM lines""",
    "read_ontology_csv": _q(select="SELECT Accession, Parents FROM so"),
    "ensure_columns": _q(
        select=f"SELECT targetId, diseaseId, {_cells(['LoF_risk', 'evidenceDif'])}, CAST(NULL AS BIGINT) AS LoF_protect, "
        "CAST(NULL AS BIGINT) AS GoF_protect, CAST(NULL AS BIGINT) AS GoF_risk FROM assessed "
        "WHERE datasourceId = 'impc' GROUP BY targetId, diseaseId"
    ),
    "mechanism_pairs": _q(select="SELECT targetId2, drugId2, actionType, mechanismOfAction FROM mech_pairs"),
    "action_class": _q(
        select=f"""SELECT e.targetId, e.drugId, e.diseaseId, e.diseaseFromSourceId, e.clinicalPhase, mp.actionType, mp.mechanismOfAction,
  CASE WHEN mp.actionType IN {INHIBITORS} THEN 'inhibitor'
    WHEN mp.actionType IN {ACTIVATORS} THEN 'activator' ELSE 'noEvaluable' END AS twoCategories_new
FROM drug_ev e LEFT JOIN mech_pairs mp ON mp.drugId2 = e.drugId AND mp.targetId2 = e.targetId"""
    ),
    "action_matrix": _q(
        f"""classified AS (
  SELECT e.targetId, e.diseaseId,
    CASE WHEN mp.actionType IN {INHIBITORS} THEN 'inhibitor'
      WHEN mp.actionType IN {ACTIVATORS} THEN 'activator' ELSE 'noEvaluable' END AS cls
  FROM drug_ev e LEFT JOIN mech_pairs mp ON mp.drugId2 = e.drugId AND mp.targetId2 = e.targetId)""",
        f"""action_counts AS (
  SELECT targetId, diseaseId,
    CAST({_cell('activator', 'cls')} AS INTEGER) AS activator,
    CAST({_cell('inhibitor', 'cls')} AS INTEGER) AS inhibitor
  FROM classified WHERE cls <> 'noEvaluable' GROUP BY targetId, diseaseId)""",
        select="""SELECT targetId, diseaseId, activator, inhibitor,
  CASE WHEN activator IS NOT NULL AND inhibitor IS NOT NULL THEN 'dispar' END AS coherency
FROM action_counts""",
    ),
    "oncogene_label": _q(
        select="SELECT target_id, approvedSymbol, array_to_string(description, '|') AS description, "
        "TSorOncogene FROM onco"
    ),
    "consequence_count": _q(select="SELECT targetId, diseaseId, own, every FROM pair_counts"),
    **{f"assess_{s}": _assess_source_sql(s) for s in V.EVIDENCE_SOURCES},
    "assess_all": _q(
        select=f"SELECT {', '.join(ASSESSED_BASE)}, unified, intogenAnnot, approvedSymbol, "
        "array_to_string(description, '|') AS description, TSorOncogene, whatToDo, \"count\", \"comment\", "
        "drugId, diseaseFromSourceId, actionType, mechanismOfAction FROM assessed"
    ),
    "assess_split_keys": _q(
        select=f"SELECT {', '.join(ASSESSED_BASE)}, unified, CASE WHEN datasourceId = 'gene_burden' THEN whatToDo END AS whatToDo, "
        "CASE WHEN datasourceId = 'cancer_gene_census' THEN TSorOncogene END AS TSorOncogene, drugId, actionType FROM assessed"
    ),
    "assessment_labels": _q(
        select="SELECT datasourceId, Assessment, homogenized, tendency, variation, count(*) AS n "
        "FROM assessed GROUP BY ALL"
    ),
    "unify_labels": _q(
        select="SELECT datasourceId, Assessment, unified, count(*) AS n FROM assessed GROUP BY ALL"
    ),
    "direction_matrix": _q(
        select=f"SELECT targetId, diseaseId, {_cells()} FROM assessed GROUP BY targetId, diseaseId"
    ),
    "subset_matrix": _q(MATRIX, select="SELECT * FROM matrix"),
    "label_counts_by_pair": _q(
        """drug_keys AS (SELECT DISTINCT targetId AS t, diseaseId AS d FROM drug_ev)""",
        select="""SELECT targetId, diseaseId, datasourceId, unified, count(*) AS "rows", count(targetId) AS n, max(clinicalPhase) AS phase
FROM assessed WHERE EXISTS (SELECT 1 FROM drug_keys WHERE t IS NOT DISTINCT FROM targetId AND d IS NOT DISTINCT FROM diseaseId) GROUP BY ALL""",
    ),
    "evidence_coherence": _q(
        MATRIX,
        select=f"SELECT dataset, targetId, diseaseId, {', '.join(V.MATRIX_COLUMNS)}, "
        f"{COHERENCE_OTHERS} AS coherency_others FROM matrix",
    ),
    "max_phase": _q(
        select="SELECT targetId, diseaseId, max(clinicalPhase) AS maxClinPhase FROM drug_ev GROUP BY 1, 2"
    ),
    "evidence_presence": _q(
        select="SELECT targetId, diseaseId, count(targetId) AS Nr_evidences, "
        "'hasGeneticEvidence' AS geneticEvidence FROM assessed WHERE datasourceId <> 'chembl' GROUP BY 1, 2"
    ),
    "evaluable_sources": _q(
        select=f"""SELECT targetId, diseaseId,
  array_to_string(list_sort(list(DISTINCT datasourceId)), '|') AS datasourceIds
FROM assessed WHERE NOT (Assessment IN {TERMS}) AND datasourceId <> 'chembl' GROUP BY 1, 2"""
    ),
    "children_of": _q(
        """so_edges AS (
  SELECT unnest(CASE WHEN Parents IS NULL THEN [NULL::VARCHAR] ELSE string_split(Parents, ',') END)
    AS Parentalind, Accession FROM so)""",
        """so_children AS (
  SELECT Parentalind, list_sort(list(Accession)) AS childrens FROM so_edges GROUP BY Parentalind)""",
        select="""SELECT so.Accession, so.Parents, c.Parentalind, array_to_string(c.childrens, '|') AS childrens
FROM so LEFT JOIN so_children c ON c.Parentalind = so.Accession""",
    ),
    "propagate_terms": _q(select="SELECT id, propagatedTrait FROM propagated"),
    "primary_area": _q(select="SELECT diseaseId, taId, taLabel, taLabelSimple FROM area"),
    "ranked_area": _q(
        select="SELECT diseaseId, taId, taLabel, taLabelSimple, CAST(taRank AS BIGINT) AS taRank FROM disease_ta "
        "QUALIFY taRank = min(taRank) OVER (PARTITION BY diseaseId)"
    ),
    "propagated_area": _q(
        select="SELECT p.id, p.propagatedTrait, a.diseaseId, a.taLabelSimple "
        "FROM propagated p LEFT JOIN area a ON p.propagatedTrait = a.diseaseId"
    ),
    "clinical_spine": _q(SPINE, select=f"SELECT {SPINE_COLS} FROM spine"),
    "score_all_subsets": _q(SPINE, SCORED, select=f"SELECT {', '.join(SCORED_NAMES)} FROM scored"),
    "agreement": _q(
        SPINE, SCORED,
        select="SELECT dataset, targetIdC, diseaseIdC, taLabelSimple, coherency_others, coherency_chembl, "
        "coherency_inter, coherency_inter_oneCell, coherencyOnlyDOE_inter, "
        "coherencyOnlyDOE_inter_oneCell FROM scored",
    ),
    "presence_by_area": _q(
        SPINE, SCORED,
        select="SELECT dataset, targetIdC, diseaseIdC, taLabelSimple, hasGeneticsFromDS, "
        "oncologyHasGeneticsFromDS, otherHasGeneticsFromDS FROM scored",
    ),
    "stratified_by_area": _q(
        SPINE, SCORED,
        select="SELECT dataset, targetIdC, diseaseIdC, taLabelSimple, "
        + ", ".join(f"{p}{s}" for p in ("oncology", "other") for s, _ in _STRAT_SOURCES)
        + " FROM scored",
    ),
    "phase_flags": _q(
        SPINE, SCORED,
        select="SELECT dataset, targetIdC, diseaseIdC, taLabelSimple, maxClinPhase_ext, "
        + ", ".join(n for n, _, _ in V.PHASE_EXACT + V.PHASE_AT_LEAST)
        + " FROM scored",
    ),
    "pair_total": _q(
        SPINE, SCORED,
        select="SELECT dataset, count(*) AS total FROM "
        "(SELECT DISTINCT dataset, targetIdC, diseaseIdC FROM scored) GROUP BY dataset",
    ),
    "contingency_one": _q(
        SPINE, SCORED,
        _grid("{'n': 'coherency_inter', 't': 'byDatatype', 'v': coherency_inter}",
              "{'n': 'pro_phase3H', 't': 'clinical', 'v': pro_phase3H}"),
        select="SELECT * FROM grid",
    ),
    "contingency_grid": _q(SPINE, SCORED, _grid(), select="SELECT * FROM grid"),
    "contingency_roundtrip": _q(
        SPINE, SCORED, _grid(), select=f"SELECT *, '{ROUNDTRIP_RUN}' AS run_date FROM grid"
    ),
    "contingency_rerun": _q(
        SPINE, SCORED, _grid(),
        select=f"""SELECT *, '{OTHER_RUN}' AS run_date FROM grid
UNION ALL SELECT *, '{ROUNDTRIP_RUN}' AS run_date FROM grid WHERE dataset IN {_list(RERUN_SUBSETS)}""",
    ),
    "contingency_files": _q(
        SPINE, SCORED, _grid(),
        select=f"""SELECT '{ROUNDTRIP_RUN}' AS run_date, dataset, comparisonColumn,
  'run_date={ROUNDTRIP_RUN}/dataset=' || dataset || '/comparisonColumn=' || comparisonColumn AS folder, true AS has_bytes,
  count(*) AS "rows" FROM grid GROUP BY dataset, comparisonColumn""",
    ),
    "persisted_reports": _q(
        SPINE, SCORED,
        _grid("{'n': 'coherency_inter', 't': 'byDatatype', 'v': coherency_inter}, "
              "{'n': 'hasGeneticsFromDS', 't': 'byDataType', 'v': hasGeneticsFromDS}",
              "{'n': 'pro_phase3H', 't': 'clinical', 'v': pro_phase3H}, {'n': 'pro_phase4', 't': 'clinical', 'v': pro_phase4}"),
        select="SELECT * FROM grid WHERE (comparisonColumn = 'coherency_inter') = (predictionColumn = 'pro_phase3H')",
    ),
    "contingency_manifest": _q(
        SPINE, SCORED, _grid(),
        "cells AS (SELECT * FROM (SELECT unnest(" + SUBSET_LIST + ") AS dataset), "
        f"(VALUES {', '.join(f"('{c}')" for c, _ in V.COMPARISONS)}) AS c(comparisonColumn), "
        f"(VALUES {', '.join(f"('{p}')" for p, _ in V.PREDICTIONS)}) AS p(predictionColumn))",
        select=f"""SELECT '{ROUNDTRIP_RUN}' AS run_date, dataset, comparisonColumn, predictionColumn,
  count(g.a) AS "rows",
  '{ROUNDTRIP_RUN}_original/_' || dataset || '_' || comparisonColumn || '_' || predictionColumn || '.parquet' AS path
FROM cells LEFT JOIN grid g USING (dataset, comparisonColumn, predictionColumn) GROUP BY ALL""",
    ),
}
