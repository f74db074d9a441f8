"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query derives its inputs from the driver's tables under ``sf_dir``
(``lineitem``, ``part``, ``nation``; see ``sources.fixtures``) and runs over
them in full.  Arrays are returned as joined strings and counts as bigint so
that results compare equal across engines; ``plans.oracle`` holds the
matching DuckDB SQL for each name.  Tables that a query writes and reads
back lie under the session's checkpoint folder until the process ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..operators import annotate as A
from ..operators import by_pair as BP
from ..operators import clinical as CL
from ..operators import contingency as CT
from ..operators import matrix as M
from ..operators import ontology as O
from ..operators import scoring as S
from ..operators.assess import counts_of
from ..operators.align import ensure_columns, union_aligned
from ..session import scratch_dir
from ..sources import fixtures, readers, sinks
from . import run as P
from .inputs import Inputs, fixture_inputs

Query = Callable[[SparkSession, str], DataFrame]

ROUNDTRIP_RUN = "fixture-run"
OTHER_RUN = "2024-06-01"
# Subsets that the second write of ``contingency_rerun`` still has.
RERUN_SUBSETS = ["!chembl", "somatic"]
# Places over which ``assess_split_keys`` deals the rows of a hot key.
SPLIT = 16
# Buckets of ``label_counts_by_pair``, at least.
BUCKETS = 8


def _joined(col: str | Column, sort: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if sort:
        c = F.sort_array(c)
    return F.array_join(c, "|", "NULL")


def _assessed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return P.assessed(fixture_inputs(spark, sf_dir), **how)


def _on_fixtures(query: Callable[[Inputs], DataFrame]) -> Query:
    """A query of any inputs, on those derived from the driver's tables."""

    def on_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(fixture_inputs(spark, sf_dir))

    return on_tables


def _drug_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.source_frames(spark, sf_dir)[V.DRUG_SOURCE]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scored(fixture_inputs(spark, sf_dir))


# --- sources and alignment -------------------------------------------------


def q_union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = union_aligned(list(fixtures.source_frames(spark, sf_dir).values()))
    return u.select(
        "targetId",
        "diseaseId",
        "datasourceId",
        "beta",
        "oddsRatio",
        "variantFunctionalConsequenceId",
        "variantFunctionalConsequenceFromQtlId",
        _joined("clinicalSignificances").alias("clinicalSignificances"),
        _joined("mutatedSamples.functionalConsequenceId").alias("consequenceIds"),
        "statisticalMethodOverview",
        "drugId",
        "clinicalPhase",
    )


def write_source_folders(spark: SparkSession, sf_dir: str) -> str:
    """All evidence as ``<root>/sourceId=<s>/`` folders under the checkpoint folder; returns root."""
    return fixtures.write_sources(spark, sf_dir, scratch_dir(spark, "evidence"))


def q_read_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen sources and the rows without one, folder by folder."""
    root = write_source_folders(spark, sf_dir)
    return _evidence_columns(readers.read_evidence(spark, root, [*V.READ_SOURCES, None]))


def q_scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders as one relation with a declared schema."""
    root = write_source_folders(spark, sf_dir)
    return _evidence_columns(readers.scan_evidence(spark, root, fixtures.EVIDENCE_SCHEMA))


def q_scan_evidence_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the sources that a catalog lists as germline: the scan's
    folders are pruned while it runs, by the catalog's rows."""
    root, catalog = write_source_folders(spark, sf_dir), scratch_dir(spark, "catalog")
    fixtures.source_catalog(spark).write.parquet(catalog)
    wanted = spark.read.parquet(catalog).where("subset = 'germline'")
    evidence = readers.scan_evidence(spark, root, fixtures.EVIDENCE_SCHEMA)
    return evidence.join(wanted, "sourceId").groupBy("subset", "sourceId", "targetId").agg(
        F.count(F.lit(1)).alias("n"), F.count("beta").alias("n_beta")
    )


def _evidence_columns(ev: DataFrame) -> DataFrame:
    return ev.select(
        "sourceId",
        "targetId",
        "diseaseId",
        "datasourceId",
        "beta",
        "oddsRatio",
        "variantFunctionalConsequenceId",
        "variantFunctionalConsequenceFromQtlId",
        _joined("clinicalSignificances").alias("clinicalSignificances"),
        _joined("mutatedSamples.functionalConsequenceId").alias("consequenceIds"),
        "statisticalMethodOverview",
        "drugId",
        "clinicalPhase",
    )


def q_read_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity table, written and read back with its nested columns."""
    root = scratch_dir(spark, "entities")
    fixtures.targets(spark, sf_dir).write.parquet(f"{root}/targets")
    return readers.read_entity(spark, root, "targets").select(
        "id", "approvedSymbol", _joined("hallmarks.attributes.description", sort=True).alias("descriptions")
    )


def q_read_study_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated study list as a CSV with header, quoted cells and empty cells."""
    path = scratch_dir(spark, "study")
    rows = fixtures.study_inclusion(spark, sf_dir).withColumnRenamed("stMethod", "statisticalMethodOverview")
    rows.write.option("header", True).csv(path)
    return readers.read_study_inclusion(spark, path)


def q_read_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mechanism entity, written and read back, as (drug, target) pairs."""
    root = scratch_dir(spark, "entities")
    fixtures.mechanisms(spark, sf_dir).write.parquet(f"{root}/mechanismOfAction")
    return A.mechanism_pairs(readers.read_entity(spark, root, "mechanismOfAction"))


STUDY_SCHEMA = "statisticalMethodOverview string, count int, comment string, whatToDo string"


def q_read_study_csv_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study list with declared types; lines that do not fit are kept apart."""
    path = scratch_dir(spark, "study-lines")
    # Without a header: every part of the folder is lines alone.
    fixtures.study_lines(spark, sf_dir).write.text(path)
    schema = T.StructType.fromDDL(STUDY_SCHEMA)
    return readers.read_annotations_csv(spark, path, schema, bad_lines="badLine", header=False)


def q_read_ontology_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "ontology")
    fixtures.sequence_ontology(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_sequence_ontology(spark, path)


def q_ensure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of one source, which gives few labels, with all matrix columns."""
    m = M.direction_matrix(_assessed(spark, sf_dir, only="impc"), values=["LoF_risk", "evidenceDif"])
    return ensure_columns(m, V.MATRIX_COLUMNS).select("targetId", "diseaseId", *V.MATRIX_COLUMNS)


# --- annotations -----------------------------------------------------------


def q_mechanism_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mechanism_pairs(fixtures.mechanisms(spark, sf_dir))


def q_action_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.mechanism_pairs(fixtures.mechanisms(spark, sf_dir))
    return M.drug_actions(_drug_evidence(spark, sf_dir), pairs).select(
        "targetId", "drugId", "diseaseId", "diseaseFromSourceId", "clinicalPhase", "actionType", "mechanismOfAction",
        "twoCategories_new",
    )


def q_action_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.mechanism_pairs(fixtures.mechanisms(spark, sf_dir))
    return M.action_matrix(_drug_evidence(spark, sf_dir), pairs)


def q_oncogene_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.oncogene_label(fixtures.targets(spark, sf_dir)).select(
        "target_id", "approvedSymbol", _joined("description").alias("description"), "TSorOncogene"
    )


def q_consequence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_of(fixtures.source_frames(spark, sf_dir))


# --- assessment ------------------------------------------------------------

ASSESSED_BASE = ["targetId", "diseaseId", "datasourceId", "Assessment", "homogenized", "tendency", "variation"]
SOURCE_EXTRA = {
    "ot_genetics_portal": ["variantFunctionalConsequenceId", "variantFunctionalConsequenceFromQtlId"],
    "gene_burden": ["statisticalMethodOverview", "whatToDo"],
    "eva": ["variantFunctionalConsequenceId", "clinicalSignificances"],
    "eva_somatic": ["variantFunctionalConsequenceId", "clinicalSignificances"],
    "gene2phenotype": ["variantFunctionalConsequenceId"],
    "orphanet": ["variantFunctionalConsequenceId"],
    "cancer_gene_census": ["TSorOncogene"],
    "intogen": ["intogenAnnot"],
    "impc": [],
    "chembl": ["drugId", "actionType"],
}


def _assess_source(source: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _assessed(spark, sf_dir, only=source)
        return e.select(*ASSESSED_BASE, *SOURCE_EXTRA[source])

    query.__name__ = f"q_assess_{source}"
    return query


def assess_all(inputs: Inputs) -> DataFrame:
    return P.assessed(inputs, full=True).select(
        *ASSESSED_BASE,
        "unified",
        "intogenAnnot",
        "approvedSymbol",
        _joined("description").alias("description"),
        "TSorOncogene",
        "whatToDo",
        "count",
        "comment",
        "drugId",
        "diseaseFromSourceId",
        "actionType",
        "mechanismOfAction",
    )


def q_assess_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence, its joins dealing the rows of hot keys over many tasks."""
    rows = _assessed(spark, sf_dir, split=SPLIT)
    return rows.select(*ASSESSED_BASE, "unified", "whatToDo", "TSorOncogene", "drugId", "actionType")


def q_assessment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _assessed(spark, sf_dir)
        .groupBy("datasourceId", "Assessment", "homogenized", "tendency", "variation")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def q_unify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _assessed(spark, sf_dir)
        .groupBy("datasourceId", "Assessment", "unified")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- matrices --------------------------------------------------------------


def q_direction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.direction_matrix(_assessed(spark, sf_dir))


def subset_matrix(inputs: Inputs) -> DataFrame:
    return M.subset_matrix(M.label_counts(P.assessed(inputs)))


def q_label_counts_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of the drug pairs, from evidence written in buckets of its pair."""
    inputs = fixture_inputs(spark, sf_dir)
    # As many buckets as tasks read the evidence: the work on a bucket stays the same as the evidence grows.
    buckets = max(BUCKETS, inputs.evidence[V.DRUG_SOURCE].rdd.getNumPartitions())
    names = BP.write_by_pair(inputs.evidence, scratch_dir(spark, "by-pair"), buckets)
    return BP.drug_pair_label_counts(BP.read_by_pair(spark, names), P.sides(inputs), inputs.params)


def q_evidence_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.coherence import evidence_coherence

    m = subset_matrix(fixture_inputs(spark, sf_dir))
    return m.select(
        "dataset", "targetId", "diseaseId", *V.MATRIX_COLUMNS,
        evidence_coherence().alias("coherency_others"),
    )


# --- clinical side ---------------------------------------------------------


def q_max_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.max_phase(_drug_evidence(spark, sf_dir))


def q_evidence_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.evidence_presence(_assessed(spark, sf_dir))


def q_evaluable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.evaluable_sources(M.label_counts(_assessed(spark, sf_dir))).select(
        "targetId", "diseaseId", _joined("datasourceIds").alias("datasourceIds")
    )


# --- ontology --------------------------------------------------------------


def q_children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.children_of(fixtures.sequence_ontology(spark, sf_dir)).select(
        "Accession", "Parents", "Parentalind", _joined("childrens").alias("childrens")
    )


def q_propagate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.propagate_terms(fixtures.diseases(spark, sf_dir))


def q_primary_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.area(fixture_inputs(spark, sf_dir))


def q_ranked_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked_area(fixtures.diseases(spark, sf_dir), readers.therapeutic_areas(spark))


def q_propagated_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = fixture_inputs(spark, sf_dir)
    return O.propagated_area(inputs.diseases, P.area(inputs))


# --- scoring ---------------------------------------------------------------

KEYS = ["dataset", "targetIdC", "diseaseIdC", "taLabelSimple"]


def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, "coherency_others", "coherency_chembl", *S.SCORE_COLUMNS[:4])


def q_presence_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, *S.SCORE_COLUMNS[4:])


def q_stratified_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, *S.STRATIFIED_COLUMNS)


def q_phase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, "maxClinPhase_ext", *S.PHASE_COLUMNS)


# --- contingency -----------------------------------------------------------


def q_pair_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CT.pair_total(_scored(spark, sf_dir))


def q_contingency_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = P.scored(fixture_inputs(spark, sf_dir), keep_pair_flag=True)
    return CT.contingency(scored, "coherency_inter", "pro_phase3H", pair_flag=CL.PAIR_FLAG)


def q_contingency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.report(fixture_inputs(spark, sf_dir))


def _written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "report")
    sinks.write_contingency(P.report(fixture_inputs(spark, sf_dir)), folder, ROUNDTRIP_RUN)
    return sinks.read_contingency(spark, folder)


def q_contingency_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_report(spark, sf_dir).select(*CT.CONTINGENCY_COLUMNS, "run_date")


def q_contingency_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.contingency_manifest(_written_report(spark, sf_dir), ROUNDTRIP_RUN)


def q_contingency_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run dates are written, then one of them again with fewer subsets: it
    has those alone, the other is as it was."""
    folder = scratch_dir(spark, "report")
    # Checkpointed: three writes read it.
    report = P.report(fixture_inputs(spark, sf_dir)).checkpoint()
    fewer = report.where(F.col("dataset").isin(RERUN_SUBSETS))
    for rows, run_date in ((report, ROUNDTRIP_RUN), (report, OTHER_RUN), (fewer, ROUNDTRIP_RUN)):
        sinks.write_contingency(rows, folder, run_date)
    return sinks.read_contingency(spark, folder).select(*CT.CONTINGENCY_COLUMNS, "run_date")


def q_contingency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written, from the files: a row a file, without its random name."""
    folder = scratch_dir(spark, "report")
    sinks.write_contingency(P.report(fixture_inputs(spark, sf_dir)), folder, ROUNDTRIP_RUN)
    files = sinks.written_files(spark, folder)
    return files.select("run_date", "dataset", "comparisonColumn", "folder", (F.col("file_bytes") > 0).alias("has_bytes"), "rows")


def q_persisted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of one session from scored rows that are computed once and kept."""
    scored = P.scored(fixture_inputs(spark, sf_dir), keep_pair_flag=True, persist=True, labels_only=True)
    one = CT.contingency(scored, "coherency_inter", "pro_phase3H", pair_flag=CL.PAIR_FLAG)
    two = CT.contingency(scored, "hasGeneticsFromDS", "pro_phase4", "byDataType", pair_flag=CL.PAIR_FLAG)
    return one.unionByName(two)


# The headline queries, of any inputs.
HEADLINE: dict[str, Callable[[Inputs], DataFrame]] = {
    "assess_all": assess_all,
    "subset_matrix": subset_matrix,
    "clinical_spine": P.spine,
    "score_all_subsets": P.scored,
    "contingency_grid": P.report,
}

QUERIES: dict[str, Query] = {
    "union_aligned": q_union_aligned,
    "read_evidence": q_read_evidence,
    "scan_evidence": q_scan_evidence,
    "scan_evidence_group": q_scan_evidence_group,
    "read_entity": q_read_entity,
    "read_mechanisms": q_read_mechanisms,
    "read_study_csv": q_read_study_csv,
    "read_study_csv_checked": q_read_study_csv_checked,
    "read_ontology_csv": q_read_ontology_csv,
    "ensure_columns": q_ensure_columns,
    "mechanism_pairs": q_mechanism_pairs,
    "action_class": q_action_class,
    "action_matrix": q_action_matrix,
    "oncogene_label": q_oncogene_label,
    "consequence_count": q_consequence_count,
    **{f"assess_{s}": _assess_source(s) for s in V.EVIDENCE_SOURCES},
    "assess_all": _on_fixtures(assess_all),
    "assess_split_keys": q_assess_split_keys,
    "assessment_labels": q_assessment_labels,
    "unify_labels": q_unify_labels,
    "direction_matrix": q_direction_matrix,
    "subset_matrix": _on_fixtures(subset_matrix),
    "label_counts_by_pair": q_label_counts_by_pair,
    "evidence_coherence": q_evidence_coherence,
    "max_phase": q_max_phase,
    "evidence_presence": q_evidence_presence,
    "evaluable_sources": q_evaluable_sources,
    "children_of": q_children_of,
    "propagate_terms": q_propagate_terms,
    "primary_area": q_primary_area,
    "ranked_area": q_ranked_area,
    "propagated_area": q_propagated_area,
    "clinical_spine": _on_fixtures(P.spine),
    "score_all_subsets": _on_fixtures(P.scored),
    "agreement": q_agreement,
    "presence_by_area": q_presence_by_area,
    "stratified_by_area": q_stratified_by_area,
    "phase_flags": q_phase_flags,
    "pair_total": q_pair_total,
    "contingency_one": q_contingency_one,
    "contingency_grid": q_contingency_grid,
    "contingency_roundtrip": q_contingency_roundtrip,
    "contingency_manifest": q_contingency_manifest,
    "contingency_rerun": q_contingency_rerun,
    "contingency_files": q_contingency_files,
    "persisted_reports": q_persisted_reports,
}
