"""The inputs of a run, from a data release or from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules as R
from ..functions import vocab as V
from ..sources import fixtures, readers


@dataclass
class Inputs:
    evidence: dict[str, DataFrame]  # one frame per source
    targets: DataFrame  # id, approvedSymbol, hallmarks.attributes[].description
    mechanisms: DataFrame  # chemblIds, actionType, mechanismOfAction, targets
    study: DataFrame  # stMethod, whatToDo, ...
    diseases: DataFrame  # id, descendants, therapeuticAreas
    params: R.RuleParams
    ontology: DataFrame | None = None  # Accession, Parents


def fixture_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Inputs derived from ``lineitem``/``part``/``nation`` under ``sf_dir``."""
    return Inputs(
        evidence=fixtures.source_frames(spark, sf_dir),
        targets=fixtures.targets(spark, sf_dir),
        mechanisms=fixtures.mechanisms(spark, sf_dir),
        study=fixtures.study_inclusion(spark, sf_dir),
        diseases=fixtures.diseases(spark, sf_dir),
        params=R.RuleParams(var_filter_lof=fixtures.FIXTURE_VAR_FILTER_LOF),
        ontology=fixtures.sequence_ontology(spark, sf_dir),
    )


def release_inputs(
    spark: SparkSession,
    root: str,
    study_csv: str,
    var_filter_lof: list[str],
    ontology_csv: str | None = None,
) -> Inputs:
    """Inputs of a data release laid out as ``<root>/evidence/sourceId=<s>/``
    plus ``targets``, ``diseases``, ``mechanismOfAction`` folders."""
    return Inputs(
        evidence=readers.read_sources(spark, f"{root.rstrip('/')}/evidence", V.EVIDENCE_SOURCES),
        targets=readers.read_entity(spark, root, "targets"),
        mechanisms=readers.read_entity(spark, root, "mechanismOfAction"),
        study=readers.read_study_inclusion(spark, study_csv),
        diseases=readers.read_entity(spark, root, "diseases"),
        params=R.RuleParams(var_filter_lof=var_filter_lof),
        ontology=readers.read_sequence_ontology(spark, ontology_csv) if ontology_csv else None,
    )
