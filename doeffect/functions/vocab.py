"""Vocabularies the rules and reports depend on.

Everything in the "fixed values" blocks below must stay exactly as written:
the assessment labels, the action-type classes, the therapeutic-area ranking
and the report columns are part of the published semantics, so changing a
string changes results.  Nothing here touches Spark.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Hallmark descriptions that count as a tumour-suppressor /
# oncogene annotation of a gene (the duplicate entry is part of the list).
# ---------------------------------------------------------------------------
ONCO_TSG_DESCRIPTIONS = [
    "TSG",
    "oncogene",
    "Oncogene",
    "oncogene",
    "oncogene,TSG",
    "TSG,oncogene",
    "fusion,oncogene",
    "oncogene,fusion",
]

# ---------------------------------------------------------------------------
# Drug action types, split into the two directions.
# ---------------------------------------------------------------------------
INHIBITORS = [
    "RNAI INHIBITOR",
    "NEGATIVE MODULATOR",
    "NEGATIVE ALLOSTERIC MODULATOR",
    "ANTAGONIST",
    "ANTISENSE INHIBITOR",
    "BLOCKER",
    "INHIBITOR",
    "DEGRADER",
    "INVERSE AGONIST",
    "ALLOSTERIC ANTAGONIST",
    "DISRUPTING AGENT",
]

ACTIVATORS = [
    "PARTIAL AGONIST",
    "ACTIVATOR",
    "POSITIVE ALLOSTERIC MODULATOR",
    "POSITIVE MODULATOR",
    "AGONIST",
    "SEQUESTERING AGENT",
    "STABILISER",
]

# ---------------------------------------------------------------------------
# Sequence-ontology consequence ids used by the rule sets.
# ---------------------------------------------------------------------------
SO_INCREASED_LEVEL = "SO_0002315"  # increased gene product level
SO_DECREASED_LEVEL = "SO_0002316"  # decreased gene product level
SO_NO_LEVEL_CHANGE = "SO_0002314"  # altered level, direction not resolved
SO_ABSENT_PRODUCT = "SO_0002317"  # absent gene product
SO_GAIN_OF_FUNCTION = "SO_0002053"
SO_LOSS_OF_FUNCTION = "SO_0002054"

# Defaults for the consequence lists of the intogen rule.  The list of
# loss-of-function variant consequences used by the genetics rules has no
# default: callers pass it (see ``RuleParams``).
DEFAULT_GOF = [SO_GAIN_OF_FUNCTION]
DEFAULT_LOF = [SO_LOSS_OF_FUNCTION]

# ---------------------------------------------------------------------------
# Labels.
# ---------------------------------------------------------------------------
# Assessment labels that mean "no usable direction".  The string "null" is a
# literal member of the list, not SQL NULL.
NON_DIRECTIONAL_TERMS = ["noEvaluable", "bivalent_risk", "null", "dispar"]

# Columns of the presence matrix that the scoring reads.
MATRIX_COLUMNS = ["LoF_protect", "GoF_protect", "LoF_risk", "GoF_risk", "evidenceDif"]
# Every value the unified label can take (explicit pivot values: no discovery
# job, and a column exists even when no row carries the label).
UNIFIED_VALUES = MATRIX_COLUMNS + ["bivalent_risk"]

# ---------------------------------------------------------------------------
# Evidence source groups.
# ---------------------------------------------------------------------------
WITHOUT_CGC = [
    "gene_burden",
    "intogen",
    "eva",
    "eva_somatic",
    "ot_genetics_portal",
    "impc",
    "orphanet",
    "gene2phenotype",
]

GERMLINE = [
    "gene_burden",
    "eva",
    "ot_genetics_portal",
    "impc",
    "orphanet",
    "gene2phenotype",
]

SOMATIC = ["intogen", "cancer_gene_census", "eva_somatic"]

# The ten sources that are unioned and assessed, in union order.
EVIDENCE_SOURCES = [
    "ot_genetics_portal",
    "gene_burden",
    "eva",
    "eva_somatic",
    "gene2phenotype",
    "orphanet",
    "cancer_gene_census",
    "intogen",
    "impc",
    "chembl",
]

DRUG_SOURCE = "chembl"

# Sources that a release holds beside them; they are read, but have no rules.
UNASSESSED_SOURCES = ["genomics_england", "uniprot_literature", "uniprot_variants", "clingen"]
READ_SOURCES = EVIDENCE_SOURCES + UNASSESSED_SOURCES

# Subset names, in report order.  "!chembl" is every source but the drug one,
# including sources no list names.
SINGLE_SOURCE_SUBSETS = [
    "gene_burden",
    "intogen",
    "cancer_gene_census",
    "eva",
    "eva_somatic",
    "ot_genetics_portal",
    "impc",
    "orphanet",
    "gene2phenotype",
]
SUBSET_NAMES = SINGLE_SOURCE_SUBSETS + ["!chembl", "WOcgc", "somatic", "germline"]

# ---------------------------------------------------------------------------
# Therapeutic areas, in rank order (rank = position, 0-based;
# a lower rank wins when a disease has several areas).
# (taId, taLabel, taLabelSimple)
# ---------------------------------------------------------------------------
THERAPEUTIC_AREAS = [
    ("MONDO_0045024", "cell proliferation disorder", "Oncology"),
    ("EFO_0005741", "infectious disease", "Other"),
    ("OTAR_0000014", "pregnancy or perinatal disease", "Other"),
    ("EFO_0005932", "animal disease", "Other"),
    ("MONDO_0024458", "disease of visual system", "Other"),
    ("EFO_0000319", "cardiovascular disease", "Other"),
    ("EFO_0009605", "pancreas disease", "Other"),
    ("EFO_0010282", "gastrointestinal disease", "Other"),
    ("OTAR_0000017", "reproductive system or breast disease", "Other"),
    ("EFO_0010285", "integumentary system disease", "Other"),
    ("EFO_0001379", "endocrine system disease", "Other"),
    ("OTAR_0000010", "respiratory or thoracic disease", "Other"),
    ("EFO_0009690", "urinary system disease", "Other"),
    ("OTAR_0000006", "musculoskeletal or connective tissue disease", "Other"),
    ("MONDO_0021205", "disease of ear", "Other"),
    ("EFO_0000540", "immune system disease", "Other"),
    ("EFO_0005803", "hematologic disease", "Other"),
    ("EFO_0000618", "nervous system disease", "Other"),
    ("MONDO_0002025", "psychiatric disorder", "Other"),
    ("MONDO_0024297", "nutritional or metabolic disease", "Other"),
    ("OTAR_0000018", "genetic, familial or congenital disease", "Other"),
    ("OTAR_0000009", "injury, poisoning or other complication", "Other"),
    ("EFO_0000651", "phenotype", "Other"),
    ("EFO_0001444", "measurement", "Other"),
    ("GO_0008150", "biological process", "Other"),
]

# ---------------------------------------------------------------------------
# Report grid.  (column, type label); both spellings of the
# type label are kept as they are.
# ---------------------------------------------------------------------------
COMPARISONS = [
    ("coherency_inter", "byDatatype"),
    ("coherency_inter_oneCell", "byDatatype"),
    ("oncologyInd_coherency_inter", "byDatatype"),
    ("oncologyInd_coherency_interOneCell", "byDataType"),
    ("otherInd_coherency_inter", "byDatatype"),
    ("otherInd_coherency_interOneCell", "byDataType"),
    ("coherencyOnlyDOE_inter", "byDataType"),
    ("coherencyOnlyDOE_inter_oneCell", "byDataType"),
    ("oncologyIndOnlyDoe_coherency_inter", "byDataType"),
    ("oncologyIndOnlyDoe_coherency_interOneCell", "byDataType"),
    ("otherIndOnlyDoe_coherency_inter", "byDataType"),
    ("otherIndOnlyDoe_coherency_interOneCell", "byDataType"),
    ("hasGeneticsFromDS", "byDataType"),
    ("oncologyHasGeneticsFromDS", "byDataType"),
    ("otherHasGeneticsFromDS", "byDataType"),
]

PREDICTIONS = [
    ("pro_phase4", "clinical"),
    ("pro_phase3", "clinical"),
    ("pro_phase2", "clinical"),
    ("pro_phase1", "clinical"),
    ("pro_phase0", "clinical"),
    ("pro_phase3H", "clinical"),
    ("pro_phase2H", "clinical"),
    ("pro_phase1H", "clinical"),
]

# Trial-phase flags.  (column, phase, label); the first five
# test equality, the last three "at least".
PHASE_EXACT = [
    ("pro_phase4", 4.0, "PhaseIV"),
    ("pro_phase3", 3.0, "PhaseIII"),
    ("pro_phase2", 2.0, "PhaseII"),
    ("pro_phase1", 1.0, "PhaseI"),
    ("pro_phase0", 0.5, "Phase0"),
]
PHASE_AT_LEAST = [
    ("pro_phase3H", 3.0, "PhaseIII+"),
    ("pro_phase2H", 2.0, "PhaseII+"),
    ("pro_phase1H", 1.0, "PhaseI+"),
]
PHASE_OTHER = "dif"
