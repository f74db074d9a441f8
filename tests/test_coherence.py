"""Truth tables of the coherence columns (O30, O40-O46) over every presence pattern."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from doeffect.functions import coherence as C

EVIDENCE = ["GoF_risk", "LoF_risk", "GoF_protect", "LoF_protect"]


def _others(gr, lr, gp, lp):
    if not (gr or lr or gp or lp):
        return "evidenceDif"
    if (gr and lr) or (lp and lr) or (gp and gr) or (gp and lp):
        return "dispar"
    return "coherent"


def _drug(gpc, lpc):
    return "dispar" if gpc and lpc else "coherent" if gpc or lpc else "noData"


def test_evidence_coherence_all_patterns(spark):
    pats = list(itertools.product([None, 1], repeat=4))
    df = spark.createDataFrame(pats, ", ".join(f"{c} int" for c in EVIDENCE))
    for r in df.select("*", C.evidence_coherence().alias("c")).collect():
        flags = [r[c] is not None for c in EVIDENCE]
        assert r["c"] == _others(*flags), r


def test_agreement_all_patterns(spark):
    rows = []
    # evidence presence x drug presence x has evidence row x area
    for ev in itertools.product([None, 2], repeat=4):
        for gpc, lpc in itertools.product([None, 1], repeat=2):
            for has_row in (False, True):
                for area in (None, "Oncology", "Other"):
                    ev_vals = ev if has_row else (None,) * 4
                    rows.append((*ev_vals, gpc, lpc, "T1" if has_row else None, area))
    schema = ", ".join(f"{c} int" for c in EVIDENCE) + \
        ", GoF_protectC int, LoF_protectC int, targetIdO string, taLabelSimple string"
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn(
        "coherency_others", F.when(F.col("targetIdO").isNotNull(), C.evidence_coherence())
    ).withColumn("coherency_chembl", C.drug_coherence())
    out = df.select("*", *C.score_columns()).collect()
    assert len(out) == len(rows)
    for r in out:
        gr, lr, gp, lp = (r[c] is not None for c in EVIDENCE)
        gpc, lpc = r["GoF_protectC"] is not None, r["LoF_protectC"] is not None
        has = r["targetIdO"] is not None
        both = has and _others(gr, lr, gp, lp) == "coherent" and _drug(gpc, lpc) == "coherent"
        clash = (gpc and (lp or gr)) or (lpc and (gp or lr))
        same = (gpc and gp) or (lpc and lp)
        assert r["coherency_chembl"] == _drug(gpc, lpc)
        assert r["coherency_inter"] == ("coherentDoE" if both and not clash else C.NO_DOE)
        assert r["coherency_inter_oneCell"] == ("coherentDoE" if both and same else C.NO_DOE)
        assert r["coherencyOnlyDOE_inter"] == (
            None if not both else "dispar" if clash else "coherent")
        assert r["coherencyOnlyDOE_inter_oneCell"] == (
            None if not both else "coherent" if same else "dispar")
        assert r["hasGeneticsFromDS"] == ("GeneticEvidenceFromDS" if has else "noGeneticEvidence")
        for area, col in (("Oncology", "oncologyHasGeneticsFromDS"), ("Other", "otherHasGeneticsFromDS")):
            want = None if r["taLabelSimple"] != area else (
                "hasGeneticEvidence" if has else "noGeneticEvidence")
            assert r[col] == want


def test_one_cell_is_stricter_than_diagonal(spark):
    # Drug GoF protection with only LoF-risk genetics: agrees on the diagonal,
    # not in the very same cell.
    df = spark.createDataFrame(
        [(None, 3, None, None, 1, None, "T1")],
        "GoF_risk int, LoF_risk int, GoF_protect int, LoF_protect int, "
        "GoF_protectC int, LoF_protectC int, targetIdO string",
    ).withColumn("coherency_others", C.evidence_coherence()).withColumn(
        "coherency_chembl", C.drug_coherence()
    ).withColumn("taLabelSimple", F.lit(None).cast("string"))
    r = df.select(*C.score_columns()).first()
    assert r["coherency_inter"] == "coherentDoE"
    assert r["coherency_inter_oneCell"] == C.NO_DOE
    assert r["coherencyOnlyDOE_inter_oneCell"] == "dispar"
