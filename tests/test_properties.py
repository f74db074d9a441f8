"""Property test: the production path on random evidence, against plain Python.

The expected spine, scores and contingency margins are counted row by row
from the random evidence; nothing of the library takes part in them.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doeffect.functions import rules as R
from doeffect.functions import vocab as V
from doeffect.operators import clinical as CL
from doeffect.operators import contingency as CT
from doeffect.operators import matrix as M
from doeffect.operators import scoring as S
from doeffect.operators.align import union_aligned
from doeffect.operators.ontology import primary_area

from .conftest import bag

SOURCES = ["chembl", "eva", "intogen", "cancer_gene_census", "impc", "gene_burden", "clingen", None]
LABELS = [None, "LoF_risk", "GoF_risk", "LoF_protect", "GoF_protect", "noEvaluable", "dispar",
          "KO_risk", "bivalentIntogen", "bivalent_risk"]
DRUG_LABELS = ["LoF_protect", "GoF_protect", "noEvaluable"]
AREAS = {"D1": ["Oncology"], "D2": ["Other", "Other"]}
SUBSETS = {
    **{s: {s} for s in V.SINGLE_SOURCE_SUBSETS},
    "!chembl": {s for s in SOURCES if s not in ("chembl", None)},
    "WOcgc": set(V.WITHOUT_CGC),
    "somatic": set(V.SOMATIC),
    "germline": set(V.GERMLINE),
}

row = st.tuples(
    st.sampled_from(["T1", "T2", "T3", None]),
    st.sampled_from(["D1", "D2", "D3", None]),
    st.sampled_from(SOURCES),
    st.sampled_from(LABELS),
    st.sampled_from([None, 0.5, 1.0, 2.0, 3.0, 4.0]),
).map(lambda r: (*r[:3], DRUG_LABELS[LABELS.index(r[3]) % 3], r[4]) if r[2] == "chembl" else r)


def _assessed(df):
    homogenized = R.homogenize(F.col("Assessment"))
    return df.withColumn("homogenized", homogenized).withColumn("unified", R.unify(F.col("Assessment"), F.col("homogenized")))


def _unified(label):
    if label in (None, "noEvaluable", "bivalent_risk", "dispar"):
        return "evidenceDif"
    return {"KO_risk": "LoF_risk", "bivalentIntogen": "bivalent_risk"}.get(label, label)


def _expected(rows):
    """(subset, target, disease, area) -> values of every scored row."""
    pairs = defaultdict(list)
    for t, d, source, label, phase in rows:
        pairs[t, d].append((source, _unified(label), phase))
    out = []
    for (t, d), mine in pairs.items():
        drugs = [m for m in mine if m[0] == "chembl"]
        if not drugs:
            continue
        known = t is not None and d is not None
        side = {k: any(m[1] == k for m in drugs) for k in ("LoF_protect", "GoF_protect")}
        drug = "dispar" if all(side.values()) else "coherent" if any(side.values()) else "noData"
        phases = [m[2] for m in drugs if m[2] is not None]
        others = sum(m[0] not in ("chembl", None) for m in mine)
        for area in AREAS.get(d, [None]):
            for subset, sources in SUBSETS.items():
                cell = Counter(m[1] for m in mine if m[0] in sources) if known else Counter()
                has = {k: cell[k] > 0 for k in ("LoF_risk", "GoF_risk", "LoF_protect", "GoF_protect")}
                if not any(has.values()):
                    genes = "evidenceDif" if cell else None
                elif (has["LoF_risk"] and (has["GoF_risk"] or has["LoF_protect"])) or (
                    has["GoF_protect"] and (has["GoF_risk"] or has["LoF_protect"])
                ):
                    genes = "dispar"
                else:
                    genes = "coherent"
                both = genes == "coherent" and drug == "coherent"
                clash = (side["GoF_protect"] and (has["LoF_protect"] or has["GoF_risk"])) or (
                    side["LoF_protect"] and (has["GoF_protect"] or has["LoF_risk"])
                )
                out.append(
                    {
                        "dataset": subset, "targetIdC": t, "diseaseIdC": d, "taLabelSimple": area,
                        "coherency_chembl": drug, "coherency_others": genes,
                        "maxClinPhase_ext": max(phases, default=None) if known else None,
                        "Nr_evidences": others if known and others else None,
                        "LoF_risk": cell["LoF_risk"] or None, "evidenceDif": cell["evidenceDif"] or None,
                        "coherency_inter": "coherentDoE" if both and not clash else "noDoE/noGenetics",
                        "coherencyOnlyDOE_inter": ("dispar" if clash else "coherent") if both else None,
                        "pro_phase3H": "PhaseIII+" if known and max(phases, default=0) >= 3 else "dif",
                    }
                )
    return out


# Deterministic examples and no shrinking: every example starts Spark jobs.
@settings(
    max_examples=8,
    deadline=None,
    derandomize=True,
    phases=[Phase.explicit, Phase.generate],
    suppress_health_check=list(HealthCheck),
)
@given(st.lists(row, min_size=1, max_size=40))
def test_production_path_equals_plain_python(spark, rows):
    schema = "targetId string, diseaseId string, datasourceId string, Assessment string, clinicalPhase double"
    wide = spark.createDataFrame(rows, schema)
    frames = {"chembl": wide.where("datasourceId = 'chembl'"), "rest": wide.where("datasourceId <> 'chembl' OR datasourceId IS NULL")}
    assessed = _assessed(union_aligned(list(CL.restrict_to_drug_pairs(frames).values())))
    diseases = spark.createDataFrame(
        [("D1", ["MONDO_0045024", "EFO_0000319"]), ("D2", ["EFO_0000319", "EFO_0000319"]), ("D3", ["X"])],
        "id string, therapeuticAreas array<string>",
    )
    spine = CL.clinical_spine(CL.pair_profile(M.label_counts(assessed)), primary_area(diseases), keep_subsets=True)
    scored = S.score(spine, keep_pair_flag=True)
    want = _expected(rows)
    columns = list(want[0]) if want else ["dataset"]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert bag(scored, columns) == sorted((tuple(w[c] for c in columns) for w in want), key=key)

    both, by_p, by_c, pairs = Counter(), Counter(), Counter(), defaultdict(set)
    for w in want:
        c, p = w["coherencyOnlyDOE_inter"], w["pro_phase3H"]
        counted = w["targetIdC"] is not None
        both[w["dataset"], c, p] += counted
        by_p[w["dataset"], p] += counted
        by_c[w["dataset"], c] += counted
        pairs[w["dataset"]].add((w["targetIdC"], w["diseaseIdC"]))
    cells = sorted(
        ((s, c, p, n, by_p[s, p], by_c[s, c], len(pairs[s])) for (s, c, p), n in both.items() if c is not None), key=key
    )
    grid = CT.contingency_grid(scored, pair_flag=CL.PAIR_FLAG).where(
        "comparisonColumn = 'coherencyOnlyDOE_inter' AND predictionColumn = 'pro_phase3H'"
    )
    assert bag(grid, ["dataset", "comparison", "prediction", "a", "predictionTotal", "comparisonTotal", "total"]) == cells
