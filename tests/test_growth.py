"""Plans whose figures grow with the input and no faster: narrow rows move, wide ones stay."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from doeffect.functions import vocab as V
from doeffect.operators import annotate as A
from doeffect.operators import by_pair as BP
from doeffect.operators import clinical as CL
from doeffect.operators import contingency as CT
from doeffect.operators import matrix as M
from doeffect.plans import run as P
from doeffect.plans.inputs import fixture_inputs
from doeffect.plans.registry import QUERIES
from doeffect.sources import fixtures

from .conftest import bag

COUNTS = "targetId string, diseaseId string, datasourceId string, unified string, rows long, n long, phase double"


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _counts(spark):
    return spark.createDataFrame(
        [
            ("T1", "D1", "eva", "LoF_risk", 3, 3, None),
            ("T1", "D1", "eva_somatic", "LoF_risk", 2, 2, None),
            ("T1", "D1", "chembl", "GoF_protect", 4, 4, 2.0),
            ("T1", "D1", "unlisted", "evidenceDif", 5, 5, None),
            ("T2", None, "impc", "another label", 7, 7, None),
            (None, "D2", "orphanet", "GoF_risk", 1, 0, None),
            ("T3", "D3", None, "LoF_risk", 9, 9, None),
        ],
        COUNTS,
    )


def test_copies_for_subsets_are_not_exchanged(spark):
    got = M.subset_matrix(_counts(spark))
    plan = _plan(got)
    generate = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not [line for line in plan[:generate] if "Exchange" in line or "Aggregate" in line], plan
    rows = {(r.dataset, r.targetId, r.diseaseId): [r[v] for v in V.UNIFIED_VALUES] for r in got.collect()}
    lof, gof, dif = (V.UNIFIED_VALUES.index(v) for v in ("LoF_risk", "GoF_risk", "evidenceDif"))
    none = [None] * len(V.UNIFIED_VALUES)

    def cells(**at):
        return [at.get(v) for v in V.UNIFIED_VALUES]

    assert rows == {
        ("eva", "T1", "D1"): cells(LoF_risk=3),
        ("eva_somatic", "T1", "D1"): cells(LoF_risk=2),
        ("!chembl", "T1", "D1"): cells(LoF_risk=5, evidenceDif=5),
        ("WOcgc", "T1", "D1"): cells(LoF_risk=5),
        ("somatic", "T1", "D1"): cells(LoF_risk=2),
        ("germline", "T1", "D1"): cells(LoF_risk=3),
        # A label that is not a column still puts the pair into its subsets.
        **{(s, "T2", None): none for s in ("impc", "!chembl", "WOcgc", "germline")},
        **{(s, None, "D2"): cells(GoF_risk=0) for s in ("orphanet", "!chembl", "WOcgc", "germline")},
    }


def test_profile_exchanges_counts_and_no_wide_sums(spark):
    profile = CL.pair_profile(_counts(spark))
    plan = _plan(profile)
    exchange = next(i for i, line in enumerate(plan) if "Exchange" in line)
    assert sum("Aggregate" in line for line in plan[:exchange]) == 2, plan
    assert not any("Aggregate" in line for line in plan[exchange:]), plan
    t1 = next(r for r in profile.collect() if r.targetId == "T1")
    assert (t1.drug_rows, t1.GoF_protectC, t1.LoF_protectC, t1.maxClinPhase, t1.Nr_evidences) == (4, 4, None, 2.0, 10)


def test_mechanisms_that_match_nothing_leave_first(spark, sf_small):
    rows = [
        (["C1", None], "AGONIST", "m", ["T1", "T2"]),
        (["C1"], "AGONIST", "m", ["T1", None, "T1"]),
        (["C1"], "BLOCKER", "m", []),
        (None, "BLOCKER", "m", ["T9"]),
        ([], None, None, None),
    ]
    df = spark.createDataFrame(rows, "chemblIds array<string>, actionType string, mechanismOfAction string, targets array<string>")
    both = "targetId2 IS NOT NULL AND drugId2 IS NOT NULL"
    assert bag(A.matching_pairs(df)) == bag(A.mechanism_pairs(df).where(both)) and A.matching_pairs(df).count() == 2
    # Where the mechanisms are made distinct, those rows are gone already.
    plan = A.matching_pairs(fixtures.mechanisms(spark, sf_small))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert any("Filter" in line and "size(" in line for line in plan[lowest:]), plan


def test_counts_by_pair_sort_no_evidence(spark, sf_small, tmp_path):
    inputs = fixture_inputs(spark, sf_small)
    frames = BP.read_by_pair(spark, BP.write_by_pair(inputs.evidence, f"{tmp_path}/by-pair", 4))
    plan = _plan(BP.drug_pair_label_counts(frames, P.sides(inputs), inputs.params))
    assert not any("SortAggregate" in line for line in plan), plan


def test_ids_from_pair_keys(spark):
    df = spark.createDataFrame([("t", None), ("", "=d"), (None, None), ("", "")], "targetId string, diseaseId string")
    assert bag(BP.with_pair_keys(df).select(*BP.pair_ids())) == bag(df.select("targetId", "diseaseId"))


def test_buckets_grow_with_the_evidence(spark, sf_small):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "8k")
        spark.conf.set(keys[1], "0")
        tasks = fixture_inputs(spark, sf_small).evidence[V.DRUG_SOURCE].rdd.getNumPartitions()
        plan = "\n".join(_plan(QUERIES["label_counts_by_pair"](spark, sf_small)))
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert tasks > 8 and set(re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", plan)) == {str(tasks)}


def test_kept_rows_have_what_reports_read(spark, sf_small):
    spark.catalog.clearCache()
    got = QUERIES["persisted_reports"](spark, sf_small)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "InMemoryRelation" in line:
            assert "Nr_evidences" not in line and "targetIdO" not in line, line
    spark.catalog.clearCache()
    narrow = P.scored(fixture_inputs(spark, sf_small), labels_only=True)
    assert set(narrow.columns) == {"dataset", "targetIdC", "diseaseIdC", *[c for c, _ in V.COMPARISONS], *[p for p, _ in V.PREDICTIONS]}
    full = P.scored(fixture_inputs(spark, sf_small))
    assert bag(CT.contingency(narrow, "coherency_inter", "pro_phase3H")) == bag(CT.contingency(full, "coherency_inter", "pro_phase3H"))
    assert full.agg(F.count(F.lit(1))).first() == narrow.agg(F.count(F.lit(1))).first()
