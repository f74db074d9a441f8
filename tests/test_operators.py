"""Operators: edge rows, hand-counted values and plan checks."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from doeffect.functions import vocab as V
from doeffect.operators import annotate as A
from doeffect.operators import clinical as CL
from doeffect.operators import contingency as CT
from doeffect.operators import assess as AS
from doeffect.operators import matrix as M
from doeffect.operators import ontology as O
from doeffect.operators.align import ensure_columns, union_aligned
from doeffect.plans import run as P
from doeffect.plans.inputs import fixture_inputs
from doeffect.plans.registry import write_source_folders
from doeffect.sources.readers import read_sources

from .conftest import bag

CONSEQ = "targetId string, diseaseId string, datasourceId string, " \
         "mutatedSamples array<struct<functionalConsequenceId: string>>"


def _ms(*ids):
    return [(i,) for i in ids]


@pytest.fixture(scope="module")
def small(spark, sf_small):
    inputs = fixture_inputs(spark, sf_small)
    return inputs, P.assessed(inputs).cache()


# --- consequence count (O19) ----------------------------------------------------


def test_consequence_count_semantics(spark):
    rows = [
        ("T1", "D1", "intogen", _ms("A")),
        ("T1", "D1", "intogen", _ms("A", "B")),  # {[A],[A,B]} -> 3
        ("T2", "D1", "intogen", _ms("A", "B")),
        ("T2", "D1", "intogen", _ms("B", "A")),  # order matters: 4
        ("T3", "D1", "intogen", _ms("A", "B")),
        ("T3", "D1", "intogen", _ms("A", "B")),  # duplicate array: 2
        ("T4", "D1", "intogen", _ms(None)),  # [null] -> 0
        ("T5", "D1", "intogen", None),  # null -> 0
        ("T6", "D1", "intogen", _ms("A", "A", None)),  # deduped in the row: 1
        (None, "D1", "intogen", _ms("A")),  # NULL key groups together
        (None, "D1", "intogen", _ms("B")),
        ("T1", "D1", "eva", _ms("C", "D", "E")),  # other sources do not count
    ]
    df = spark.createDataFrame(rows, CONSEQ)
    got = {(r["targetId"], r["diseaseId"]): (r["own"], r["every"]) for r in A.consequence_count(df).collect()}
    assert got == {("T1", "D1"): (3, 6), ("T2", "D1"): (4, 4), ("T3", "D1"): (2, 2), ("T4", "D1"): (0, 0),
                   ("T6", "D1"): (1, 1), (None, "D1"): (2, 2)}


def test_counts_on_every_row(spark):
    """Rows of the drivers' source see its arrays, others all of the pair; 0 without any."""
    rows = [("T1", "D1", "intogen", _ms("A")), ("T1", "D1", "cancer_gene_census", _ms("B", "C")),
            ("T2", None, "intogen", _ms("A")), ("T2", None, None, None), ("T3", "D1", "eva", None)]
    df = spark.createDataFrame(rows, CONSEQ)
    out = bag(AS.with_counts(df, A.consequence_count(df)), ["targetId", "datasourceId", "intogenAnnot"])
    assert out == [("T1", "cancer_gene_census", 3), ("T1", "intogen", 1), ("T2", "intogen", 1), ("T2", None, 1), ("T3", "eva", 0)]


# --- annotations ----------------------------------------------------------------


def test_mechanism_pairs_outer_and_fan_out(spark):
    rows = [
        (["C1"], "INHIBITOR", "m1", ["T1", "T2"]),
        (["C1"], "AGONIST", "m2", ["T1"]),  # second mechanism on (C1, T1)
        (["C1"], "INHIBITOR", "m1", ["T1", "T2"]),  # duplicate
        (None, "BLOCKER", "m3", ["T3"]),  # no drug: kept with NULL drug
        (["C2"], "BLOCKER", "m4", []),  # no target: kept with NULL target
    ]
    df = spark.createDataFrame(
        rows, "chemblIds array<string>, actionType string, mechanismOfAction string, targets array<string>"
    )
    got = bag(A.mechanism_pairs(df), ["drugId2", "targetId2", "actionType", "mechanismOfAction"])
    assert got == sorted(
        [("C1", "T1", "INHIBITOR", "m1"), ("C1", "T2", "INHIBITOR", "m1"), ("C1", "T1", "AGONIST", "m2"),
         (None, "T3", "BLOCKER", "m3"), ("C2", None, "BLOCKER", "m4")],
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )


def test_oncogene_label_nested_projection(spark):
    rows = [
        ("T1", "S1", {"attributes": [{"description": "TSG"}, {"description": "oncogene"}]}),
        ("T2", "S2", {"attributes": [{"description": "oncogene,fusion"}]}),
        ("T3", "S3", {"attributes": [{"description": "unrelated"}]}),
        ("T4", "S4", None),
        ("T5", "S5", {"attributes": [{"description": "Oncogene"}, {"description": "Oncogene"}]}),
    ]
    df = spark.createDataFrame(
        rows, "id string, approvedSymbol string, hallmarks struct<attributes: array<struct<description: string>>>"
    )
    got = {r["target_id"]: (r["description"], r["TSorOncogene"]) for r in A.oncogene_label(df).collect()}
    assert got == {
        "T1": (["TSG", "oncogene"], "bivalent"),
        "T2": (["oncogene,fusion"], "noEvaluable"),
        "T5": (["Oncogene"], "oncogene"),
    }


# --- alignment ------------------------------------------------------------------


def test_union_aligned_fills_missing_and_nested(spark):
    a = spark.createDataFrame([("T1", 1.5)], "targetId string, beta double")
    b = spark.createDataFrame([("T2", [("X",)])], "targetId string, mutatedSamples array<struct<functionalConsequenceId: string>>")
    u = union_aligned([a, b])
    assert sorted(u.columns) == ["beta", "mutatedSamples", "targetId"]
    got = {r["targetId"]: (r["beta"], r["mutatedSamples"]) for r in u.collect()}
    assert got["T1"] == (1.5, None) and got["T2"][0] is None
    assert ensure_columns(a, ["beta", "OddsRatio"]).columns == ["targetId", "beta", "OddsRatio"]


# --- ontology -------------------------------------------------------------------


def test_children_of_untrimmed_parents(spark):
    rows = [("A", None), ("B", "A"), ("C", "A, B"), ("D", "B")]
    so = spark.createDataFrame(rows, "Accession string, Parents string")
    got = {r["Accession"]: r["childrens"] for r in O.children_of(so).collect()}
    assert got == {"A": ["B", "C"], "B": ["D"], "C": None, "D": None}  # " B" is its own key
    trimmed = {r["Accession"]: r["childrens"] for r in O.children_of(so, trim=True).collect()}
    assert trimmed["B"] == ["C", "D"]


def test_propagate_terms_null_descendants(spark):
    df = spark.createDataFrame(
        [("D1", ["D2"]), ("D2", []), ("D3", None)], "id string, descendants array<string>"
    )
    assert bag(O.propagate_terms(df)) == [("D1", "D1"), ("D1", "D2"), ("D2", "D2"), ("D3", None)]


def test_primary_area_ties_and_unlisted(spark):
    df = spark.createDataFrame(
        [
            ("D1", ["EFO_0000319", "MONDO_0045024"]),  # oncology wins
            ("D2", ["EFO_0000319", "EFO_0000319"]),  # repeated: two rows
            ("D3", ["UNLISTED"]),  # no rank: dropped
            ("D4", None),  # no area: dropped
        ],
        "id string, therapeuticAreas array<string>",
    )
    got = bag(O.primary_area(df), ["diseaseId", "taId", "taLabelSimple"])
    assert got == [("D1", "MONDO_0045024", "Oncology"), ("D2", "EFO_0000319", "Other"),
                   ("D2", "EFO_0000319", "Other")]


# --- matrices -------------------------------------------------------------------


def test_direction_matrix_absent_is_null(spark):
    df = spark.createDataFrame(
        [("T1", "D1", "LoF_risk"), ("T1", "D1", "LoF_risk"), (None, "D2", "GoF_risk")],
        "targetId string, diseaseId string, unified string",
    )
    got = {(r["targetId"], r["diseaseId"]): r.asDict() for r in M.direction_matrix(df).collect()}
    assert got[("T1", "D1")]["LoF_risk"] == 2 and got[("T1", "D1")]["GoF_risk"] is None
    # the present cell counts non-null targetId: present but 0
    assert got[(None, "D2")]["GoF_risk"] == 0 and got[(None, "D2")]["LoF_risk"] is None


def test_subset_matrix_equals_one_pivot_per_subset(small):
    _, assessed = small
    long = M.subset_matrix(M.label_counts(assessed))
    for name, pred in M.subset_predicates():
        one = M.direction_matrix(assessed.where(pred))
        mine = long.where(F.col("dataset") == name).drop("dataset")
        assert bag(mine) == bag(one), name


def test_pair_profile_matches_separate_aggregations(small):
    _, assessed = small
    prof = CL.pair_profile(M.label_counts(assessed))
    drug = assessed.where(F.col("datasourceId") == "chembl")
    phase = CL.max_phase(drug)
    mine = prof.where("drug_rows > 0").select("targetId", "diseaseId", "maxClinPhase")
    assert bag(mine) == bag(phase)
    presence = CL.evidence_presence(assessed).select("targetId", "diseaseId", "Nr_evidences")
    mine = prof.where("Nr_evidences IS NOT NULL").select("targetId", "diseaseId", "Nr_evidences")
    assert bag(mine) == bag(presence)


# --- scoring and contingency ----------------------------------------------------


def test_every_subset_keeps_every_spine_row(small):
    inputs, _ = small
    spine_rows = P.spine(inputs).count()
    per = {r["dataset"]: r["count"] for r in P.scored(inputs).groupBy("dataset").count().collect()}
    assert set(per) == set(V.SUBSET_NAMES)
    assert set(per.values()) == {spine_rows}


@pytest.fixture(scope="module")
def scored_small(small):
    return P.scored(small[0]).cache()


def test_grid_equals_cells_and_margins_hold(scored_small):
    grid = CT.contingency_grid(scored_small).cache()
    assert grid.select("comparisonColumn", "predictionColumn").distinct().count() == 15 * 8
    one = CT.contingency(scored_small, "otherInd_coherency_inter", "pro_phase2H")
    cell = grid.where(
        (F.col("comparisonColumn") == "otherInd_coherency_inter") & (F.col("predictionColumn") == "pro_phase2H")
    )
    assert bag(cell) == bag(one)
    # a <= both margins; sum of a over comparisons <= predictionTotal, equal
    # when the comparison is never NULL (hasGeneticsFromDS)
    assert grid.where("a > predictionTotal OR a > comparisonTotal").count() == 0
    sums = grid.groupBy("dataset", "comparisonColumn", "predictionColumn", "prediction").agg(
        F.sum("a").alias("s"), F.max("predictionTotal").alias("p")
    )
    assert sums.where("s > p").count() == 0
    assert sums.where("comparisonColumn = 'hasGeneticsFromDS' AND s <> p").count() == 0


def test_single_pass_total_equals_distinct_count(small):
    flagged = P.scored(small[0], keep_pair_flag=True).cache()
    one_pass = CT.contingency_grid(flagged, pair_flag=CL.PAIR_FLAG)
    two_pass = CT.contingency_grid(flagged.drop(CL.PAIR_FLAG))
    assert bag(one_pass) == bag(two_pass)


def test_persisted_scores_serve_several_reports(spark, small):
    kept = P.scored(small[0], keep_pair_flag=True, persist=True)
    try:
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
        one = CT.contingency(kept, "coherency_inter", "pro_phase4", pair_flag=CL.PAIR_FLAG)
        two = CT.contingency(kept, "coherency_inter", "pro_phase3", pair_flag=CL.PAIR_FLAG)
        assert "InMemoryTableScan" in _plan(one) and "InMemoryTableScan" in _plan(two)
        assert one.agg(F.sum("a")).first() == two.agg(F.sum("a")).first()
    finally:
        kept.unpersist()
    assert not kept.storageLevel.useMemory


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df, column: str) -> int:
    return sum("FileScan parquet" in line and column in line for line in _plan(df).splitlines())


def test_plans_do_not_depend_on_broadcasts(spark, sf_small):
    """Without broadcasts the joins shuffle, but nothing is scanned more often
    and every result is the same."""
    spark.catalog.clearCache()  # frames that other tests keep would take part in the plans
    inputs = fixture_inputs(spark, sf_small)
    small = {"report": P.report(inputs), "assessed": P.assessed(inputs, full=True)}
    rows = {name: bag(df) for name, df in small.items()}
    scans = {name: _scans(df, "l_orderkey") for name, df in small.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        inputs = fixture_inputs(spark, sf_small)
        large = {"report": P.report(inputs), "assessed": P.assessed(inputs, full=True)}
        for name, df in large.items():
            assert "BroadcastHashJoin" not in _plan(df)
            assert _scans(df, "l_orderkey") == scans[name]
            assert bag(df) == rows[name]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_drug_pairs_are_kept_before_annotation(spark, sf_small):
    """In the optimized plan no annotation join lies below the semi join."""
    spark.catalog.clearCache()
    plan = P.report(fixture_inputs(spark, sf_small))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    indent = lambda line: len(line) - len(line.lstrip(" :+-|"))
    semi = [i for i, line in enumerate(plan) if "LeftSemi" in line]
    assert len(semi) >= len(V.EVIDENCE_SOURCES)
    for i in semi:
        below = [line for line in _below(plan, i, indent)]
        assert not any("LeftOuter" in line for line in below)


def _below(plan, i, indent):
    for line in plan[i + 1 :]:
        if indent(line) <= indent(plan[i]):
            return
        yield line


def test_restrict_to_drug_pairs_keeps_all_rows_of_drug_pairs(spark):
    rows = [
        ("T1", "D1", "chembl"), ("T1", "D1", "eva"), ("T1", "D1", "impc"),
        ("T2", "D1", "eva"),  # no drug evidence: dropped
        (None, "D2", "chembl"), (None, "D2", "orphanet"),  # NULL key matches NULL key
        ("T3", None, "eva"),
    ]
    df = spark.createDataFrame(rows, "targetId string, diseaseId string, datasourceId string")
    frames = {s: df.where(F.col("datasourceId") == s) for s in ("chembl", "eva", "impc", "orphanet")}
    kept = CL.restrict_to_drug_pairs(frames)
    assert bag(union_aligned(list(kept.values()))) == bag(df.where("NOT (targetId <=> 'T2') AND NOT (diseaseId IS NULL)"))


def test_hot_pair_is_combined_map_side(spark):
    # one (target, disease) pair holds a third of all rows
    hot = [("T1", "D1", "eva", "LoF_risk", "LoF_risk", [("A",)])] * 300
    cold = [(f"T{i}", f"D{i % 7}", src, "GoF_risk", "GoF_risk", [("B",)])
            for i in range(600) for src in ("intogen",)]
    df = spark.createDataFrame(
        hot + cold,
        "targetId string, diseaseId string, datasourceId string, unified string, homogenized string, "
        "mutatedSamples array<struct<functionalConsequenceId: string>>",
    ).withColumn("clinicalPhase", F.lit(None).cast("double"))
    counts = M.label_counts(df)
    for frame in (CL.pair_profile(counts), A.consequence_count(df), M.subset_matrix(counts)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # partial aggregation below the shuffle, and no window over pairs
        assert "partial_" in plan and "Window" not in plan, plan
    prof = {r["targetId"]: r for r in CL.pair_profile(counts).collect()}
    ev_index = [n for n, _ in M.subset_predicates()].index("eva")
    assert prof["T1"][CL.subset_column(ev_index, "LoF_risk")] == 300


def test_generated_code_fits_the_jit(spark, sf_small):
    """No source's assessment needs a method above the 8000 bytes that the JVM compiles."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    # From stored sources: the fixture's arithmetic is no part of the assessment.
    frames = read_sources(spark, write_source_folders(spark, sf_small))
    inputs = replace(fixture_inputs(spark, sf_small), evidence=frames)
    for source in frames:
        df = P.assessed(inputs, only=source)
        df.collect()
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
        assert sizes and max(sizes) < 8000, source
