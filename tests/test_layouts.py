"""Layouts and plans: root scan and pruning, split joins, buckets by pair, reruns, kept rows."""

from __future__ import annotations

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doeffect.functions import rules as R
from doeffect.functions import vocab as V
from doeffect.operators import by_pair as BP
from doeffect.operators.clinical import restrict_to_drug_pairs
from doeffect.operators.matrix import label_counts
from doeffect.operators.assess import assess
from doeffect.operators.ontology import primary_area, ranked_area
from doeffect.operators.skew import hot_keys, split_left_join
from doeffect.plans import run as P
from doeffect.plans.inputs import fixture_inputs
from doeffect.plans.registry import QUERIES, write_source_folders
from doeffect.sources import fixtures, readers, sinks

from .conftest import bag
from .test_sinks import _files_read, _report


@pytest.fixture
def conf(spark):
    """Settings that hold for one test."""
    before = {}

    def set_conf(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield set_conf
    for key, value in before.items():
        spark.conf.set(key, value)


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- root scan -----------------------------------------------------------------


def test_all_rows_are_read(spark, sf_small):
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
    for name in ("union_aligned", "read_evidence", "scan_evidence"):
        got = QUERIES[name](spark, sf_small)
        assert got.count() == lines, name
        sources = {r[0] for r in got.select("datasourceId").distinct().collect()}
        assert sources == {*V.READ_SOURCES, None}, name


def test_filter_prunes_folders(spark, sf_small):
    root = write_source_folders(spark, sf_small)
    ev = readers.scan_evidence(spark, root, fixtures.EVIDENCE_SCHEMA)
    some = ev.where(F.col("sourceId").isin("impc", "clingen")).select("targetId", "sourceId")
    plan = _executed(some)
    assert re.search(r"PartitionFilters: \[.*sourceId.*IN \(impc,clingen\)", plan), plan
    assert "ReadSchema: struct<targetId:string>" in plan
    everything = ev.select("targetId")
    everything.collect()
    assert 0 < _files_read(some) < _files_read(everything)
    none = ev.where("sourceId IS NULL")
    assert none.count() == fixtures.source_frames(spark, sf_small)[fixtures.OTHER].where("datasourceId IS NULL").count() > 0


def test_join_prunes_folders(spark, sf_small):
    got = QUERIES["scan_evidence_group"](spark, sf_small)
    plan = _executed(got)
    assert "dynamicpruning" in plan, plan
    assert {r[0] for r in got.select("sourceId").distinct().collect()} == set(V.GERMLINE)


def test_merged_schema_is_that_of_all_sources(spark, sf_small):
    root = write_source_folders(spark, sf_small)
    merged = readers.scan_evidence(spark, root)
    declared = readers.scan_evidence(spark, root, fixtures.EVIDENCE_SCHEMA)
    assert dict(merged.dtypes) == dict(declared.dtypes)
    assert bag(merged, ["targetId", "sourceId", "beta", "drugId"]) == bag(declared, ["targetId", "sourceId", "beta", "drugId"])


# --- CSV with bad lines ------------------------------------------------------------


def test_bad_lines_are_kept_apart(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="doeffect-csv-"), "study.csv")
    lines = ["name,count,note", "a,1,x", 'b,2,"y, z"', "c,three,x", "d,4", "e,5,x,more", ",,", "f,,x"]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    schema = T.StructType.fromDDL("name string, count int, note string")
    rows = readers.read_annotations_csv(spark, path, schema, bad_lines="bad").collect()
    got = {r.name: (r["count"], r.note, r.bad) for r in rows}
    assert got["a"] == (1, "x", None) and got["b"] == (2, "y, z", None) and got["f"] == (None, "x", None)
    assert got["c"] == (None, "x", "c,three,x") and got["d"][2] == "d,4" and got["e"][2] == "e,5,x,more"
    assert got[None] == (None, None, None) and len(rows) == 7


# --- ranked areas ------------------------------------------------------------------


def test_ranked_area_equals_primary_area(spark, sf_small):
    diseases = fixtures.diseases(spark, sf_small)
    ranked = ranked_area(diseases, readers.therapeutic_areas(spark))
    columns = ["diseaseId", "taId", "taLabel", "taLabelSimple"]
    assert bag(ranked, columns) == bag(primary_area(diseases), columns)
    ranks = {r.taId: r.taRank for r in ranked.collect()}
    assert all(V.THERAPEUTIC_AREAS[k][0] == ta for ta, k in ranks.items())
    # Areas that are data: another order gives another area.
    other = readers.inline_table(
        spark, [("MONDO_0045024", "it's", "x", 2), ("EFO_0005741", None, "y", 1)],
        ["taId", "taLabel", "taLabelSimple", "taRank"], ["string", "string", "string", "bigint"],
    )
    again = ranked_area(diseases.where("array_contains(therapeuticAreas, 'MONDO_0045024')"), other)
    assert {(r.taId, r.taLabel, r.taRank) for r in again.collect()} == {("EFO_0005741", None, 1)}


# --- split joins -------------------------------------------------------------------


def _skewed(spark, n=6000):
    """A third of the rows have one gene; some have none, some an unknown one."""
    gene = F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("T"), F.col("id") % 97))
    return spark.range(0, n, 1, 12).select(gene.alias("gene"), (F.col("id") % 10).alias("v"))


def test_hot_gene_meets_in_many_tasks(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    left = _skewed(spark)
    right = left.where("gene is not null and gene not in ('T5', 'T6')").select(F.col("gene").alias("id")).distinct().withColumn("label", F.concat(F.lit("L"), "id"))
    right = right.unionByName(right.where("id in ('HOT', 'T7')").withColumn("label", F.lit("second")))
    plain = left.join(right, F.col("gene") == F.col("id"), "left")
    split = split_left_join(left, right, [("gene", "id")], 16)
    assert split.columns == plain.columns and bag(split) == bag(plain)

    def tasks(df):
        return df.where("gene = 'HOT'").select(F.spark_partition_id().alias("p")).groupBy("p").count().count()

    assert "SortMergeJoin" in _executed(split)
    assert tasks(plain) == 1 and tasks(split) >= 6
    assert [r["_h0"] for r in hot_keys(left, ["gene"], 16).collect()] == ["HOT"]


def test_no_hot_key_is_the_plain_join(spark):
    left = spark.range(300).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.col("id").alias("r"), F.lit("x").alias("w"))
    assert bag(split_left_join(left, right, [("k", "r")], 8)) == bag(left.join(right, F.col("k") == F.col("r"), "left"))
    empty = left.limit(0)
    assert split_left_join(empty, right, [("k", "r")], 8).collect() == []
    assert split_left_join(left, right.limit(0), [("k", "r")], 8).where("w is null").count() == 300


def test_split_assessment_without_broadcasts(spark, sf_small, conf):
    columns = ["targetId", "diseaseId", "datasourceId", "Assessment", "unified"]
    want = bag(P.assessed(fixture_inputs(spark, sf_small)), columns)
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    assert bag(P.assessed(fixture_inputs(spark, sf_small), split=8), columns) == want


# --- buckets by pair ---------------------------------------------------------------


def test_label_counts_by_pair_exchange_no_evidence(spark, sf_small, tmp_path):
    inputs = fixture_inputs(spark, sf_small)
    names = BP.write_by_pair(inputs.evidence, f"{tmp_path}/by-pair", 4)
    frames = BP.read_by_pair(spark, names)
    got = BP.drug_pair_label_counts(frames, P.sides(inputs), inputs.params)
    rows = assess(restrict_to_drug_pairs(inputs.evidence), P.sides(inputs), inputs.params)
    assert bag(got) == bag(label_counts(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    evidence = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "pairTarget" in line]
    assert not evidence, evidence
    # What is exchanged at all is below a broadcast side: mechanisms and studies are made distinct.
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanged if "diseaseId" in line or "datasourceId" in line], exchanged
    assert plan.count("Bucketed: true") >= len(frames)


def test_null_pairs_are_pairs(spark, tmp_path):
    rows = [("t", None, "chembl"), ("t", None, "impc"), (None, "d", "impc"), ("", None, "impc"), ("t", "", "impc"), (None, None, "chembl"), (None, None, "impc")]
    df = spark.createDataFrame(rows, "targetId string, diseaseId string, datasourceId string")
    keyed = BP.with_pair_keys(df)
    assert keyed.select(*BP.KEYS).distinct().count() == keyed.select(R.TARGET, R.DISEASE).distinct().count() == 5
    assert keyed.where(F.col(BP.KEYS[0]).isNull() | F.col(BP.KEYS[1]).isNull()).count() == 0


# --- reruns, files, kept rows --------------------------------------------------------


def test_rerun_with_fewer_cells_leaves_only_its_own(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="doeffect-sink-"), "report")
    cell = ("dif", "x", "byDatatype", "clinical", 1, 1, 1, 1)
    rows = [(d, c, "p1", *cell) for d in ("eva", "!chembl", "impc") for c in ("c1", "c2")]
    odd = "a/b:c=d e%"
    for run_date in ("2024-06-01", "2024-06-02", odd):
        sinks.write_contingency(_report(spark, rows), path, run_date)
    sinks.write_contingency(_report(spark, rows[:1]), path, "2024-06-01")
    back = sinks.read_contingency(spark, path)
    assert {r["run_date"]: r["count"] for r in back.groupBy("run_date").count().collect()} == {"2024-06-01": 1, "2024-06-02": 6, odd: 6}
    # Nothing is left of an empty report, and the others stay.
    sinks.write_contingency(_report(spark, rows).limit(0), path, "2024-06-02")
    assert sinks.read_contingency(spark, path).groupBy("run_date").count().count() == 2


def test_files_say_what_was_written(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="doeffect-sink-"), "report")
    cell = ("dif", "x", "byDatatype", "clinical", 1, 1, 1, 1)
    sinks.write_contingency(_report(spark, [(d, "c1", p, *cell) for d in ("eva", "!chembl") for p in ("p1", "p2")]), path, "r")
    files = sinks.written_files(spark, path).collect()
    assert len(files) == 2 and {f.rows for f in files} == {2}
    for f in files:
        local = f.file_path.removeprefix("file:").replace("%20", " ")
        assert f.folder == f"run_date=r/dataset={f.dataset}/comparisonColumn=c1" and f"/{f.folder}/" in local
        assert os.path.getsize(local) == f.file_bytes


def test_kept_rows_serve_both_reports(spark, sf_small):
    spark.catalog.clearCache()
    got = QUERIES["persisted_reports"](spark, sf_small)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2
    level = re.findall(r"StorageLevel\((.*?)\)", plan)
    assert len(set(level)) == 1 and "memory" in level[0] and "disk" in level[0]
    assert got.count() > 0
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert executed.count("InMemoryTableScan") >= 2
    spark.catalog.clearCache()
