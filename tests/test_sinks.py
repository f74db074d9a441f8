"""Report sink: partitioned write, dynamic overwrite, manifest, end-to-end run."""

from __future__ import annotations

import glob
import os
import tempfile
from dataclasses import replace

from doeffect.functions import vocab as V
from doeffect.operators.contingency import CONTINGENCY_COLUMNS
from doeffect.plans import run as P
from doeffect.plans.inputs import fixture_inputs
from doeffect.sources import sinks

from .conftest import bag


def _report(spark, rows):
    return spark.createDataFrame(
        rows,
        "dataset string, comparisonColumn string, predictionColumn string, prediction string, "
        "comparison string, comparisonType string, predictionType string, a bigint, "
        "predictionTotal bigint, comparisonTotal bigint, total bigint",
    )


def test_roundtrip_by_run_date(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="doeffect-sink-"), "report")
    r1 = _report(spark, [("!chembl", "c1", "p1", "PhaseIV", "coherent", "byDatatype", "clinical", 1, 2, 3, 4),
                         ("eva", "c1", "p1", "dif", "dispar", "byDatatype", "clinical", 5, 6, 7, 8)])
    sinks.write_contingency(r1, path, "run-a")
    r2 = _report(spark, [("eva", "c2", "p2", "dif", "dispar", "byDataType", "clinical", 9, 9, 9, 9)])
    sinks.write_contingency(r2, path, "run-b")
    back = sinks.read_contingency(spark, path)
    assert bag(back.where("run_date = 'run-a'"), CONTINGENCY_COLUMNS) == bag(r1, CONTINGENCY_COLUMNS)
    # rewriting run-b replaces only run-b's folder
    sinks.write_contingency(r2, path, "run-b")
    assert sinks.read_contingency(spark, path).count() == 3
    manifest = sinks.contingency_manifest(
        sinks.read_contingency(spark, path), "run-a", ["!chembl", "eva"], [("c1", ""), ("c2", "")], [("p1", "")]
    )
    assert {r["path"]: r["rows"] for r in manifest.collect()} == {
        "run-a_original/_!chembl_c1_p1.parquet": 1, "run-a_original/_eva_c1_p1.parquet": 1,
        "run-a_original/_!chembl_c2_p1.parquet": 0, "run-a_original/_eva_c2_p1.parquet": 0,
    }


def test_run_date_stays_text_and_manifest_has_all_cells(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="doeffect-sink-"), "report")
    # No disease under Oncology: a third of the comparisons have no rows.
    rows = [(d, c, p, "dif", "x", t, "clinical", 1, 1, 1, 1) for d in V.SUBSET_NAMES for c, t in V.COMPARISONS
            if not c.startswith("oncology") for p, _ in V.PREDICTIONS]
    sinks.write_contingency(_report(spark, rows), path, "2024-06-01")
    back = sinks.read_contingency(spark, path)
    assert dict(back.dtypes)["run_date"] == "string" and back.first()["run_date"] == "2024-06-01"
    manifest = sinks.contingency_manifest(back, "2024-06-01")
    assert manifest.count() == 1560 and manifest.where("rows = 0").count() == 1560 - len(rows) == 520


def test_run_writes_the_grid(spark, sf_small):
    out = os.path.join(tempfile.mkdtemp(prefix="doeffect-run-"), "report")
    inputs = fixture_inputs(spark, sf_small)
    scored = P.run(spark, inputs, out, "test-run")
    written = sinks.read_contingency(spark, out)
    expected = P.report(inputs)
    assert bag(written.drop("run_date"), CONTINGENCY_COLUMNS) == bag(expected, CONTINGENCY_COLUMNS)
    assert scored.count() == P.scored(inputs).count()


def test_read_annotations_csv_header_and_quotes(spark):
    from doeffect.sources.readers import read_annotations_csv, read_study_inclusion

    folder = tempfile.mkdtemp(prefix="doeffect-csv-")
    path = os.path.join(folder, "study.csv")
    with open(path, "w") as fh:
        fh.write(",statisticalMethodOverview,count,comment,whatToDo\n")
        fh.write('0,"Burden test with PTV,missense variants",3,,get\n')
        fh.write('1,Burden test with synonymous variants,5,"a note, with comma",notGet\n')
    raw = read_annotations_csv(spark, path)
    assert raw.columns == ["_c0", "statisticalMethodOverview", "count", "comment", "whatToDo"]
    assert all(t == "string" for _, t in raw.dtypes)
    study = {r["stMethod"]: r["whatToDo"] for r in read_study_inclusion(spark, path).collect()}
    assert study == {"Burden test with PTV,missense variants": "get",
                     "Burden test with synonymous variants": "notGet"}


def _files_read(df) -> int:
    """Files that the scans of an executed query listed, from their metrics."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numFiles")
        if metric.isDefined():
            found += metric.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_one_source_reads_its_folder_alone(spark, sf_small):
    from doeffect.plans.registry import write_source_folders
    from doeffect.sources.readers import read_evidence, read_sources

    root = write_source_folders(spark, sf_small)
    ev = read_evidence(spark, root)
    assert "sourceId" in ev.columns and "mutatedSamples" in ev.columns
    only = ev.where("sourceId = 'impc'")
    assert only.count() == ev.where("datasourceId = 'impc'").count()
    only.collect()
    own = len(glob.glob(f"{root.removeprefix('file:')}/sourceId=impc/*.parquet"))
    assert _files_read(only) == own
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= len(V.EVIDENCE_SOURCES)

    inputs = replace(fixture_inputs(spark, sf_small), evidence=read_sources(spark, root))
    drugs = P.assessed(inputs, only="chembl").select("Assessment", "targetId")
    listed = [f for f in drugs.inputFiles() if "sourceId=" in f]
    assert listed and all("sourceId=chembl/" in f for f in listed)


def test_release_layout_gives_the_same_report(spark, sf_small):
    """Write the fixtures as a data release (per-source evidence folders with
    their own columns, entity tables, study CSV) and run through
    ``release_inputs``: the written report equals the fixture report."""
    from doeffect.plans.inputs import release_inputs
    from doeffect.sources import fixtures
    from doeffect.sources.fixtures import FIXTURE_VAR_FILTER_LOF

    root = os.path.join(tempfile.mkdtemp(prefix="doeffect-release-"), "release")
    fixtures.write_release(spark, sf_small, root)
    study_csv = f"{root}/study.csv"

    out = os.path.join(os.path.dirname(root), "report")
    P.run(spark, release_inputs(spark, root, study_csv, FIXTURE_VAR_FILTER_LOF), out, "release-run")
    written = sinks.read_contingency(spark, out).drop("run_date")
    inputs = fixture_inputs(spark, sf_small)
    del inputs.evidence[fixtures.OTHER]
    assert bag(written, CONTINGENCY_COLUMNS) == bag(P.report(inputs), CONTINGENCY_COLUMNS)
