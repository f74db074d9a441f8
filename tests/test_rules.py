"""Exhaustive truth tables for the assessment rules (O23-O26, O15, O17).

Expected labels come from a plain-Python statement of the rule tables
(first match wins, a NULL nested answer is final, comparisons with NULL are
never true), evaluated row by row and compared with the Spark Column.
"""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doeffect.functions import rules as R
from doeffect.functions import vocab as V
from doeffect.operators.align import union_aligned
from doeffect.operators.assess import label as label_source

L = ["SO_0001587", "SO_0001589"]
PARAMS = R.RuleParams(var_filter_lof=L)

SCHEMA = T.StructType(
    [
        T.StructField("targetId", T.StringType()),
        T.StructField("diseaseId", T.StringType()),
        T.StructField("datasourceId", T.StringType()),
        T.StructField("beta", T.FloatType()),
        T.StructField("oddsRatio", T.FloatType()),
        T.StructField("variantFunctionalConsequenceId", T.StringType()),
        T.StructField("variantFunctionalConsequenceFromQtlId", T.StringType()),
        T.StructField("clinicalSignificances", T.StringType()),
        T.StructField(
            "mutatedSamples",
            T.ArrayType(T.StructType([T.StructField("functionalConsequenceId", T.StringType())])),
        ),
        T.StructField("intogenAnnot", T.IntegerType()),
        T.StructField("TSorOncogene", T.StringType()),
        T.StructField("whatToDo", T.StringType()),
        T.StructField("actionType", T.StringType()),
    ]
)
FIELDS = [f.name for f in SCHEMA.fields]


def label(df, params):
    """All sources of a mixed frame, each by its own rules."""
    src = F.col("datasourceId")
    parts = [label_source(df.where(src == s), s, params) for s in R.SOURCE_RULES]
    rest = df.where(src.isNull() | ~src.isin(list(R.SOURCE_RULES)))
    return union_aligned([*parts, label_source(rest, "other", params)])


def row(**kw):
    base = dict.fromkeys(FIELDS)
    base.update(targetId="T1", diseaseId="D1")
    base.update(kw)
    return tuple(base[f] for f in FIELDS)


# --- plain-Python statement of the rule tables --------------------------------


def _true(*parts):
    return all(p is True for p in parts)


def _in(v, values):
    return None if v is None else v in values


def _not(x):
    return None if x is None else not x


def _cmp(x, op, y):
    return None if x is None else op(x, y)


def _odds(o, kind):
    if _true(_cmp(o, float.__gt__, 1.0)):
        return f"{kind}_risk"
    if _true(_cmp(o, float.__lt__, 1.0)):
        return f"{kind}_protect"
    return None


def _beta(b, kind):
    if _true(_cmp(b, float.__gt__, 0.0)):
        return f"{kind}_risk"
    if _true(_cmp(b, float.__lt__, 0.0)):
        return f"{kind}_protect"
    return None


def expected(r: dict) -> str | None:
    src = r["datasourceId"]
    b, o = r["beta"], r["oddsRatio"]
    b = None if b is None else float(b)
    o = None if o is None else float(o)
    v, q = r["variantFunctionalConsequenceId"], r["variantFunctionalConsequenceFromQtlId"]
    if src == "ot_genetics_portal":
        inl, outl = _in(v, L), _not(_in(v, L))
        up, down = q == "SO_0002315" if q else None, q == "SO_0002316" if q else None
        flat = (q == "SO_0002314") if q else True  # NULL qtl counts as unresolved
        # (condition parts, outcome) in the published order, unmerged
        table = [
            ((up, inl), "dispar"),
            ((b is None, up, outl), lambda: _odds(o, "GoF")),
            ((o is None, up, outl), lambda: _beta(b, "GoF")),
            ((b is None, down, inl), lambda: _odds(o, "LoF")),
            ((o is None, down, inl), lambda: _beta(b, "LoF")),
            ((b is None, down, outl), lambda: _odds(o, "LoF")),
            ((o is None, down, outl), lambda: _beta(b, "LoF")),
            ((b is None, flat, inl), lambda: _odds(o, "LoF")),
            ((o is None, flat, inl), lambda: _beta(b, "LoF")),
        ]
        for parts, out in table:
            if _true(*parts):
                return out() if callable(out) else out
        return "noEvaluable"
    if src == "gene_burden":
        get = r["whatToDo"] == "get" if r["whatToDo"] is not None else None
        for parts, out in [
            ((get, b is None, _cmp(o, float.__gt__, 1.0)), "LoF_risk"),
            ((get, b is None, _cmp(o, float.__lt__, 1.0)), "LoF_protect"),
            ((get, o is None, _cmp(b, float.__gt__, 0.0)), "LoF_risk"),
            ((get, o is None, _cmp(b, float.__lt__, 0.0)), "LoF_protect"),
        ]:
            if _true(*parts):
                return out
        return "noEvaluable"
    if src in ("eva", "eva_somatic"):
        sig = r["clinicalSignificances"]
        if _true(_in(v, L), sig is not None and sig.endswith("pathogenic")):
            return "LoF_risk"
        if _true(sig is not None and "protective" in sig, _in(v, L)):
            return "LoF_protect"
        return "noEvaluable"
    if src == "gene2phenotype":
        return {"SO_0002317": "LoF_risk", "SO_0002315": "GoF_risk"}.get(v, "noEvaluable")
    if src == "orphanet":
        return {"SO_0002054": "LoF_risk", "SO_0002053": "GoF_risk"}.get(v, "noEvaluable")
    if src == "cancer_gene_census":
        return {"oncogene": "GoF_risk", "TSG": "LoF_risk", "bivalent": "bivalent_risk"}.get(
            r["TSorOncogene"]
        )
    if src == "intogen":
        n = r["intogenAnnot"]
        ids = [m[0] for m in r["mutatedSamples"]] if r["mutatedSamples"] is not None else []
        if n == 1:
            if "SO_0002053" in ids:
                return "GoF_risk"
            if "SO_0002054" in ids:
                return "LoF_risk"
            return None
        if n is not None and n > 1:
            return "bivalentIntogen"
        return "noEvaluable"
    if src == "impc":
        return "KO_risk" if r["diseaseId"] is not None else "noEvaluable"
    if src == "chembl":
        a = r["actionType"]
        if a in V.INHIBITORS:
            return "LoF_protect"
        if a in V.ACTIVATORS:
            return "GoF_protect"
        return "noEvaluable"
    return None


def _check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = label(df, PARAMS).select(*FIELDS, "Assessment").collect()
    assert len(got) == len(rows)
    for r in got:
        d = r.asDict()
        assert d["Assessment"] == expected(d), d


EFFECTS = [None, -0.5, 0.0, 0.5, 1.0, 2.0]
QTLS = [None, "SO_0002314", "SO_0002315", "SO_0002316", "SO_0000001"]
VARIANTS = [None, "SO_0001587", "SO_0001589", "SO_0002315", "SO_9999999"]


def test_genetics_portal_truth_table(spark):
    rows = [
        row(datasourceId="ot_genetics_portal", beta=b, oddsRatio=o,
            variantFunctionalConsequenceId=v, variantFunctionalConsequenceFromQtlId=q)
        for b, o, v, q in itertools.product(EFFECTS, EFFECTS, VARIANTS, QTLS)
    ]
    _check(spark, rows)


def test_gene_burden_truth_table(spark):
    rows = [
        row(datasourceId="gene_burden", beta=b, oddsRatio=o, whatToDo=w)
        for b, o, w in itertools.product(EFFECTS, EFFECTS, [None, "get", "notGet", "noGet"])
    ]
    _check(spark, rows)


@pytest.mark.parametrize("source", ["eva", "eva_somatic"])
def test_clinvar_truth_table(spark, source):
    sigs = [None, "", "pathogenic", "benign,likely pathogenic", "protective",
            "pathogenic,risk factor", "protective,pathogenic"]
    rows = [
        row(datasourceId=source, variantFunctionalConsequenceId=v, clinicalSignificances=s)
        for v, s in itertools.product(VARIANTS, sigs)
    ]
    _check(spark, rows)


def test_simple_sources(spark):
    ids = VARIANTS + ["SO_0002317", "SO_0002053", "SO_0002054"]
    rows = [row(datasourceId=s, variantFunctionalConsequenceId=v)
            for s in ("gene2phenotype", "orphanet") for v in ids]
    rows += [row(datasourceId="cancer_gene_census", TSorOncogene=t)
             for t in [None, "oncogene", "TSG", "bivalent", "noEvaluable"]]
    rows += [row(datasourceId="impc", diseaseId=d) for d in [None, "D1"]]
    rows += [row(datasourceId="chembl", actionType=a)
             for a in [None, "INHIBITOR", "AGONIST", "BINDING AGENT", "STABILISER", "DISRUPTING AGENT"]]
    rows += [row(datasourceId=s) for s in [None, "clingen", "uniprot_literature"]]
    _check(spark, rows)


def test_intogen_truth_table(spark):
    arrays = [None, [], [("SO_0002053",)], [("SO_0002054",)], [("SO_0002053",), ("SO_0002054",)],
              [("SO_0001583",), (None,)], [(None,)]]
    rows = [row(datasourceId="intogen", intogenAnnot=n, mutatedSamples=a)
            for n, a in itertools.product([None, 0, 1, 2, 5], arrays)]
    _check(spark, rows)


def test_normal_forms(spark):
    labels = [None, "KO_risk", "bivalentIntogen", "bivalent_risk", "dispar", "noEvaluable",
              "LoF_risk", "GoF_risk", "LoF_protect", "GoF_protect", "null"]
    df = spark.createDataFrame([(x,) for x in labels], "Assessment string")
    h = R.homogenize(F.col("Assessment"))
    out = df.select(
        "Assessment",
        h.alias("h"),
        R.tendency(h).alias("t"),
        R.variation(h).alias("v"),
        R.unify(F.col("Assessment"), h).alias("u"),
    ).collect()
    want_h = {"KO_risk": "LoF_risk", "bivalentIntogen": "bivalent_risk"}
    for r in out:
        a = r["Assessment"]
        h_exp = want_h.get(a, a)
        assert r["h"] == h_exp
        t_exp = "noEvaluable" if h_exp is None else (
            "Risk" if "risk" in h_exp else "Protect" if "protect" in h_exp else "noEvaluable")
        v_exp = "noEvaluable" if h_exp is None else (
            "LoF" if "LoF" in h_exp else "GoF" if "GoF" in h_exp else "noEvaluable")
        assert (r["t"], r["v"]) == (t_exp, v_exp), a
        u_exp = "evidenceDif" if a is None or a in V.NON_DIRECTIONAL_TERMS else (
            "LoF_risk" if a == "KO_risk" else h_exp)
        assert r["u"] == u_exp, a
    # bivalentIntogen is not a non-directional term: it stays bivalent_risk
    assert {r["Assessment"]: r["u"] for r in out}["bivalentIntogen"] == "bivalent_risk"


def test_action_class(spark):
    actions = V.INHIBITORS + V.ACTIVATORS + [None, "BINDING AGENT", "inhibitor"]
    df = spark.createDataFrame([(a,) for a in actions], "a string")
    got = dict(df.select("a", R.action_class(F.col("a")).alias("c")).collect())
    for a in actions:
        want = "inhibitor" if a in V.INHIBITORS else "activator" if a in V.ACTIVATORS else "noEvaluable"
        assert got[a] == want


def test_onco_class_is_order_free(spark):
    cases = {
        ("TSG",): "TSG",
        ("oncogene",): "oncogene",
        ("Oncogene",): "oncogene",
        ("oncogene,fusion",): "noEvaluable",
        ("fusion,oncogene",): "oncogene",
        ("oncogene,fusion", "oncogene"): "oncogene",
        ("oncogene", "oncogene,fusion"): "oncogene",
        ("TSG", "oncogene"): "bivalent",
        ("TSG,oncogene",): "bivalent",
        ("oncogene,fusion", "TSG"): "bivalent",
    }
    df = spark.createDataFrame([(list(k),) for k in cases], "d array<string>")
    got = {tuple(r["d"]): r["c"] for r in df.select("d", R.onco_class(F.col("d")).alias("c")).collect()}
    assert got == cases


def test_phase_flags(spark):
    phases = [None, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(p,) for p in phases], "p double")
    out = df.select("p", *R.phase_flags(F.col("p"))).collect()
    for r in out:
        p = r["p"]
        for name, value, lab in V.PHASE_EXACT:
            assert r[name] == (lab if p == value else "dif")
        for name, value, lab in V.PHASE_AT_LEAST:
            assert r[name] == (lab if p is not None and p >= value else "dif")
