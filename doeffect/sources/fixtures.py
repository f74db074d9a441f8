"""Evidence-shaped tables derived from the driver's TPC-H-like Parquet tables.

The real inputs (evidence per source, targets, diseases, drug mechanisms,
curated study list, sequence ontology) are not available here, so these
functions derive tables of the same shape from ``lineitem``, ``part`` and
``nation`` with fixed arithmetic.  The values mean nothing biologically; they
exercise every rule branch and unmatched join.  No recipe drops a row: every
``lineitem`` row is one evidence row and one mechanism, every ``part`` row
one hallmark description.  Genes, drugs, diseases and studies grow with the
tables, and so do the side tables made of them.

The recipes are deterministic and engine-neutral; the DuckDB forms in
``doeffect.plans.oracle`` compute the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V

# The loss-of-function variant list used with these fixtures
# (the rules take it as a parameter; it has no published default).
FIXTURE_VAR_FILTER_LOF = ["SO_0001587", "SO_0001589"]

# Columns each source carries beside the keys.
SOURCE_COLUMNS = {
    "ot_genetics_portal": ["beta", "oddsRatio", "variantFunctionalConsequenceId",
                           "variantFunctionalConsequenceFromQtlId"],
    "gene_burden": ["beta", "oddsRatio", "statisticalMethodOverview"],
    "eva": ["variantFunctionalConsequenceId", "clinicalSignificances"],
    "eva_somatic": ["variantFunctionalConsequenceId", "clinicalSignificances"],
    "gene2phenotype": ["variantFunctionalConsequenceId"],
    "orphanet": ["variantFunctionalConsequenceId"],
    "cancer_gene_census": ["mutatedSamples"],
    "intogen": ["mutatedSamples"],
    "impc": [],
    "chembl": ["drugId", "clinicalPhase", "diseaseFromSourceId"],
}
# All of them together, as one relation.
EVIDENCE_SCHEMA = (
    "targetId string, diseaseId string, datasourceId string, beta double, oddsRatio double, "
    "variantFunctionalConsequenceId string, variantFunctionalConsequenceFromQtlId string, "
    "statisticalMethodOverview string, clinicalSignificances array<string>, "
    "mutatedSamples array<struct<functionalConsequenceId:string>>, "
    "drugId string, clinicalPhase double, diseaseFromSourceId string"
)
# Key of the frame of all rows whose source has no rules (or is NULL).
OTHER = "other"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(expr: Column, mapping: Mapping[int, Column | str | float | None]) -> Column:
    """CASE expr WHEN k THEN v ... END (no ELSE: unmatched keys are NULL)."""
    out = None
    for key, value in mapping.items():
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(expr == key, v) if out is None else out.when(expr == key, v)
    return out


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("bigint").cast("string"))


def _tenth(c: Column | str, of: int = 10) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(of))).cast("bigint")


def _arr(*items: str | None) -> Column:
    return F.array(*[F.lit(x).cast("string") for x in items])


def _disease(part: Column | str, order: Column) -> Column:
    """Sixty diseases for every two thousand parts."""
    return _named("D", _tenth(part, 2000) * 60 + order)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with the hash keys of the recipes, each computed once per row."""
    k0 = F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 31 + F.col("l_suppkey") * 3
    k2 = _tenth(F.col("l_orderkey") * 11 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 5, 3)
    return table(spark, sf_dir, "lineitem").select("*", k0.alias("_k0"), k2.alias("_k2"))


def _columns() -> dict[str, Column]:
    """The recipe of every evidence column but the source."""
    k1, k2 = _tenth("_k0"), F.col("_k2")

    def samples(*ids: str | None) -> Column:
        return F.array(*[F.struct(F.lit(x).cast("string").alias("functionalConsequenceId")) for x in ids])

    return {
        "targetId": _named("T", _tenth("l_partkey")),
        "diseaseId": F.when(k2 % 97 != 0, _disease("l_partkey", F.col("l_orderkey") % 60)),
        "beta": F.when((k1 % 4).isin(0, 3), F.col("l_discount") - F.lit(0.05)),
        "oddsRatio": F.when(k1 % 4 == 1, F.col("l_quantity") / F.lit(25.0)).when(k1 % 4 == 3, F.lit(1.5)),
        "variantFunctionalConsequenceId": _case(
            k2 % 8,
            {0: "SO_0001587", 1: "SO_0001589", 2: "SO_0002315", 3: "SO_0002317",
             4: "SO_0002053", 5: "SO_0002054", 6: "SO_0001583"},
        ),
        "variantFunctionalConsequenceFromQtlId": _case(
            _tenth(k1, 4) % 4, {0: "SO_0002314", 1: "SO_0002315", 2: "SO_0002316"}
        ),
        "clinicalSignificances": _case(
            k1 % 5,
            {
                0: _arr("pathogenic"),
                1: _arr("benign", "likely pathogenic"),
                2: _arr("protective"),
                3: _arr("pathogenic", "risk factor"),
            },
        ),
        "mutatedSamples": _case(
            k2 % 6,
            {
                0: samples("SO_0002053"),
                1: samples("SO_0002054"),
                2: samples("SO_0002053", "SO_0002054"),
                3: samples("SO_0001583", None),
                4: samples("SO_0001583"),
            },
        ),
        "statisticalMethodOverview": _named("M", _tenth("l_partkey", 50)),
        "drugId": _named("C", F.col("l_suppkey")),
        "clinicalPhase": _case(F.col("l_linenumber"), {1: 0.5, 2: 1.0, 3: 2.0, 4: 3.0, 5: 4.0}).cast("double"),
        "diseaseFromSourceId": _named("S", F.col("l_orderkey") % 500),
    }


def source_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One evidence row per ``lineitem`` row: ten per-source frames with their
    own columns, and the rows of the four sources without rules, or of none (NULL)."""
    rows, columns, k0 = _hashed(spark, sf_dir), _columns(), F.col("_k0")
    unlisted, missing = k0 % 101 == 0, k0 % 103 == 1

    def frame(keep: Column, source: Column, own: list[str]) -> DataFrame:
        fields = {"targetId": columns["targetId"], "diseaseId": columns["diseaseId"], "datasourceId": source}
        fields |= {c: columns[c] for c in own}
        return rows.where(keep).select(*[c.alias(name) for name, c in fields.items()])

    frames = {
        s: frame((k0 % 10 == i) & ~unlisted & ~missing, F.lit(s), SOURCE_COLUMNS[s])
        for i, s in enumerate(V.EVIDENCE_SOURCES)
    }
    # (k0 / 101 is a whole number where it is used.)
    named = F.get(F.array(*[F.lit(s) for s in V.UNASSESSED_SOURCES]), (_tenth(k0, 101) % len(V.UNASSESSED_SOURCES)).cast("int"))
    frames[OTHER] = frame(unlisted | missing, F.when(unlisted, named), [])
    return frames


def write_sources(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write the evidence as ``<root>/sourceId=<source>/`` Parquet folders, each
    with its own columns; rows without a source lie in the default partition."""
    for source, rows in source_frames(spark, sf_dir).items():
        if source == OTHER:
            rows.withColumn("sourceId", F.col("datasourceId")).write.mode("append").partitionBy("sourceId").parquet(root)
        else:
            rows.write.parquet(f"{root}/sourceId={source}")
    return root


def write_release(spark: SparkSession, sf_dir: str, root: str) -> str:
    """The fixtures in the layout of a data release (see ``plans.inputs``)."""
    write_sources(spark, sf_dir, f"{root}/evidence")
    for name, rows in (("targets", targets), ("diseases", diseases), ("mechanismOfAction", mechanisms)):
        rows(spark, sf_dir).write.parquet(f"{root}/{name}")
    study = study_inclusion(spark, sf_dir).withColumnRenamed("stMethod", "statisticalMethodOverview")
    study.write.option("header", True).csv(f"{root}/study.csv")
    return root


def source_catalog(spark: SparkSession) -> DataFrame:
    """``subset, sourceId``: the sources of each group."""
    groups = [("germline", V.GERMLINE), ("somatic", V.SOMATIC), ("drug", [V.DRUG_SOURCE]), ("unassessed", V.UNASSESSED_SOURCES)]
    return spark.createDataFrame([(g, s) for g, sources in groups for s in sources], "subset string, sourceId string")


def study_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a hand-edited study list: every seventh has a count that is no
    number, every eleventh a cell too many, every thirteenth too few."""
    m = F.col("m")
    count = F.when(m % 7 == 3, F.concat(m.cast("string"), F.lit(" studies"))).otherwise(m.cast("string"))
    cells = [_named("M", m), count, F.when(m % 2 == 0, F.lit('"a note, with comma"')).otherwise(""), F.lit("get")]
    line = F.when(m % 13 == 5, F.concat_ws(",", *cells[:2])).when(m % 11 == 4, F.concat_ws(",", *cells, F.lit("more")))
    rows = table(spark, sf_dir, "part").select(_tenth("p_partkey", 50).alias("m")).distinct()
    return rows.select(F.coalesce(line, F.concat_ws(",", *cells)).alias("value"))


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug mechanisms: ``chemblIds, actionType, mechanismOfAction, targets``.

    A third of them name a drug, a third have an empty list and a third none;
    likewise a few have an empty list of targets or none.
    """
    part = F.col("l_partkey")
    # Distinct by whole numbers; the lists are made of what is left.
    keys = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("drug"),
            _tenth(part).alias("gene"),
            (F.col("l_linenumber") % 2).alias("moa"),
            (part % 3).alias("drugs"),
            F.when((part % 11).isin(5, 6), part % 11).otherwise(0).alias("genes"),
        )
        .distinct()
    )
    drug, gene = F.col("drug"), F.col("gene")
    none = F.lit(None).cast(T.ArrayType(T.StringType()))
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return keys.select(
        F.when(F.col("drugs") == 0, F.array(_named("C", drug))).when(F.col("drugs") == 1, empty).otherwise(none).alias("chemblIds"),
        _case((drug + gene) % 5, {0: "INHIBITOR", 1: "AGONIST", 2: "BLOCKER", 3: "BINDING AGENT"}).alias("actionType"),
        _named("moa-", F.col("moa")).alias("mechanismOfAction"),
        F.when(F.col("genes") == 5, empty)
        .when(F.col("genes") == 6, none)
        .otherwise(F.array(_named("T", gene), _named("T", gene + 1)))
        .alias("targets"),
    )


def diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases: ``id, descendants, therapeuticAreas``."""
    keys = table(spark, sf_dir, "lineitem").select(
        _tenth("l_partkey", 2000).alias("block"), (F.col("l_orderkey") % 60).alias("i")
    ).distinct()
    i = F.col("i")

    def disease(order: Column) -> Column:
        return _named("D", F.col("block") * 60 + order)

    empty = F.array().cast(T.ArrayType(T.StringType()))
    descendants = (
        F.when(i % 10 == 9, F.lit(None).cast(T.ArrayType(T.StringType())))
        .when(i < 20, F.array(disease(i + 20), disease(i + 40)))
        .otherwise(empty)
    )
    areas = F.when(i % 15 == 4, _arr("EFO_0000319", "EFO_0000319")).otherwise(
        _case(
            i % 5,
            {
                0: _arr("EFO_0005741", "MONDO_0045024"),
                1: _arr("EFO_0000319"),
                2: _arr("EFO_0000540", "EFO_0000651"),
                3: _arr("UNLISTED"),
            },
        )
    )
    return keys.select(disease(i).alias("id"), descendants.alias("descendants"), areas.alias("therapeuticAreas"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of ten parts each, nested like the entity table:
    ``id, approvedSymbol, hallmarks.attributes[].description``."""
    gene = _tenth("p_partkey")
    description = _case(
        (gene + (F.col("p_size") % 2) * (gene % 3)) % 9,
        {0: "TSG", 1: "oncogene", 2: "oncogene,fusion", 3: "fusion,oncogene", 4: "TSG,oncogene", 5: "Oncogene"},
    )
    return (
        table(spark, sf_dir, "part")
        .select(gene.alias("g"), F.coalesce(description, F.col("p_type")).alias("description"))
        .groupBy("g")
        # Ten rows a gene, at any size of the table.
        .agg(F.collect_list(F.struct("description")).alias("attributes"))
        .select(_named("T", F.col("g")).alias("id"), _named("SYM", F.col("g")).alias("approvedSymbol"), F.struct("attributes").alias("hallmarks"))
    )


def study_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated study list: ``stMethod, count, comment, whatToDo`` (a third of the methods unlisted)."""
    m = F.col("m")
    return (
        table(spark, sf_dir, "part")
        .select(_tenth("p_partkey", 50).alias("m"))
        .distinct()
        .select(
            F.when(m % 6 < 4, _named("M", m)).otherwise(_named("unused-", m)).alias("stMethod"),
            m.cast("string").alias("count"),
            F.when(m % 2 == 0, F.lit("a note, with comma")).alias("comment"),
            _case(m % 4, {0: "get", 1: "notGet", 2: "get", 3: "noGet"}).alias("whatToDo"),
        )
    )


def sequence_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Accession, Parents`` from ``nation`` (a small tree; some parents have a blank in front)."""
    key = F.col("n_nationkey")
    parent = _named("NATION_", _tenth(key - 1, 2))
    parents = (
        F.when(key == 0, F.lit(None).cast("string"))
        .when(key % 3 == 0, F.concat(parent, F.lit(",NATION_0")))
        .when(key % 5 == 0, F.concat(parent, F.lit(", NATION_1")))
        .otherwise(parent)
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("Accession"), parents.alias("Parents"))
