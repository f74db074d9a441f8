"""Side annotations of evidence: gene labels, drug mechanisms, consequence counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions import vocab as V


def oncogene_label(targets: DataFrame) -> DataFrame:
    """One row per labelled gene: ``target_id, approvedSymbol, description, TSorOncogene``.

    ``targets`` has one row per gene with ``hallmarks.attributes[].description``.
    The listed descriptions are picked out of that array in place (distinct,
    sorted); genes with none are absent.  Narrow: no explode and no grouping.
    """
    listed = F.filter(F.col("hallmarks.attributes.description"), lambda d: d.isin(V.ONCO_TSG_DESCRIPTIONS))
    return (
        targets.select(
            F.col("id").alias("target_id"), "approvedSymbol", F.sort_array(F.array_distinct(listed)).alias("description")
        )
        .where(F.size("description") > 0)
        .withColumn(R.ONCO_LABEL, R.onco_class(F.col("description")))
    )


def _or_null(name: str) -> Column:
    """The array, or one NULL in place of a missing or empty one."""
    none = F.array(F.lit(None).cast(T.StringType()))
    return F.when(F.size(name) > 0, F.col(name)).otherwise(none)


def mechanism_pairs(mechanisms: DataFrame) -> DataFrame:
    """(drug, target) pairs of each mechanism: ``targetId2, drugId2, actionType, mechanismOfAction``.

    Both lists count as outer: a mechanism without drugs or targets keeps a
    NULL on that side.  Two mechanisms of one (drug, target) stay two rows, so
    a join on the pair fans out; that is intended.
    """
    pairs = F.flatten(
        F.transform(
            _or_null("targets"),
            lambda t: F.transform(_or_null("chemblIds"), lambda d: F.struct(t.alias("targetId2"), d.alias("drugId2"))),
        )
    )
    # Never empty; as an outer generator it infers no filter that would make the lists twice.
    return mechanisms.select(F.inline_outer(pairs), R.ACTION, "mechanismOfAction").distinct()


def matching_pairs(mechanisms: DataFrame) -> DataFrame:
    """The rows of :func:`mechanism_pairs` that a join on drug and target can match.

    A mechanism without a drug or a target leaves before its lists are made,
    and before the mechanisms are made distinct where that is above a grouping.
    """
    by_target = mechanisms.select(F.explode("targets").alias("targetId2"), "chemblIds", R.ACTION, "mechanismOfAction")
    pairs = by_target.select("targetId2", F.explode("chemblIds").alias("drugId2"), R.ACTION, "mechanismOfAction")
    return pairs.where(F.col("targetId2").isNotNull() & F.col("drugId2").isNotNull()).distinct()


def _clean_consequences() -> Column:
    # Distinct consequence ids of a row, NULL entries removed.
    return F.array_except(F.col(R.CONSEQUENCES), F.array(F.lit(None).cast(T.StringType())))


def consequence_count(
    evidence: DataFrame, source: str = "intogen", keys: Sequence[str] = (R.TARGET, R.DISEASE)
) -> DataFrame:
    """``targetId, diseaseId`` (or other ``keys`` of the pair), ``own, every``: consequence ids summed over the
    distinct (null-stripped, per-row deduplicated) id arrays of the pair, of
    the rows of ``source`` and of all rows.

    Arrays [A] and [A, B] give 3, [A, B] and [B, A] give 4; pairs without
    arrays are absent (their count is 0).  Two grouped sums with map-side
    combination: a pair that holds a large share of the rows never meets whole
    in one task.
    """
    arrays = (
        evidence.select(*keys, _clean_consequences().alias("ids"), F.col(R.SOURCE).eqNullSafe(source).alias("mine"))
        .where(F.col("ids").isNotNull())
        .groupBy(*keys, "ids")
        .agg(F.bool_or("mine").alias("mine"))
    )
    n = F.size("ids")
    return arrays.groupBy(*keys).agg(
        F.sum(F.when(F.col("mine"), n).otherwise(0)).cast("int").alias("own"), F.sum(n).cast("int").alias("every")
    )
