"""Left joins whose hot keys meet in many tasks, whatever the size of the side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """The keys (named ``_h0``, ``_h1``, ...) that hold more than one of ``parts``
    parts of all rows; fewer than ``parts`` of them can.

    One pass over the keys, counted before the shuffle.
    """
    counts = rows.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    known = [F.col(f"_h{i}").isNotNull() for i in range(len(keys))]
    hot = counts.where(F.col("_n") * parts > total)
    for k in known:  # NULL keys match nothing
        hot = hot.where(k)
    return hot.drop("_n")


def split_left_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], parts: int) -> DataFrame:
    """``left`` left-joined with ``right`` on pairs of columns (left, right).

    Rows of a hot key (see :func:`hot_keys`) are dealt over ``parts`` places by
    their own values and the task that holds them, and the right rows of these
    keys are repeated at each place.  So no task gets more than about one part
    of the rows, without statistics, adaptive plans or a side small enough to
    broadcast.  The list of hot keys is broadcast: it has fewer than ``parts``
    rows.  Rows that match nothing stay, as in any left join.
    """
    hot = F.broadcast(hot_keys(left, [a for a, _ in on], parts))
    marked = hot.withColumn("_hot", F.lit(True))

    def with_flag(rows, columns):
        same = [F.col(c) == F.col(f"_h{i}") for i, c in enumerate(columns)]
        joined = rows.join(marked, same, "left")
        return joined.drop(*[f"_h{i}" for i in range(len(columns))])

    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(a) for a in left.columns]), F.lit(parts)).cast("int")
    dealt = left.withColumn("_spread", spread)
    dealt = with_flag(dealt, [a for a, _ in on])
    dealt = dealt.withColumn("_place", F.when(F.col("_hot"), F.col("_spread")).otherwise(0)).drop("_hot", "_spread")
    everywhere = F.array(*[F.lit(i) for i in range(parts)])
    places = F.when(F.col("_hot"), everywhere).otherwise(F.array(F.lit(0)))
    repeated = with_flag(right, [b for _, b in on]).select(*right.columns, F.explode(places).alias("_at"))
    same = [F.col(a) == F.col(b) for a, b in on] + [F.col("_place") == F.col("_at")]
    return dealt.join(repeated, same, "left").drop("_place", "_at")
