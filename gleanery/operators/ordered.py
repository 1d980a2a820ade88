"""Running sums and neighbours in an order, without a task for each group.

Rows are cut into ranges of (group, order), so that a group of any size spreads
over many tasks; what the ranges before add is one row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._shared import shared_table

PART = "__part"


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of its range; equal keys share a range.  Written, so that the ranges stay."""
    return shared_table(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(*by, PART).orderBy(*order)


def _earlier(by: list[str], last: int = -1):
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # without groups: a row a range
    return window.orderBy(PART).rowsBetween(Window.unboundedPreceding, last)


def _met(df: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    same = per[PART] == df[PART]
    for c in by:
        same = same & df[c].eqNullSafe(per[c])
    return df.join(per, same, "left").drop(*(per[c] for c in [*by, PART]))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``ranged`` rows with ``name``: the sum of ``value`` up to the row, itself included, in a total order."""
    df = df.withColumn("__value", value)
    per = df.groupBy(*by, PART).agg(F.sum("__value").alias("__sum"))
    per = per.withColumn("__before", F.coalesce(F.sum("__sum").over(_earlier(by)), F.lit(0))).drop("__sum")
    own = F.sum("__value").over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return _met(df.withColumn("__own", own), per, by).withColumn(name, F.col("__before") + F.col("__own")).drop("__value", "__own", "__before")


def previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranged`` rows with ``name``: ``value`` of the row before, in a total order; null for the first."""
    per = df.groupBy(*by, PART).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    per = per.withColumn("__before", F.last("__last").over(_earlier(by))).drop("__last")
    w = _within(by, order)
    marked = df.withColumn("__lag", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return _met(marked, per, by).withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).drop("__lag", "__first", "__before")


def runs(df: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """``by..., first_id, last_id, ids``: runs of numbers that lie at most ``gap`` apart."""
    rows = previous(ranged(df.select(*by, at), by, [at]), by, [at], at, "__prev")
    new = F.when(F.col(at) - F.col("__prev") <= gap, 0).otherwise(1)
    numbered = running_sum(rows, by, [at], new, "__run")
    return numbered.groupBy(*by, "__run").agg(F.min(at).alias("first_id"), F.max(at).alias("last_id"), F.count("*").alias("ids")).drop("__run")
