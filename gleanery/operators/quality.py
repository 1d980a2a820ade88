"""Evaluation and the question "does the corpus support this?"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranged, running_sum


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc, n_pos, n_neg`` with ties worth a half, by ranks of distinct scores (no pairs)."""
    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("m")
    )
    counts = counts.where("p + m > 0")  # distinct scores only
    part = running_sum(ranged(counts, [], ["s"]), [], ["s"], F.col("m"), "upto")
    sums = part.agg(F.sum(F.col("p") * (F.col("upto") - F.col("m") * 0.5)).alias("u"), F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"))
    return sums.select((F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def floor_quantile(df: DataFrame, group: str, value: str, q: float, out: str) -> DataFrame:
    """The element at ``min(n - 1, floor(q n))`` of each group, no interpolation; equal values are counted, not ranked."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = running_sum(ranged(counts, [group], [value]), [group], [value], F.col("c"), "upto")
    n = counts.groupBy(group).agg(F.sum("c").alias("n"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
    return upto.join(n, group).where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(group, F.col(value).alias(out))


def signals(hits: DataFrame) -> DataFrame:
    """``query_id, d0, margin, mean10``: nearest distance, its lead over rank 5, mean distance."""
    fifth = F.coalesce(F.max(F.when(F.col("rank") == 5, F.col("distance"))), F.max("distance"))
    first = F.min(F.when(F.col("rank") == 1, F.col("distance")))
    return hits.groupBy("query_id").agg(first.alias("d0"), (fifth - first).alias("margin"), F.avg("distance").alias("mean10"))


def verdict(z: Column, hard: float, weak: float) -> tuple[Column, Column]:
    """(probability, verdict) of a logistic score."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return p, F.when(p < hard, "abstain").when(p < weak, "weak").otherwise("answer")
