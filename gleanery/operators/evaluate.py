"""Evaluation of retrieval: expectations, success and reciprocal rank, overlap, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meets(record: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Whether a record has what is expected: the anchor exactly, parts of title, path and url in any case.

    What is null isn't expected.
    """
    found = F.lit(True)
    for name, want in expected.items():
        have = F.coalesce(record[name], F.lit(""))
        same = have == want if name == "anchor" else F.contains(F.lower(have), F.lower(want))
        found = found & (want.isNull() | same)
    return found


def first_match(queries: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """``queries`` with ``found`` (the first rank, from 1, of a result that is a ``match``) and ``n_results``.

    ``results``: ``by..., rank, match``.
    """
    per = results.groupBy(*by).agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("found"), F.count("*").alias("n_results"))
    return queries.join(per, by, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def report(matched: DataFrame, by: list[str]) -> DataFrame:
    """``by..., success_1, success_3, mrr, abstained, n`` of ``first_match``."""
    hit = lambda at: F.avg(F.when(F.col("found") <= at, 1.0).otherwise(0.0))
    return matched.groupBy(*by).agg(
        hit(1).alias("success_1"),
        hit(3).alias("success_3"),
        F.avg(F.coalesce(1 / F.col("found"), F.lit(0.0))).alias("mrr"),
        F.count_if(F.col("n_results") == 0).alias("abstained"),
        F.count("*").alias("n"),
    )


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``query_id, overlap``: the share of k neighbours on which two rankings agree."""
    top = lambda hits: hits.where(F.col("rank") <= k).select("query_id", "id").distinct()
    both = top(a).join(top(b).withColumn("both", F.lit(1)), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg((F.count("both") / k).alias("overlap"))


def latencies(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by..., p50, p99, n``; estimates within 1/10,000 of the rank."""
    return df.groupBy(*by).agg(F.percentile_approx(value, 0.5).alias("p50"), F.percentile_approx(value, 0.99).alias("p99"), F.count("*").alias("n"))


def distinct_titles(df: DataFrame, title: str = "title") -> DataFrame:
    cleaned = F.btrim(F.coalesce(F.col(title), F.lit("")))
    return df.agg(F.countDistinct(F.when(cleaned != "", cleaned)).alias("titles"))


def even_sample(numbered: DataFrame, most: int, count: int, at: str = "id") -> DataFrame:
    """At most ``most`` of ``count`` rows, numbered densely from 0 in ``at``, at even strides."""
    if count <= most:
        return numbered
    nth = F.floor((F.col(at) * most + F.lit(count - 1)) / F.lit(count))  # the only stride that can end at this row
    return numbered.where((F.floor(nth * F.lit(count) / F.lit(most)) == F.col(at)) & (nth < most))


def idf_buckets(postings: DataFrame, documents: int) -> DataFrame:
    """``term, df, bucket``: inverse document frequency in steps of a byte."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + F.lit(float(documents)) / F.col("df"))
    return df.crossJoin(F.broadcast(df.agg(F.min("df").alias("least")))).select(  # a single row
        "term", "df", F.floor(idf / F.log(F.lit(1.0) + F.lit(float(documents)) / F.col("least")) * 255 + 0.5).cast("int").alias("bucket")
    )


def vocabulary(tokens: DataFrame, least: int) -> DataFrame:
    """``term, n`` of ``term`` rows seen at least so often."""
    return tokens.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ranked_within(df: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
