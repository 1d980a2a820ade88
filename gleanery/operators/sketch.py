"""Coarse sketches and their rerank: candidates by pooled codes, answers by full vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._shared import small
from ..errors import GleaneryError
from ..functions import vector as V
from .knn import knn_join


def quantized(df: DataFrame, unit: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, q, scale, offset, sum_q, sum_q2`` of ``id, vector``: 8-bit rows, of vectors made unit where asked, behind columns that are kept."""
    v = V.as_double(F.col("vector"))
    v = df.select("id", *keep, (V.l2_normalize(v) if unit else v).alias("v"))
    coded = v.select("id", *keep, V.quantize(F.col("v")).alias("q"), V.quantization(F.col("v")).alias("s"))
    sums = [F.aggregate("q", F.lit(0).cast("long"), f).alias(n) for n, f in (("sum_q", lambda a, x: a + x), ("sum_q2", lambda a, x: a + x * x))]
    return coded.select("id", *keep, "q", "s.scale", "s.offset", *sums)


def sketches(coded: DataFrame, dims: int, width: int, bits: int = 8) -> DataFrame:
    """``id, vector``: dequantised sketch rows, comparable with pooled queries."""
    if bits not in (4, 8):
        raise GleaneryError("INVALID_ARGUMENT", "sketch bits must be 4 or 8", value=bits)
    pool = V.pooled(F.col("q"), dims, width)
    pool = pool if bits == 8 else V.from_nibbles(V.nibbles(pool))
    return coded.select("id", pool.alias("p"), "scale", "offset").select("id", V.dequantize(F.col("p"), F.col("scale"), F.col("offset")).alias("vector"))


def candidate_depth(count: int, k: int, rerank: int = 0, recommended: int = 0) -> int:
    return min(count, max(k, rerank or recommended or max(100, 10 * k)))


def candidates(queries: DataFrame, sketch: DataFrame, dims: int, width: int, depth: int, metric: str = "l2") -> DataFrame:
    """``query_id, rank, id, distance`` of the ``depth`` nearest sketches.

    For cosine, vectors were made unit before they were coded, and every pooled
    component stands for ``width`` of them.
    """
    v = V.as_double(F.col("vector"))
    if metric == "cosine":
        pooled = V.pooled_query(V.l2_normalize(v), dims, width)
        return knn_join(queries.select("query_id", F.transform(pooled, lambda x: x * width).alias("vector")), sketch, depth, "inner")
    return knn_join(queries.select("query_id", V.pooled_query(v, dims, width).alias("vector")), sketch, depth, metric)


def with_extras(found: DataFrame, extras: DataFrame) -> DataFrame:
    """Candidate pairs of a scan and of elsewhere, each once."""
    return found.select("query_id", "id").union(extras.select("query_id", "id")).distinct()


def recommended_depth(ladder: DataFrame, count: int, goal: float = 0.98) -> DataFrame:
    """One row ``depth``: the least of ``depth, recall`` that reaches the goal, else all rows."""
    return ladder.agg(F.coalesce(F.min(F.when(F.col("recall") >= goal, F.col("depth"))), F.lit(count)).alias("depth"))


def rerank(queries: DataFrame, corpus: DataFrame, found: DataFrame, k: int | None, metric: str = "l2") -> DataFrame:
    """Exact distances of candidate pairs, and the k best; with ``None`` every candidate comes back, ranked."""
    q, x = queries.select("query_id", V.as_double(F.col("vector")).alias("qv")), corpus.select("id", V.as_double(F.col("vector")).alias("v"))
    distance = V.l2_distance if metric == "l2" else V.cosine_distance
    pairs = x.join(small(found.select("query_id", "id").distinct(), "pairs"), "id").join(q, "query_id")
    scored = pairs.select("query_id", "id", F.round(distance(F.col("qv"), F.col("v")), 9).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "id", "distance")


def recall_by_depth(found: DataFrame, truth: DataFrame, depths: list[int]) -> DataFrame:
    """``depth, recall``: one pass for a whole ladder of candidate depths."""
    n = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    at = truth.select("query_id", "id").join(found.select("query_id", "id", F.col("rank").alias("at")), ["query_id", "id"], "left")
    ladder = at.select("query_id", "at", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    hits = ladder.groupBy("query_id", "depth").agg(F.count(F.when(F.col("at") <= F.col("depth"), 1)).alias("hits")).join(n, "query_id")
    return hits.groupBy("depth").agg(F.avg(F.col("hits") / F.col("n")).alias("recall"))
