"""Approximate neighbours by inverted lists, and the cluster layout of a table.

Rows belong to the list of their nearest centroid; a query looks into the lists
of its nearest centroids only.  Lists are table columns, so a search is an
equi-join on the list, and large lists are split into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._shared import shared_table
from .._ship import ship
from ..errors import check_metric, check_range
from ..functions import vector as V
from .knn import BLOCK_ROWS, HITS, _matrix, pair_search, top_k

#: Lists, at most: their centroids are all that the driver and every task hold.
MAX_LISTS = 1_024


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _closeness(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer."""
    return _unit(x) @ centroids.T if metric == "cosine" else 2 * x @ centroids.T - (centroids * centroids).sum(1)


def train(corpus: DataFrame, lists: int, metric: str = "cosine", rounds: int = 12, tolerance: float = 1e-4) -> np.ndarray:
    """k-means centroids of ``id, vector``, over all rows.

    Every task sends one sum and one count for each list and round, whatever its
    rows; the first centroids are rows chosen by a hash of their ids.
    """
    check_range("lists", lists, 1, MAX_LISTS)
    check_metric(metric)
    ship(corpus.sparkSession)
    x = corpus.select("id", V.as_double(F.col("vector")).alias("v"))
    centroids = _matrix(x.orderBy(F.xxhash64("id"), "id").limit(lists).toArrow().column("v"))
    centroids = _unit(centroids) if metric == "cosine" else centroids
    for _ in range(rounds):
        current = centroids

        def part(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(current), np.zeros(len(current), np.int64)
            for batch in batches:
                m = _matrix(batch.column(0))
                nearest = _closeness(m, current, metric).argmax(axis=1) if len(m) else np.empty(0, np.int64)
                np.add.at(sums, nearest, _unit(m) if metric == "cosine" and len(m) else m)
                counts += np.bincount(nearest, minlength=len(current))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.float64()))], ["list", "n", "s"])

        parts = x.select("v").mapInArrow(part, "list long, n long, s array<double>")
        total = parts.select("list", "n", F.posexplode("s").alias("at", "s")).groupBy("list", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = current.copy()
        for column in [total.toArrow()]:
            rows, at = column.column("list").to_numpy(), column.column("at").to_numpy()
            moved[rows, at] = column.column("s").to_numpy() / column.column("n").to_numpy()
        moved = _unit(moved) if metric == "cosine" else moved
        centroids = moved
        if np.linalg.norm(moved - current, axis=1).max(initial=0.0) < tolerance:
            break
    return centroids


def assigned(corpus: DataFrame, centroids: np.ndarray, metric: str = "cosine") -> DataFrame:
    """``id, vector, list`` of ``id, vector``."""
    ship(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            nearest = _closeness(m, centroids, metric).argmax(axis=1) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest.astype(np.int32))], ["id", "vector", "list"])

    return corpus.select("id", V.as_double(F.col("vector")).alias("vector")).mapInArrow(run, "id long, vector array<double>, list int")


def probes(queries: DataFrame, centroids: np.ndarray, most: int, metric: str = "cosine") -> DataFrame:
    """``query_id, v, list, probe``: each query's nearest lists, the first as probe 0."""
    ship(queries.sparkSession)
    most = min(most, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                near = np.argsort(-_closeness(_matrix(part.column(1)), centroids, metric), axis=1, kind="stable")[:, :most]
                again = np.repeat(np.arange(len(near)), most)
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(again)).columns, pa.array(near.reshape(-1).astype(np.int32)), pa.array(np.tile(np.arange(most, dtype=np.int32), len(near)))],
                    ["query_id", "v", "list", "probe"],
                )

    return queries.select("query_id", V.as_double(F.col("vector")).alias("v")).mapInArrow(run, "query_id long, v array<double>, list int, probe int")


def ivf_join(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, n_probe: int, metric: str = "cosine", allowed: DataFrame | None = None, widen: int = 4, self_hits: bool = True) -> DataFrame:
    """``query_id, rank, id, distance`` of the nearest rows in each query's lists.

    ``lists`` is what ``assigned`` gives.  A query whose lists hold fewer than k rows
    looks into up to ``widen`` times as many.  With ``allowed`` (``id``) only those
    rows are searched; they lie further apart, so every query looks into twice as
    many lists, and beyond while they hold fewer than 2k.
    """
    check_range("k", k, 0, 1 << 20)
    check_range("n_probe", n_probe, 1, MAX_LISTS)
    check_metric(metric)
    rows = lists if allowed is None else lists.join(allowed.select("id").distinct(), "id", "left_semi")
    sizes = shared_table(rows.groupBy("list").count(), "lists")
    near = probes(queries, centroids, n_probe * widen, metric).join(F.broadcast(sizes), "list", "left")  # a row a list
    before = F.coalesce(F.sum("count").over(Window.partitionBy("query_id").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    twice = 1 if allowed is None else 2
    near = near.withColumn("before", before).where((F.col("probe") < twice * n_probe) | (F.col("before") < twice * k)).where("count > 0")
    chunks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    q = near.select("query_id", "v", "list", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    x = rows.join(F.broadcast(sizes), "list").select("id", F.col("vector").alias("v"), "list", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    hits = q.groupBy("list", "chunk").cogroup(x.groupBy("list", "chunk")).applyInArrow(pair_search(max(1, k), metric, self_hits), HITS)
    return top_k(hits, k)


def chain_order(centroids: np.ndarray) -> np.ndarray:
    """The place of each list in a chain in which every next centroid is the most alike of those left."""
    unit = _unit(centroids)
    alike, place, last = unit @ unit.T, np.full(len(unit), -1), 0
    for at in range(len(unit)):
        place[last] = at
        row = np.where(place < 0, alike[last], -np.inf)
        last = int(row.argmax())
    return place


def laid_out(lists: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows ordered by their list's place in the chain, so that ranges of files hold neighbours."""
    place = F.element_at(F.array(*map(F.lit, chain_order(centroids).tolist())), F.col("list") + 1)
    return lists.withColumn("place", place).repartitionByRange("place", "id").sortWithinPartitions("place", "id")


def coalesced(hits: DataFrame, positions: DataFrame, gap: int) -> DataFrame:
    """``query_id, ranges, filler``: reads that fetch each query's rows if gaps of up to ``gap`` rows are read along.

    ``positions``: ``id, position``.
    """
    order = Window.partitionBy("query_id").orderBy("position")
    skipped = F.col("position") - F.lag("position").over(order) - 1
    met = hits.select("query_id", "id").distinct().join(positions, "id").withColumn("skipped", skipped)
    joined = F.col("skipped") <= gap
    return met.groupBy("query_id").agg(F.count(F.when(F.coalesce(~joined, F.lit(True)), 1)).alias("ranges"), F.coalesce(F.sum(F.when(joined, F.col("skipped"))), F.lit(0)).alias("filler"))
