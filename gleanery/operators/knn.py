"""Exact nearest neighbours of a query set, in blocks.

Queries that fit a checked number and size travel to the corpus; beyond it, blocks
of queries meet blocks of the corpus, a task for each pair.  Either way a task
sends the best k of each query only, and a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import GleaneryError, check_metric, check_one_of, check_range
from ..functions import vector as V

#: Queries, and bytes of them, that are sent to every task, at most; and rows of a block beyond.
SENT_QUERIES, SENT_BYTES, BLOCK_ROWS, QUERY_ROWS = 4_096, 32 << 20, 65_536, 4_096
#: Cells of a matrix of distances that is made at once, and rows that it has at most.
CELLS, BATCH_ROWS = 1 << 19, 8_192
#: Decimals by which distances are ranked, so that engines agree on ties.
DIGITS = 9
HITS = "query_id long, id long, distance double"


def split_vectors(df: DataFrame, vector_col: str, dim: int | None = None, cosine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with a ``reason``)."""
    marked = df.withColumn("reason", V.reject_reason(F.col(vector_col), dim, cosine))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _unrounded(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances in one matrix and at most one more; for cosine of vectors that are unit already."""
    d = q @ x.T
    if metric != "l2":
        np.clip(d, -1, 1, out=d)
        return np.subtract(1, d, out=d)
    d *= 2
    d = np.subtract((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :], d, out=d)
    i, j = np.nonzero(d < 1e-6)  # differences cancel there
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    step = max(1, CELLS // (4 * max(1, q.shape[1])))
    for at in range(0, len(i), step):
        own, other = i[at : at + step], j[at : at + step]
        d[own, other] = np.sqrt(((q[own] - x[other]) ** 2).sum(1))
    return d


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    return np.round(_unrounded(*((_unit(q), _unit(x)) if metric == "cosine" else (q, x)), metric), DIGITS)


class Nearest:
    """The k nearest rows of each query so far, ties to the smaller id.

    A matrix of at most ``CELLS`` distances is held at once, and what is near enough
    by it is cut to the best k of each query as often as it grows by so many.
    """

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, metric: str, self_hits: bool = True):
        self.query_ids, self.q, self.k, self.metric, self.self_hits = query_ids, _unit(q) if metric == "cosine" else q, k, metric, self_hits
        self.held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # place of the query, id, distance
        self.edge = np.full(len(query_ids), np.inf)  # the distance of the last of k

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), BATCH_ROWS):
            self._add(ids[at : at + BATCH_ROWS], x[at : at + BATCH_ROWS])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.query_ids):
            return
        x = _unit(x) if self.metric == "cosine" else x
        new, grown, slack = [self.held], 0, 10.0**-DIGITS  # rounding moves a distance by half of it
        step = max(1, CELLS // len(ids))
        for at in range(0, len(self.q), step):
            d = _unrounded(self.q[at : at + step], x, self.metric)
            if not self.self_hits:
                d[self.query_ids[at : at + step, None] == ids[None, :]] = np.inf
            edge = self.edge[at : at + step, None]
            if np.isinf(edge).any() and d.shape[1] > self.k:
                edge = np.minimum(edge, np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            i, j = np.nonzero(d <= edge + slack)
            near = np.round(d[i, j], DIGITS)
            usable = np.isfinite(near)
            new.append([i[usable] + at, ids[j[usable]], near[usable]])
            grown += len(i)
            if grown > CELLS // 4:
                self.held = self._cut([np.concatenate(c) for c in zip(*new)])
                new, grown = [self.held], 0
        self.held = self._cut([np.concatenate(c) for c in zip(*new)])
        place, _, distance = self.held
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True)) if len(place) else np.empty(0, int)
        full = last[np.bincount(place, minlength=len(self.edge))[place[last]] == self.k]
        self.edge[place[full]] = distance[full]

    def _cut(self, held: list[np.ndarray]) -> list[np.ndarray]:
        place, ids, distance = held
        order = np.lexsort((ids, distance, place))
        place = place[order]
        first = np.searchsorted(place, place)
        kept = order[np.arange(len(order)) - first < self.k]
        return [c[kept] for c in held]

    def table(self) -> dict:
        place, ids, distance = self.held
        return {"query_id": self.query_ids[place], "id": ids, "distance": distance}


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", self_hits: bool = True, impl: str = "auto") -> DataFrame:
    """``query_id, rank, id, distance`` of each query's k nearest, ties to the smaller id.

    ``queries``: ``query_id, vector``; ``corpus``: ``id, vector``; both validated and
    of one dimension.  L2 distances are square-rooted.  With k = 0 there are no
    rows; with k beyond the corpus all of it comes back.  ``impl`` (auto, sent or
    blocks) chooses the plan and never the result; queries too large to be sent are
    searched in blocks whatever it says.
    """
    check_one_of("impl", impl, ("auto", "sent", "blocks"))
    check_range("k", k, 0, 1 << 20)
    check_metric(metric, "inner")  # inner: one minus the clamped product, nothing is made unit
    spark = corpus.sparkSession
    ship(spark)
    q, x = queries.select("query_id", V.as_double(F.col("vector")).alias("v")), corpus.select("id", V.as_double(F.col("vector")).alias("v"))
    head = q.limit(SENT_QUERIES + 1).toArrow()
    if impl != "blocks" and head.num_rows <= SENT_QUERIES and head.nbytes <= SENT_BYTES:
        query_ids, matrix = head.column("query_id").to_numpy(), _matrix(head.column("v"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(query_ids, matrix, max(1, k), metric, self_hits)
            for batch in batches:
                near.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
            yield pa.RecordBatch.from_pydict(near.table())

        near = x.mapInArrow(scan, HITS)
    else:
        near = blocks_join(q, x, max(1, k), metric, self_hits)
    return top_k(near, k)


def blocks_join(q: DataFrame, x: DataFrame, k: int, metric: str, self_hits: bool = True) -> DataFrame:
    """Hits of every block of ``query_id, v`` with every block of ``id, v``."""
    blocks, query_blocks = max(1, -(-x.count() // BLOCK_ROWS)), max(1, -(-q.count() // QUERY_ROWS))

    def spread(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        return df.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("b", "qb")

    return spread(q, "query_id", "qb", query_blocks, "b", blocks).cogroup(spread(x, "id", "b", blocks, "qb", query_blocks)).applyInArrow(pair_search(k, metric, self_hits), HITS)


def pair_search(k: int, metric: str, self_hits: bool = True):
    """The function of one group of queries and one of rows."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        near = Nearest(left.column("query_id").to_numpy(), _matrix(left.column("v")), k, metric, self_hits)
        near.add(right.column("id").to_numpy(), _matrix(right.column("v")))
        return pa.table(near.table())

    return pair


def top_k(hits: DataFrame, k: int, descending: bool = False, by: str = "distance") -> DataFrame:
    """The first k of each query by ``by`` and id, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by) if descending else F.asc(by), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", by)


def allowed(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Only allow-listed rows: filtered before any distance is computed."""
    return corpus.join(ids.select("id").distinct(), "id", "left_semi")


def live(corpus: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Only rows that aren't deleted."""
    return corpus.join(tombstones.select("id").distinct(), "id", "left_anti")


def from_source(corpus: DataFrame, source: str, column: str = "source") -> DataFrame:
    """Only rows of one source; the filter reaches the scan."""
    return corpus.where(F.col(column) == source)


def unusable_batch(df: DataFrame, vector_col: str, dim: int | None = None, cosine: bool = True) -> None:
    """Raise if any row of a batch is unusable, before anything of it is used."""
    bad = split_vectors(df, vector_col, dim, cosine)[1].select("reason").limit(1).collect()
    if bad:
        raise GleaneryError("INVALID_VECTOR", "the batch holds an unusable vector", reason=bad[0]["reason"])


def self_recall_verdict(ranks: DataFrame) -> DataFrame:
    """One row ``verdict``: exact (all first), degraded (all among the first five) or error."""
    worst = F.max(F.coalesce("self_rank", F.lit(6)))
    return ranks.agg(F.when(worst == 1, "exact").when(worst <= 5, "degraded").otherwise("error").alias("verdict"), F.count("*").alias("samples"))


def diverse(queries: DataFrame, hits: DataFrame, corpus: DataFrame, m: int, metric: str = "cosine") -> DataFrame:
    """``query_id, rank, id, distance``: m of each query's candidates, spread out.

    Nearest first, a candidate is taken if it is nearer to the query than to every
    one taken before; places left are filled with the nearest of the rest.  A
    query's candidates are few (the k of a search), so they meet in one task.
    """
    check_range("m", m, 1, 1 << 12)
    check_metric(metric)
    ship(corpus.sparkSession)
    held = hits.select("query_id", "id", "distance").join(corpus.select("id", V.as_double(F.col("vector")).alias("v")), "id")

    def pick(group: pa.Table) -> pa.Table:
        ids, d, x = group.column("id").to_numpy(), group.column("distance").to_numpy(), _matrix(group.column("v"))
        order = np.lexsort((ids, d))
        between = distances(x, x, metric)
        taken: list[int] = []
        for i in order:
            if len(taken) < m and all(d[i] < between[i, j] for j in taken):
                taken.append(i)
        taken += [i for i in order if i not in taken][: m - len(taken)]
        taken.sort(key=lambda i: (d[i], ids[i]))
        return pa.table({"query_id": [group.column("query_id")[0].as_py()] * len(taken), "rank": pa.array(range(1, len(taken) + 1), pa.int32()), "id": ids[taken], "distance": d[taken]})

    return held.groupBy("query_id").applyInArrow(pick, "query_id long, rank int, id long, distance double")


def self_recall(corpus: DataFrame, sample: DataFrame, metric: str = "cosine") -> DataFrame:
    """``query_id, self_rank``: where each sampled row finds itself among its 5 nearest."""
    hits = knn_join(sample.select(F.col("id").alias("query_id"), "vector"), corpus, 5, metric)
    return hits.groupBy("query_id").agg(F.min(F.when(F.col("id") == F.col("query_id"), F.col("rank"))).alias("self_rank"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of the true neighbours that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    joined = truth.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
