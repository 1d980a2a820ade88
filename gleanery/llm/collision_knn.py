"""Approximate maximum-inner-product search by collision counting.

Every block of vectors is indexed by sorted arrays of single random projections
(C2LSH, Gan et al. 2012; QALSH, Huang et al. 2015).  A query's window on each
array is centred on the query's own projection and widened step by step
(virtual rehashing); a vector that falls into enough windows is verified with
its exact inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from .common import row_count

#: Projections, i.e. sorted arrays of a block.  They come in orthonormal bases: what one says
#: about a vector none of its basis repeats, which takes far fewer verifications than
#: independent directions do.
PROJECTIONS = 64
#: First half-width of a window, in standard deviations of the projections, and the
#: factor of each widening.
HALF_WIDTH, WIDEN = 1.5, 1.1
#: A vector is verified once it collides in so large a share of the windows.
THRESHOLD = 0.76
#: Windows widen until this share of the block, and so many times k vectors, are verified.
VERIFIED, VERIFIED_TIMES = 0.1, 20
#: Rows of one block of vectors and of one block of queries; and rows of a block at least, while
#: there are fewer blocks than cores.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS = 16_384, 32_768, 2_048
SEED = 20_240_229


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part.

    A null id, a null or empty vector, null or non-finite components, and the
    zero vector keep a row out.
    """
    v = F.col("v")
    inf = float("inf")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & (F.size(v) > 0))
        .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)))
        .where(F.exists(v, lambda x: x != 0))
    )


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), -1)


def bases(dim: int, projections: int, seed: int) -> np.ndarray:
    """``projections`` columns: random orthonormal bases, the last perhaps in part."""
    rng = np.random.default_rng(seed)
    turned = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.concatenate(turned, axis=1)[:, :projections]


class CollisionIndex:
    """Sorted single-projection arrays over one block of vectors.

    Vectors are completed to one common norm, so that nearest by distance and
    largest by inner product are the same order.
    """

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.x, (self.n, dim) = x, x.shape
        scaled = x / np.abs(x).max()  # squares of large components must not overflow
        norms = np.einsum("ij,ij->i", scaled, scaled)
        self.top = float(norms.max())
        self.axes = bases(dim + 1, projections, seed)
        rest = np.sqrt(np.maximum(self.top - norms, 0))
        at = scaled @ self.axes[:dim] + np.outer(rest, self.axes[dim])
        self.unit = float(at.std()) or 1.0
        self.order = np.argsort(at, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(at.T, self.order, 1)
        # a vector's position in each sorted array: it is in a window if that lies between the window's ends
        self.place = np.empty(self.order.shape, np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=self.place.dtype)[None, :], 1)

    def _ends(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows (queries x projections) as ranges of the sorted arrays."""
        low = np.stack([v.searchsorted(c - half) for v, c in zip(self.values, centres.T)], axis=1)
        return low, np.stack([v.searchsorted(c + half, "right") for v, c in zip(self.values, centres.T)], axis=1)

    def candidates(self, queries: np.ndarray, least: int, half_width: float, widen: float, threshold: float, ids: np.ndarray | None = None, least_ids: int = 0):
        """For each query, the rows that collide often enough.

        At least ``least`` rows, and with ``ids``, where some repeat, rows of ``least_ids`` ids.
        """
        queries = queries / np.maximum(np.abs(queries).max(axis=1, keepdims=True), 1e-300)
        scale = np.sqrt(self.top) / np.maximum(np.sqrt(np.einsum("ij,ij->i", queries, queries)), 1e-300)
        centres = (queries * scale[:, None]) @ self.axes[:-1]  # scaling a query leaves its order alone
        m, need, kind = len(self.values), int(np.ceil(threshold * len(self.values))), self.place.dtype
        lows, highs = self._ends(centres, half_width * self.unit)
        for centre, low, high in zip(centres, lows, highs):
            half = half_width * self.unit
            # unsigned: positions before a window wrap round and are too large as well
            inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
            counts = inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if m < 256 else np.uint16)
            while True:
                found = np.flatnonzero(counts >= need)
                enough = len(found) >= least and (ids is None or len(np.unique(ids[found])) >= least_ids)
                if enough or int((high - low).sum()) == m * self.n:
                    yield found
                    break
                half *= widen
                wider_low, wider_high = (e[0] for e in self._ends(centre[None, :], half))
                # rehashing is virtual: only what the windows newly cover is counted
                new = [o[a:b] for o, a, b in zip(self.order, wider_low, low)] + [o[a:b] for o, a, b in zip(self.order, high, wider_high)]
                counts = counts + np.bincount(np.concatenate(new), minlength=self.n).astype(counts.dtype)
                low, high = wider_low, wider_high


def collision_knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    projections: int = PROJECTIONS,
    half_width: float = HALF_WIDTH,
    widen: float = WIDEN,
    threshold: float = THRESHOLD,
    verified: float = VERIFIED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found.

    Nearness is the largest inner product in double precision; ties go to the
    smaller id and a query's own id never answers it.  With at most k candidates
    all of them come back.  Rows outside ``usable`` take no part; an id that
    occurs on several rows counts as one vector with its best score; vectors of
    another dimension than the query's are not compared with it; a score that
    overflows ranks as it compares, one that is no number comes last; empty tables
    give no rows; other columns are not read.

    Blocks of queries meet blocks of vectors, each pair in a task of its own: a
    task holds one block of either side whatever the size of the tables, and no
    key can be hot because blocks come from a hash of the id.  A pair's index is
    made in its task, a few per cent of the time of a full block of queries.
    """
    ship(vectors.sparkSession)
    x, q = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id")
    rows, cores = row_count(vectors), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // BLOCK_ROWS), min(cores, rows // LEAST_ROWS))
    query_blocks = max(1, -(-row_count(queries) // QUERY_ROWS))

    def pairs(df: DataFrame, own: str, n_own: int, other: str, n_other: int, key: str) -> DataFrame:
        return df.select(
            "*",
            F.size("v").alias("dim"),
            F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        ).groupBy("b", "qb", "dim")

    def search(queries_of: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries_of.num_rows and block.num_rows:
            ids, query_ids = block.column("vec_id").to_numpy(), queries_of.column("query_id").to_numpy()
            index, qs = CollisionIndex(_matrix(block), projections), _matrix(queries_of)
            repeated = len(np.unique(ids)) < len(ids)
            least = min(index.n, max(VERIFIED_TIMES * (k + 1), int(np.ceil(verified * index.n))))
            for query_id, query, found in zip(query_ids, qs, index.candidates(qs, least, half_width, widen, threshold, ids if repeated else None, k + 1)):
                found = found[ids[found] != query_id]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,j->i", index.x[found], query)
                score = np.where(np.isnan(score), -np.inf, score)
                near = ids[found]
                if repeated:  # the best row of each id, so that the cut counts ids
                    order = np.lexsort((-score, near))
                    near, first = np.unique(near[order], return_index=True)
                    score = score[order][first]
                if len(near) > k:  # all that tie with the k-th stay, for the tie-break below
                    keep = score >= np.partition(score, -k)[-k]
                    near, score = near[keep], score[keep]
                best = np.lexsort((near, -score))[:k]
                out.append((np.full(len(best), query_id), near[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    near = (
        pairs(q, "qb", query_blocks, "b", blocks, "query_id")
        .cogroup(pairs(x, "b", blocks, "qb", query_blocks, "vec_id"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
