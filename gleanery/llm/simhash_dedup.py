"""SimHash near-duplicate groups, with pivot distance tables.

Every distinct fingerprint gets, once, a row of Hamming distances to many fixed
reference fingerprints (the pivots).  By the triangle inequality a pair whose rows
differ anywhere by more than the limit can't be near, so it is discarded by the
maximum coordinate difference, and only survivors are verified bit by bit.  Pairs
are looked for among fingerprints that agree on enough blocks of bits (a cell),
which makes the search grow with the rows rather than with their square.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, shared_table, text_or_empty

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Pivots, i.e. columns of the distance table.
PIVOTS = 32
#: Members of a cell that one task compares; larger cells are split into pairs of chunks.
CELL_ROWS = 2_048
#: Blocks of a 64-bit fingerprint for exact search: with at most 4 differing bits
#: 2 of 6 blocks are always free of differences.
BLOCKS = 6


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Unsigned XXH64 of every word shingle of a text, repeats included."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as a signed long."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_280):  # bytes of 8 lanes are added as one long, 255 rows without carry
        part = hashes[at : at + 65_280]
        lanes = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, w0``: fingerprints; a text without words has zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(h) if len(h := shingle_hashes(text, shingle)) else 0 for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "w0"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, w0 long")


def exact_masks(max_bits: int) -> list[int]:
    """Masks such that fingerprints within ``max_bits`` agree under at least one of them."""
    blocks = max(BLOCKS, max_bits + 1)
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cut)]
    return [sum(block[i] for i in free) for free in itertools.combinations(range(blocks), blocks - max_bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivot_table(w: np.ndarray) -> np.ndarray:
    """Rows of distances to the pivots, one byte each."""
    pivots = np.random.default_rng(SEED).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([np.bitwise_count(w ^ p) for p in pivots], axis=1)


def with_pivots(nodes: DataFrame) -> DataFrame:
    """``node, pivots`` of distinct fingerprints ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in table], pa.binary())], ["node", "pivots"])

    return map_batches(nodes.select("node"), run, "node long, pivots binary")


def near_rows(w: np.ndarray, table: np.ndarray, sizes: np.ndarray, max_bits: int) -> np.ndarray:
    """Index pairs within ``max_bits``, of rows of the same cell.

    ``w`` and their pivot table: cells one after another, of ``sizes`` rows each.
    """
    table = table.astype(np.int16)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w)) - 1  # rows after this one in its cell
    first, step, out = np.flatnonzero(left >= 1), 1, [np.empty((0, 2), np.int64)]
    while len(first):
        second = first + step
        near = np.arange(len(first))
        for columns in (slice(0, 4), slice(4, PIVOTS)):  # discard by the largest coordinate difference
            far = np.abs(table[first[near], columns] - table[second[near], columns]).max(axis=1) > max_bits
            near = near[~far]
        a, b = first[near], second[near]
        same = np.bitwise_count(w[a] ^ w[b]) <= max_bits
        out.append(np.stack([a[same], b[same]], axis=1))
        step += 1
        first = first[left[first] >= step]
    return np.concatenate(out)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: (node, smallest node of its tree)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def near_edges(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs, larger node first, that connect all that they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((max(a, b), min(a, b)))
    return out


def links(nodes: DataFrame, max_bits: int, trees: Callable[[np.ndarray], list[tuple[int, int]]] = forest) -> DataFrame:
    """``u, v`` (u > v): trees that connect what the near pairs of fingerprints ``node`` connect."""
    cells = F.array(*(F.xxhash64(F.lit(t), F.col("node").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(exact_masks(max_bits))))
    rows = shared_table(with_pivots(nodes), "pivots").select("node", "pivots", F.explode(cells).alias("cell"))
    sizes = rows.groupBy("cell").count().where("count > 1")
    rows = rows.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("count") / CELL_ROWS))
    member = F.struct("node", "pivots")
    small = rows.where("chunks = 1").groupBy("cell").agg(F.collect_list(member).alias("members"))
    # a large cell: chunks by hash, every pair of chunks a group of its own, spread over all tasks
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    spread = rows.where("chunks > 1").withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    large = (
        spread.select("cell", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node", "pivots")
        .groupBy("cell", "a", "b")
        .agg(F.collect_list(member).alias("members"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            ids = flat.field("node").to_numpy(zero_copy_only=False)
            table = np.frombuffer(b"".join(flat.field("pivots").to_pylist()), np.uint8).reshape(-1, PIVOTS)
            found = trees(ids[near_rows(ids.view(np.uint64), table, np.diff(members.offsets.to_numpy()), max_bits)])
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return map_batches(small.select("members").union(large.select("members")), run, "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of every linked node's component, other than itself.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each round
    is written to the shared folder.  Minima are aggregates, so a hub is never
    collected in one place.
    """

    def round_(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.union(down.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())

    edges = shared_table(edges, "edges")
    now, before = state(edges), None
    while now != before:
        edges, before = shared_table(round_(edges), "edges"), now
        now = state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(df: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, w0, component_id`` for every row.

    Fingerprints link at ``max_bits`` or fewer differing bits, every such pair;
    ``component_id`` is the smallest id that links reach.

    Null and empty texts have the zero fingerprint and link like any other; a text
    of any length is read whole.  Nodes are fingerprints, not ids: equal ones are
    one node, and an id on several rows with different texts links by each of them
    alone.  A null id takes no part and has a null component.  An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    prints = shared_table(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes = shared_table(prints.where("doc_id is not null").groupBy(F.col("w0").alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(links(nodes, max_bits))
    rooted = shared_table(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = rooted.join(least, "root").select(F.col("node").alias("w0"), "component")
    out = prints.join(of_print, "w0", "left")
    return out.select("doc_id", "w0", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
