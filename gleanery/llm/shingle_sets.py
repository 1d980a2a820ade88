"""Near-duplicate groups by the Jaccard similarity of word shingle sets, exactly.

SimHash proposes: sets whose fingerprints are near, by pivot distance tables, are
verified by their whole sets.  No limit on bits finds every similar pair, so what
fingerprints miss is found by prefix filtering.

Prefix filtering (Chaudhuri et al. 2006; Xiao et al. 2008): of sets in one global
order, two with a similarity of at least t share one of the first
n - ceil(t n) + 1 elements, and k of the first n - ceil(t n) + k.  So every such pair
meets in a cell, in k cells where both sets are large, and pairs that meet are
verified by their whole sets.  Any order finds every pair; one that puts common
elements last lets few others meet.  Which are common is read off a bounded sample,
which bears on the cost alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, row_count, rows_at, shared_table, text_or_empty, with_row_place
from .simhash_dedup import CELL_ROWS, MAX_BITS, connected, links, majority, near_edges, shingle_hashes

#: Bits of a set's parity map, the least power of two of so many an element and so many at least: sets differ in as
#: many elements as their maps do in bits, or more.
PARITY_EACH, PARITY_LEAST = 2, 256
#: Similar sets of n elements meet in 1 + n / MEET_EACH cells, counted up to MEET_MOST.
MEET_EACH, MEET_MOST = 128, 8
#: Documents of the sample that the order of elements comes from, on average; the share of it that makes an
#: element common; and common elements, at most.
ORDER_DOCS, COMMON_DOCS, COMMON_MOST = 20_000, 3, 400_000
#: Rows of a cell, in order of size, that pairs of each round are so near at most; the last round takes all.
ROUNDS = (1, 8, 64, None)
#: Rows of a file that one map of wanted places covers.
MAP_ROWS = 1 << 16
#: Guards products of a similarity and a size against rounding.
TINY = 1e-9


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def meetings(n: np.ndarray, similarity: float) -> np.ndarray:
    """So many cells at least does a set of n share with every similar set of as many elements or more."""
    return np.minimum(np.minimum(1 + n // MEET_EACH, MEET_MOST), np.maximum(1, (similarity * n).astype(np.int64)))


def prefix_size(n: int, similarity: float) -> int:
    """So many first elements of a set of n meet those of every similar set ``meetings`` times; of an empty set, none."""
    return min(n, n - math.ceil(similarity * n - TINY) + int(meetings(np.array(n), similarity))) if n else 0


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity_map(s: np.ndarray) -> bytes:
    bits = max(PARITY_LEAST, 1 << max(0, PARITY_EACH * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def maps_differ(a: bytes, b: bytes) -> int:
    """Bits in which two parity maps differ, the larger folded to the size of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, len(b)), axis=0).tobytes()
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def common_elements(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, levels) of elements that several documents of a sample hold; the level grows with their number."""
    share = min(1.0, ORDER_DOCS / max(1, row_count(rows)))
    some = rows.where(F.pmod(F.xxhash64("doc_id", "row_file", "row_at", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle) for text in as_bytes(batch.column(0))]
            found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, "<u8"), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["element", "n"])

    counts = map_batches(some.select("text"), run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS)
    top = counts.orderBy(F.desc("n"), "element").limit(COMMON_MOST).toArrow()
    elements, n = top.column("element").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(elements)
    return elements[order], np.log2(n[order]).astype(np.uint8)


def in_order(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set's elements, those of the lowest level first, then by hash."""
    known, levels = common
    if not len(known) or not len(s):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return s[np.argsort(np.where(known[at] == s, levels[at], 0), kind="stable")]


def prefixes(rows: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, row_file, row_at, key, n, parity, w0, prefix`` of ``doc_id, text, row_file, row_at``.

    Equal keys for equal sets, their size, parity map, fingerprint and first elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle) for text in as_bytes(batch.column(1))]
            columns = [
                pa.array([_key(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([parity_map(s) for s in sets], pa.binary()),
                pa.array([majority(s) if len(s) else 0 for s in sets], pa.int64()),
                pa.array([in_order(s, common)[: prefix_size(len(s), similarity)].tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], ["doc_id", "row_file", "row_at", "key", "n", "parity", "w0", "prefix"])

    schema = "doc_id long, row_file string, row_at long, key binary, n int, parity binary, w0 long, prefix binary"
    return map_batches(rows.select("doc_id", "text", "row_file", "row_at"), run, schema)


def met(n: np.ndarray, place: np.ndarray, group: np.ndarray, sizes: np.ndarray, similarity: float, steps: int | None = None) -> np.ndarray:
    """Index pairs of rows of one cell that may be similar, of different groups.

    Cells of ``sizes`` rows stand one after another, each sorted by ``n``; a row's
    ``place`` is that of the cell's element in its set.  A pair is given in the
    cells of its first common elements at least, as many as both sets' ``meetings``.
    ``steps``: only rows so near each other in a cell.
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(n)) - 1  # rows after this one in its cell
    after, out, step = n - place, [np.empty((0, 2), np.int64)], 1
    first = np.flatnonzero(left >= 1)
    while len(first) and (steps is None or step <= steps):
        second = first + step
        fits = n[first] >= similarity * n[second] - TINY  # rows further on are larger still
        first, second = first[fits], second[fits]
        # of k first common elements the last has k - 1 before it
        need = similarity / (1 + similarity) * (n[first] + n[second]) - TINY - (meetings(np.minimum(n[first], n[second]), similarity) - 1)
        may = (np.minimum(after[first], after[second]) >= need) & (group[first] != group[second])
        out.append(np.stack([first[may], second[may]], axis=1))
        step += 1
        first = first[left[first] >= step]
    return np.concatenate(out)


def _pairs(cells: DataFrame, similarity: float, steps: int | None) -> DataFrame:
    """``u, v`` (u > v): distinct pairs that meet in ``cell, part`` often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            n, place, node, group = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "place", "node", "grp"))
            sizes = np.diff(members.offsets.to_numpy())
            order = np.lexsort((node, n, np.repeat(np.arange(len(sizes)), sizes)))
            n, node = n[order], node[order]
            at = met(n, place[order], group[order], sizes, similarity, steps)
            need = meetings(np.minimum(n[at[:, 0]], n[at[:, 1]]), similarity)
            both, some, times = np.unique(np.sort(node[at], axis=1), axis=0, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (both[:, 1], both[:, 0], need[some], times)], ["u", "v", "need", "times"])

    member = F.struct("n", "place", "node", "grp")
    groups = cells.groupBy("cell", "part").agg(F.collect_list(member).alias("members")).where("size(members) > 1").select("members")
    found = map_batches(groups, run, "u long, v long, need long, times long")
    return found.groupBy("u", "v").agg(F.max("need").alias("need"), F.sum("times").alias("times")).where("times >= need").select("u", "v")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v`` (u > v): sets of near fingerprints ``w0``, as many pairs as connect them all.

    Of equal fingerprints the smallest node stands for the others, which pair with it.
    """
    prints = shared_table(nodes.groupBy("w0").agg(F.min("node").alias("first")), "fingerprints")
    near = links(prints.select(F.col("w0").alias("node")), MAX_BITS, near_edges)
    between = near.join(prints.toDF("u", "a"), "u").join(prints.toDF("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    equal = nodes.select("node", "w0").join(prints, "w0").where("node > first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return between.union(equal)


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, elements`` of the ``node, row_file, row_at`` of ``wanted``.

    No text is shuffled: tasks that read ``rows`` know which places are wanted by a
    bit a row at most.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for at in batch.column(2).to_pylist():
                one = np.zeros(MAP_ROWS, np.uint8)
                one[at] = 1
                bits.append(np.packbits(one).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["row_file", "part", "bits"])

    part, at = F.floor(F.col("row_at") / MAP_ROWS).alias("part"), F.pmod("row_at", F.lit(MAP_ROWS)).cast("int")
    parts = map_batches(wanted.groupBy("row_file", part).agg(F.collect_list(at).alias("at")), maps, "row_file string, part long, bits binary").toArrow()
    known = {(f, p): zlib.compress(b, 1) for f, p, b in zip(*(c.to_pylist() for c in parts.columns))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        for batch in batches:
            keep = []
            for file, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, bit = (file, row // MAP_ROWS), row % MAP_ROWS
                if opened[0] != place:
                    opened = (place, zlib.decompress(known[place]) if place in known else None)
                keep.append(opened[1] is not None and bool(opened[1][bit >> 3] & 128 >> (bit & 7)))
            if any(keep):
                batch = batch.filter(pa.array(keep, pa.bool_()))
                found = [shingle_set(text, shingle).tobytes() for text in as_bytes(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["row_file", "row_at", "elements"])

    found = map_batches(rows.select("row_file", "row_at", "text"), run, "row_file string, row_at long, elements binary")
    return found.join(wanted, ["row_file", "row_at"]).select("node", "elements")


class _Verifier:
    """The pairs whose sets are similar.  Texts are read again, once, at the places of ``nodes``."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float):
        self.nodes, self.rows, self.shingle, self.similarity = nodes, rows, shingle, similarity
        self.held: DataFrame | None = None

    def _possible(self, pairs: DataFrame) -> DataFrame:
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                differ = np.array([maps_differ(a, b) for a, b in zip(batch.column("pu").to_pylist(), batch.column("pv").to_pylist())], np.int64)
                n = batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy()
                may = differ <= (1 - similarity) / (1 + similarity) * n + TINY
                yield batch.select(["u", "v"]).filter(pa.array(may, pa.bool_()))

        of = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
        both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "nu", "nv", "pu", "pv")
        return shared_table(map_batches(both, run, "u long, v long").distinct(), "pairs")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(common >= similarity * (len(a) + len(b) - common) - TINY)
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        may = self._possible(pairs)
        needed = may.select(F.col("u").alias("node")).union(may.select("v")).distinct()
        needed = needed.join(self.held.select("node"), "node", "left_anti") if self.held is not None else needed
        wanted = shared_table(self.nodes.join(needed, "node", "left_semi").select("node", "row_file", "row_at"), "wanted")
        if row_count(wanted):
            found = shared_table(_sets(self.rows, wanted, self.shingle), "sets")
            self.held = found if self.held is None else self.held.union(found)
        if self.held is None:
            return may  # no pairs
        both = may.join(self.held.toDF("u", "a"), "u").join(self.held.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return map_batches(both, run, "u long, v long").distinct()


def _grouped(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, row_file, row_at, key, root`` of ``doc_id, text, row_file, row_at``; a null id has no root.

    Distinct sets are the nodes, numbered once and for all in a written table.
    Sets of near fingerprints and neighbours by size in a cell are verified first;
    pairs further apart follow in rounds, the last of all that meet, each only where earlier links left them
    apart, so that large groups of near copies cost no square of their size in
    verification.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    prints = shared_table(prefixes(rows, shingle, similarity, common_elements(rows, shingle)), "prefixes")
    firsts = prints.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "row_file", "row_at")).alias("f"))
    ids = shared_table(firsts.select(F.monotonically_increasing_id().alias("node"), "key", "f.row_file", "f.row_at"), "nodes")
    chosen = prints.join(ids.select("node", "row_file", "row_at"), ["row_file", "row_at"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p, "<i8") for p in batch.column(2).to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            for a in range(0, len(parts), 16):  # a bounded number of rows at a time
                own = sizes[a : a + 16]
                columns = [
                    np.concatenate(parts[a : a + 16]),
                    np.repeat(batch.column(0).to_numpy()[a : a + 16], own),
                    np.repeat(batch.column(1).to_numpy()[a : a + 16], own),
                    np.concatenate([np.arange(s, dtype=np.int32) for s in own]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", "n", "place"])

    elements = map_batches(chosen.select("node", "n", "prefix"), spread, "cell long, node long, n int, place int")
    met_rows = elements.groupBy("cell").agg(F.collect_list(F.struct("node", "n", "place")).alias("members")).where("size(members) > 1")
    cells = shared_table(met_rows.select("cell", F.ceil(F.size("members") / CELL_ROWS).alias("chunks"), F.explode("members").alias("m")).select("cell", "chunks", "m.*"), "cells")
    own = cells.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
    nodes = shared_table(chosen.select("node", "row_file", "row_at", "n", "parity", "w0"), "sizes")
    check = _Verifier(nodes, rows, shingle, similarity)
    beside = _pairs(own.select("cell", F.col("chunk").alias("part"), "n", "place", "node", F.col("node").alias("grp")), similarity, ROUNDS[0])
    near = shared_table(check(_fingerprint_pairs(nodes).union(beside)), "links")
    roots = shared_table(connected(near), "roots")
    for steps in ROUNDS[1:]:
        # what those links left apart: every pair of chunks of every cell that holds more than one group
        grouped = own.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node"))
        apart = grouped.groupBy("cell").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("cell")
        every = grouped.join(apart, "cell").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
        rest = shared_table(check(_pairs(every.select("cell", part.alias("part"), "n", "place", "node", "grp"), similarity, steps)), "links")
        # each group is a node by now, so links of groups are enough
        group = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        between = rest.join(group("u"), "u", "left").join(group("v"), "v", "left").select(F.coalesce("root_u", "u").alias("a"), F.coalesce("root_v", "v").alias("b"))
        between = between.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        roots = shared_table(connected(between.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
    of_key = ids.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    out = prints.select("doc_id", "row_file", "row_at", "key").join(of_key, "key", "left")
    return out.withColumn("root", F.when(F.col("doc_id").isNotNull(), F.col("root")))


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    placed, names = with_row_place(df)
    rows = placed.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *(F.col(n).alias(c) for n, c in zip(names, ("row_file", "row_at"))))
    return placed, rows, names


def similar_groups(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row.

    Texts link whose sets of word shingles have a Jaccard similarity of
    ``similarity`` or more, every such pair; ``component_id`` is the smallest id
    that links reach.  A text of fewer words than a shingle is one shingle, and
    texts without words (null ones too) link with each other; a text of any length
    is read whole.  An id on several rows with different texts links by each of
    them alone.  A null id takes no part and has a null component; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    found = shared_table(_grouped(_rows(df, id_col, text_col)[1], shingle, similarity), "grouped")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").select("doc_id", "component_id")


def keep_one(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group of ``similar_groups``, with all its columns, and all rows without id.

    It is the row with the smallest id, among rows that share it the first in the
    table.  Rows are told apart by their places, so an id on several rows with
    different texts loses none of them that has no near copy.
    """
    placed, rows, names = _rows(df, id_col, text_col)
    found = shared_table(_grouped(rows, shingle, similarity), "grouped")
    first = found.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row_file", "row_at")).alias("f")).select("f.row_file", "f.row_at")
    return rows_at(placed, first.union(found.where("doc_id is null").select("row_file", "row_at")), names)
