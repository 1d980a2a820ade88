"""Exact dedup with an extendible-hash index over shared page files.

Map tasks write normalised texts to page files in the shared folder and send
only keys and places on.  Owner tasks, one for each key range, keep an
extendible hash table of places: a full bucket splits and, where it must, the
directory doubles.  Texts whose keys collide are chained and told apart by the
bytes in the page files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, row_count, rows_at, shared_path, shared_table, text_or_empty, with_row_place

#: Entries of a bucket before it splits, and the deepest directory of one owner.
BUCKET_ENTRIES, MAX_DEPTH = 32, 24
#: Documents of one owner task.
OWNER_ROWS = 250_000
#: Bytes of distinct texts that a map task remembers to collapse copies at once.
RECENT_BYTES = 32 << 20

_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def normalised(text: bytes) -> bytes:
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class ExtendibleIndex:
    """Extendible hashing from 64-bit keys to chains of entries."""

    def __init__(self, bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH):
        self.capacity, self.max_depth, self.depth = bucket_entries, max_depth, 0
        self.directory: list[list] = [[0, {}]]  # a bucket: its own depth, key -> chain

    def chain(self, key: int) -> list:
        """The chain of a key, made where it is new."""
        while True:
            bucket = self.directory[key & ((1 << self.depth) - 1)]
            if key in bucket[1]:
                return bucket[1][key]
            if len(bucket[1]) < self.capacity or bucket[0] == self.max_depth:
                return bucket[1].setdefault(key, [])
            self._split(bucket)

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory += self.directory  # doubled: both halves point to the same buckets
            self.depth += 1
        bit = 1 << bucket[0]
        low, high = [bucket[0] + 1, {}], [bucket[0] + 1, {}]
        for key, chain in bucket[1].items():
            (high if key & bit else low)[1][key] = chain
        some = next(iter(bucket[1])) & (bit - 1)
        for at in range(some, len(self.directory), bit):
            self.directory[at] = high if at & bit else low


def _pages(rows: DataFrame, folder: str) -> DataFrame:
    """Every key and digest of ``doc_id, text, row_file, row_at``, and the place of the text in a page file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        name = uuid.uuid4().hex  # of this attempt alone
        pack, out, place = zstandard.ZstdCompressor(level=1), None, 0
        recent: dict[bytes, tuple] = {}
        held = 0
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                text = normalised(text)
                row = recent.get(text)  # equal by its bytes
                if row is None:
                    digest, page = hashlib.sha256(text), pack.compress(text)
                    if out is None:
                        out = filesystem.open_output_stream(f"{root}/{name}")
                    out.write(page)
                    row = (int.from_bytes(digest.digest()[:8], "little", signed=True), digest.hexdigest(), name, place, len(page), len(text))
                    place += len(page)
                    if held > RECENT_BYTES:
                        recent, held = {}, 0
                    recent[text] = row
                    held += len(text) + 200
                rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "row_file", "row_at", "key", "sha", "file", "place", "stored", "size"],
            )
        if out is not None:
            out.close()

    schema = "doc_id long, row_file string, row_at long, key long, sha string, file string, place long, stored long, size long"
    return map_batches(rows.select("doc_id", "text", "row_file", "row_at"), run, schema)


def _owned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One owner's key range: places to classes of equal texts."""
    filesystem, root = fs.FileSystem.from_uri(folder)
    opened: dict[str, object] = {}

    def text(entry: tuple) -> bytes:
        file, place, stored, _ = entry
        if file not in opened:
            if len(opened) >= 64:
                opened.pop(next(iter(opened))).close()
            opened[file] = filesystem.open_input_file(f"{root}/{file}")
        return zstandard.decompress(opened[file].read_at(stored, place))

    index = ExtendibleIndex()
    classes: list[list] = []  # [entry, first row, rows]
    members: list[tuple[str, int, int]] = []
    first_texts: dict[int, bytes] = {}  # of classes met again, RECENT_BYTES at most
    held = 0
    for batch in batches:
        for key, file, place, stored, size, missing, doc_id, row_file, row_at, n in zip(*(c.to_pylist() for c in batch.columns)):
            entry, chain, own = (file, place, stored, size), index.chain(key & (2**64 - 1)), None
            content = None
            for number in chain:
                if classes[number][0][3] == size:
                    content = text(entry) if content is None else content
                    if (known := first_texts.get(number)) is None:
                        known = text(classes[number][0])
                        if held + len(known) > RECENT_BYTES:
                            first_texts, held = {}, 0
                        first_texts[number], held = known, held + len(known)
                    if known == content:
                        own = number
                        break
            row = (missing, doc_id, row_file, row_at)
            if own is None:
                own = len(classes)
                classes.append([entry, row, 0])
                chain.append(own)
            of = classes[own]
            of[1] = min(of[1], row, key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
            of[2] += n
            members.append((file, place, own))
    for at in range(0, len(members), 10_000):
        part = members[at : at + 10_000]
        firsts = [classes[m[2]] for m in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m[0] for m in part], pa.string()),
                pa.array([m[1] for m in part], pa.int64()),
                *(pa.array([c[1][i] for c in firsts], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()))),
                pa.array([c[2] for c in firsts], pa.int64()),
            ],
            ["file", "place", "keep_id", "keep_file", "keep_at", "group_size"],
        )


def _classes(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, text, row_file, row_at``) without texts, with the first row and the size of their classes."""
    spark = rows.sparkSession
    folder = shared_path(spark, "pages")
    placed = shared_table(_pages(rows, folder), "placed")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-row_count(placed) // OWNER_ROWS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_file", "row_at")).alias("first")
    distinct = placed.groupBy("key", "file", "place", "stored", "size").agg(first, F.count("*").alias("n"))
    # digests are uniform, so equal key ranges are equal shares
    owner = F.floor((F.shiftright("key", 32) + 2**31) * owners / 2**32).cast("int")
    owned = distinct.select("key", "file", "place", "stored", "size", "first.*", "n").repartition(owners, owner)
    classes = map_batches(owned, lambda batches: _owned(batches, folder), "file string, place long, keep_id long, keep_file string, keep_at long, group_size long")
    return placed.join(classes, ["file", "place"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when their normalised bytes are; null counts as empty.
    ``keep_id`` is the smallest id of the equal texts and that row is ``kept``.
    Null ids come last: a group of null ids only has a null ``keep_id`` and is
    kept.  Rows that repeat an id with the same text are one document: they get
    the same flags, and each counts in ``group_size``.  An empty table gives no
    rows; other columns, whatever their names, are not read.

    A text of any length is one page.  Copies collapse in the map task before
    anything is sent, so a text that a third of all rows share reaches its owner
    about once a task.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.lit("").alias("row_file"), F.lit(0).cast("long").alias("row_at"))
    return _classes(rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``df`` for each class of equal texts, with all its columns.

    It is the one with the smallest id; null ids come last, and among rows that
    share the id the first in the table stays.  Every text of ``df`` stays once:
    rows are told apart by their places, so an id on several rows with different
    texts, rows without id and exact repeats are all judged by their own text.
    Null counts as empty, very long texts are compared whole, an empty table gives
    no rows.
    """
    rows, (file, at) = with_row_place(df)
    classes = _classes(
        rows.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(file).alias("row_file"), F.col(at).alias("row_at"))
    )
    return rows_at(rows, classes.where("row_file = keep_file and row_at = keep_at"), [file, at])
