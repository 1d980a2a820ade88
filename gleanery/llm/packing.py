"""Sum-of-squares packing of documents into sequences.

A piece goes where the sum of the squared counts of open bins per residual gap
becomes smallest (Csirik et al. 2006), which keeps gaps of every size in stock.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, row_count, text_or_empty

CAPACITY, END = 1_024, 2
#: Documents of one packer.  A packer leaves some bins open, so more packers waste more.
PACKER_DOCS = 100_000
#: Bytes of chunks and their ids that one Python worker remembers.
CACHE_BYTES = 224 << 20

# White space as the tokenizer's patterns know it.
WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Chunks on whose letters both encoders agree by definition.
PLAIN = re.compile("[\x00-\x7f\xc0-\xff]+")
#: Texts cut between white space and words, where the byte-level pattern always cuts too.
CHUNKS = re.compile(f"[{WS}]+(?![^{WS}])| ?[^{WS}]+|[{WS}]")


class ByteLevelEncoder:
    """Token ids of a byte-level BPE, as little-endian unsigned 32-bit bytes.

    The pattern of such a tokenizer never joins characters across the cuts of
    ``CHUNKS``, so chunks are encoded apart and remembered.
    """

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = _same_ranks(self.tokenizer)
        self.cache = Memo(self._chunk, cache, 230, 5)

    def _chunk(self, chunk: str) -> bytes:
        ids = self.fast(chunk) if self.fast and PLAIN.fullmatch(chunk) else self._ids(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):  # the library cuts at added tokens first
            ids = self._ids(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.cache.__getitem__, CHUNKS.findall(text)))


def _same_ranks(tokenizer):
    """tiktoken's encoder over this tokenizer's own vocabulary, or None where its ids aren't ranks."""
    import json

    import public_tokenizers
    import tiktoken

    byte_of = {c: b for b, c in _byte_characters().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
    except KeyError:
        return None
    model = json.loads(tokenizer.to_str())["model"]
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    ids = [vocabulary.get(m, -1) for m in merged]
    if model["type"] != "BPE" or ids != sorted(ids) or len(set(ids)) != len(ids) or len(ranks) != 256 + len(ids):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class SumOfSquares:
    """Online packing into bins of one capacity."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.opened = capacity, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
        self.counts = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        counts, best = self.counts, self.capacity
        # by gap g >= size: the change of the sum if a bin of that gap takes the piece
        change = 2 * (counts[: self.capacity - size + 1] - counts[size:]) + 2
        change[0] -= 1  # a full bin is no longer open
        change[-1] = 2 * counts[self.capacity - size] + 1 if size < self.capacity else 0  # a new bin
        usable = counts[size:] > 0
        usable[-1] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        best = size + int(change.argmin())
        if best == self.capacity:
            number, offset = self.opened, 0
            self.opened += 1
        else:
            number, offset = self.bins[best].pop(), self.capacity - best
            counts[best] -= 1
        if gap := best - size:
            self.bins[gap].append(number)
            counts[gap] += 1
        return number, offset


_workers: dict[str, ByteLevelEncoder] = {}


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents' ids, cut where they are too long.

    Every piece but the first has ``capacity`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _workers:
            _workers[tokenizer] = ByteLevelEncoder(tokenizer)
        encoder, last = _workers[tokenizer], struct.pack("<I", end)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text) + last)
                first = (len(ids) - 1) % (4 * capacity) + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, 4 * capacity)):
                    start = max(0, stop - 4 * capacity)
                    part = ids[start:stop]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, packers: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their places: ``sequence_id, offset``.

    Null and empty texts are the end token alone.  Rows that repeat an id, or
    have none, are packed like any other.  A text of any length is encoded whole,
    by chunks, and cut into pieces in its task.  Packers get equal shares of the
    pieces, whatever their ids, of ``PACKER_DOCS`` documents on average; the shares
    and the order in them come from the rows themselves, so a packer that is run
    again gives the same places.  Full pieces take a sequence at once.  Ids never
    leave the task that made them: only piece lengths are shuffled.  An empty table
    gives no rows; other columns are not read.
    """
    packers = packers or max(1, round(row_count(df) / PACKER_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = SumOfSquares(capacity)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(3).to_pylist()]
            number, offset = zip(*placed) if placed else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + n for n in number], pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    cut = pieces(df, tokenizer, capacity, end, id_col, text_col)
    spread = cut.repartition(packers).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return spread.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
