"""Shared plumbing of the training-data operators.

Lineage is cut by tables written to the folder that ``spark.checkpoint.dir``
names: every executor can read them, so a lost executor costs a re-read and not
a recomputation.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._shared import new_path as shared_path
from .._shared import release, scratch_scope, shared_dir, shared_table
from .._ship import ship

__all__ = ["Memo", "as_bytes", "documents", "map_batches", "release", "row_count", "scratch_scope", "shared_dir", "shared_path", "shared_table", "text_or_empty", "rows_at", "with_row_place"]

#: Rows that a Python function gets at once.  Spark bounds an Arrow batch by bytes
#: (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default); Python objects
#: made of its texts are bounded by these slices.
ARROW_ROWS = 256


class Memo(dict):
    """Values of a function by key (a string or bytes), of bounded size in bytes.

    An entry counts ``entry`` bytes and ``each`` for every one of its key's.  Two
    generations: when the young one holds half the limit it becomes the old one,
    and what is asked for again moves back, so that frequent keys stay.
    """

    def __init__(self, compute: Callable, limit: int, entry: int = 200, each: int = 2):
        super().__init__()
        self.compute, self.limit, self.entry, self.each = compute, limit, entry, each
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        size = self.entry + self.each * len(key)
        if 2 * size <= self.limit:  # else too large to be worth it
            self.held += size
            if 2 * self.held > self.limit:
                self._turn(size)
            self[key] = value
        return value

    def remember(self, entries: dict) -> None:
        size = self.entry * len(entries) + self.each * sum(map(len, entries))
        if 2 * size <= self.limit:
            self.held += size
            if 2 * self.held > self.limit:
                self._turn(size)
            self.update(entries)

    def _turn(self, held: int) -> None:
        self.old, self.held = dict(self), held
        self.clear()


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``ARROW_ROWS`` rows."""
    ship(df.sparkSession)
    rows = ARROW_ROWS

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def with_row_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two more columns, a string and a long, that tell all its rows apart.

    They are the same whenever the rows are read again: the file and the position in
    it where ``df`` reads parquet; anything else is written to the shared folder first.
    """
    names = ["__file", "__at"]
    while set(names) & set(df.columns):
        names = [f"{n}_" for n in names]

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))

    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        with contextlib.suppress(AnalysisException):
            return placed(df), names
    stored = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed(shared_table(stored, "rows")).toDF(*df.columns, *names), names


def rows_at(df: DataFrame, places: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``with_row_place(df)`` at ``places`` (``row_file, row_at``), without the added columns."""
    wanted = places.select(F.col("row_file").alias(f"{names[0]}_w"), F.col("row_at").alias(f"{names[1]}_w"))
    met = df.join(wanted, (F.col(names[0]) == F.col(f"{names[0]}_w")) & (F.col(names[1]) == F.col(f"{names[1]}_w")), "left_semi")
    return met.drop(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def row_count(df: DataFrame) -> int:
    return df.count()
