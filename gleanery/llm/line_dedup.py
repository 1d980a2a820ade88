"""Line dedup: lines that several documents share stay in one of them only.

Lines are exploded and their normalised keys hashed (128 bits); distinct
documents are counted per hash; lines over the threshold are dropped everywhere
but in the smallest document; the rest is reassembled by position.  Built from
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 10, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    line = F.btrim(line, F.lit(SPACES))
    ascii_only = F.length(line) == F.octet_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, keeper``: keys of at least ``min_docs`` documents and the smallest of these.

    Two or more documents hold a key exactly if its smallest and largest ids
    differ; beyond two, (key, document) pairs are made distinct first, which
    spreads a key that every document holds over all tasks.
    """
    if min_docs <= 1:
        return lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"))
    if min_docs == 2:
        ends = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        return ends.where("keeper < last").select("h1", "h2", "keeper")
    counted = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def line_dedup(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, text``.

    A null or empty text is one empty line.  Rows that repeat an id are one
    document: a line that only they share stays in each of them.  A row without
    id takes no part and keeps all its lines.  An empty table gives no rows;
    other columns, whatever their names, are not read.

    Only hashes and positions are shuffled by line; each text moves once, to meet
    the positions it loses.  A line that a third of all documents holds is
    aggregated before the shuffle and, where its rows meet its keeper, left to
    adaptive skew splitting.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("row_hash"), F.split("t", "\n", -1).alias("lines"))
    key = line_key(F.col("line"))
    lines = (
        rows.where("doc_id is not null")
        .select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    dropped = (
        lines.join(shared_lines(lines, min_docs), ["h1", "h2"])
        .where("doc_id <> keeper")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = rows.join(dropped, ["doc_id", "row_hash"], "left")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        "doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(F.col("dropped")), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text")
    )
