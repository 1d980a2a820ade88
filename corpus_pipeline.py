"""From raw documents to packed training sequences.

Toxic documents go, exact copies go, one document of each near-duplicate group
stays, and what is left is packed.  Every stage reads the table its predecessor
wrote.

All stages tell rows apart by their places and never by ids alone; a null text
counts as empty, texts of any length are read whole, columns beside id and text
are carried (or, by packing, not read) whatever their names and nulls, and an
empty table gives an empty one.  What a stage does with null ids, empty texts and
repeated rows is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import documents, release, scratch_scope, shared_table
from gleanery.llm.exact_dedup import keep_first
from gleanery.llm.packing import pack
from gleanery.llm.shingle_sets import keep_one
from gleanery.llm.toxicity import reject_toxic, train

#: Near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def _begin(stage: str) -> None:
    """Scratch tables of earlier stages go: these stages' results are written by now."""
    names = [name for name, _ in STAGES]
    for earlier in names[: names.index(stage)]:
        release(f"pipeline/{earlier}")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic.

    Each row is judged by its own text: repeated rows share a fate, rows without id
    are judged like any other, an empty text is kept unless the model, which knows
    nothing of it but the share of toxic documents, says otherwise.
    """
    docs = documents(spark, sf_dir) if docs is None else docs
    with scratch_scope("pipeline/toxicity"):
        return reject_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents: the smallest id, null ids last, of repeated rows the first.

    Empty, null and white-space texts are two groups: nothing, and one space.
    """
    _begin("exact_dedup")
    with scratch_scope("pipeline/exact_dedup"):
        return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates: the smallest id, of rows that repeat it the first.

    Rows without id take no part and stay.  Texts without words are one group.
    """
    _begin("near_dedup")
    with scratch_scope("pipeline/near_dedup"):
        return keep_one(docs, SHINGLE, SIMILARITY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences.

    Rows without id, repeated rows and empty texts (the end token alone) are packed
    like any other.
    """
    _begin("packing")
    with scratch_scope("pipeline/packing"):
        return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the decoding, nor similar sets, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch_scope(f"pipeline/{name}/written"):
            docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
