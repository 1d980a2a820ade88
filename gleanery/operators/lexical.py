"""BM25 over postings tables, rank fusion and hydration.

Postings are lists: documents come in blocks, and a row holds the places and counts
of one term in one block.  So a table has a row for many occurrences, and a block is
scored by itself, with no join of occurrences to documents or questions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._shared import shared_table, small
from .._ship import ship
from ..functions.text import STOP_WORDS, lexical_tokens
from .knn import top_k

#: Occurrences and distinct terms after which a block of documents ends; rows of lists that a task sends at once.
BLOCK_PAIRS, BLOCK_TERMS, SENT_LISTS = 1 << 20, 1 << 18, 1 << 14
#: Words outside a wanted set that a task remembers, and pairs of question and term that are sent to every task, at most.
REMEMBERED, SENT_TERMS = 1 << 17, 1 << 19
K1, B, RRF = 1.2, 0.75, 60.0


def postings(docs: DataFrame, stop_words: bool = True) -> DataFrame:
    """``id, term, tf`` of ``id, text``."""
    terms = docs.select("id", F.explode(lexical_tokens(F.col("text"), stop_words)).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, stop_words: bool = True) -> DataFrame:
    return docs.select("id", F.size(lexical_tokens(F.col("text"), stop_words)).cast("long").alias("dl"))


class _Codes(dict):
    """Numbers of words: from 0 those that are listed, ``OTHER`` for words that only lengthen a text, ``NONE`` for what isn't indexed."""

    NONE, OTHER = -1, -2

    def __init__(self, stop_words: bool, only: list[bytes] | None):
        self.stop, self.only = {w.encode() for w in STOP_WORDS} if stop_words else set(), only
        self.names = [w for w in only or () if w not in self.stop]
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.update(zip(self.names, range(len(self.names))))

    def __missing__(self, word: bytes) -> int:
        if not 2 <= len(word) <= 32 or word in self.stop:
            return self.NONE
        if self.only is not None:
            if len(self) >= len(self.names) + REMEMBERED:
                self._begin()
            self[word] = self.OTHER
            return self.OTHER
        self[word] = code = len(self.names)
        self.names.append(word)
        return code

    def next_block(self) -> None:
        if self.only is None:
            self.names = []
            self._begin()


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def blocked(docs: DataFrame, stop_words: bool = True, only: list[bytes] | None = None) -> DataFrame:
    """``term, block, at, tf, ids`` of ``id, text``: lists of the places in a block of documents where a term stands, and how often.

    A row without a term has the ids and, as ``tf``, the lengths of its block's
    documents; a block is named by its first id.  With ``only``, no other terms are
    listed, and lengths count all.  Ids are of one document each.
    """
    ship(docs.sparkSession)
    most_pairs, most_terms = BLOCK_PAIRS, BLOCK_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, words = _Codes(stop_words, only), re.compile(rb"[a-z0-9']+").findall
        schema = pa.schema([("term", pa.string()), ("block", kind), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(kind))])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list = []
        lengths: list[int] = []
        pairs = 0

        def block() -> Iterator[pa.RecordBatch]:
            name = next((i for i in ids if i is not None), None)
            whole = [pa.array([x], t) for x, t in zip((None, name, None, lengths, ids), schema.types)]
            yield pa.RecordBatch.from_arrays(whole, schema=schema)
            code, tf = (np.concatenate(c) for c in zip(*found))
            at = np.repeat(np.arange(len(found), dtype=np.int32), [len(u) for u, _ in found])
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(codes.names))
            held = np.flatnonzero(n)
            ends = np.cumsum(n[held])
            for first in range(0, len(held), SENT_LISTS):
                some = held[first : first + SENT_LISTS]
                part = order[ends[first] - n[held[first]] : ends[first + len(some) - 1]]
                terms = pa.array([codes.names[c] for c in some.tolist()], pa.binary()).cast(pa.string())
                rows = [terms, pa.array([name] * len(some), kind), _lists(at[part], n[some]), _lists(tf[part], n[some]), pa.nulls(len(some), pa.list_(kind))]
                yield pa.RecordBatch.from_arrays(rows, schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py()) if text.is_valid else []
                code = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
                lengths.append(int((code != codes.NONE).sum()))
                ids.append(i)
                u, c = np.unique(code[code >= 0], return_counts=True)
                found.append((u, c.astype(np.int32)))
                pairs += len(u) + 8  # an empty text takes memory too
                if pairs >= most_pairs or (only is None and len(codes.names) >= most_terms):
                    yield from block()
                    found, ids, lengths, pairs = [], [], [], 0
                    codes.next_block()
        if ids:
            yield from block()

    id_type = docs.schema["id"].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    name = id_type.simpleString()
    texts = docs.select("id", F.lower("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"term string, block {name}, at array<int>, tf array<int>, ids array<{name}>")


def one_text_an_id(docs: DataFrame) -> DataFrame:
    """``id, text`` with the texts of an id that stands on several rows put together."""
    if not docs.groupBy("id").count().where("count > 1").limit(1).count():
        return docs
    return docs.groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def tables(docs: DataFrame, stop_words: bool = True, only: list[bytes] | None = None) -> dict[str, DataFrame]:
    """``postings`` (``term, block, at, tf``), ``terms`` (``term, df``), ``doc_stats`` (``id, dl, block, at``) and ``corpus_stats`` (``n, total``).

    Texts are tokenised in one pass; everything else comes from its lists.
    """
    found = shared_table(blocked(one_text_an_id(docs.select("id", "text")), stop_words, only), "postings")
    held = found.where("term is not null")
    documents = found.where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "tf")).alias("at", "d"))
    lengths = documents.select(F.col("d.ids").alias("id"), F.col("d.tf").cast("long").alias("dl"), "block", "at")
    return {
        "postings": held.select("term", "block", "at", "tf"),
        "terms": held.groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("df")),
        "doc_stats": lengths,
        "corpus_stats": lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")),
    }


def occurrences(stored: dict[str, DataFrame]) -> DataFrame:
    """``term, id, dl, tf``: a row for every term of every document."""
    flat = stored["postings"].select("term", "block", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("term", "block", "p.at", "p.tf")
    return flat.join(stored["doc_stats"], ["block", "at"]).select("term", "id", "dl", "tf")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term"))


def _sent(asked: DataFrame) -> pa.Table | None:
    """``query_id, term`` on the driver, or None where they are too many to be sent."""
    head = asked.limit(SENT_TERMS + 1).toArrow()
    return head if head.num_rows <= SENT_TERMS else None


def bm25_stored(queries: DataFrame, stored: dict[str, DataFrame], n: int) -> DataFrame:
    """``query_id, rank, id, score``: the n best documents of each ``query_id, text``, from ``tables``.

    The questions' terms are sent to the lists, and each block of documents gives
    its n best for each question.  Questions too many to be sent meet occurrences
    in joins.
    """
    asked = _asked(queries)
    sent = _sent(asked)
    return _scored_by_joins(asked, stored, n) if sent is None else _scored_by_blocks(asked, sent, stored, n)


def _scored_by_joins(asked: DataFrame, stored: dict[str, DataFrame], n: int) -> DataFrame:
    wanted = stored["postings"].join(asked.select("term").distinct(), "term", "left_semi")
    tf, dl, total, count, df = (F.col(c).cast("double") for c in ("tf", "dl", "total", "n", "df"))
    idf = F.log(F.lit(1.0) + (count - df + F.lit(0.5)) / (df + F.lit(0.5)))
    average = F.greatest(F.lit(1.0), total / count)
    score = idf * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / average))
    one = F.broadcast(stored["corpus_stats"])  # a single row
    scored = asked.join(stored["terms"], "term").join(occurrences(stored | {"postings": wanted}), "term").join(one).select("query_id", "id", score.alias("part"))
    sums = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(sums, n, descending=True, by="score")


def _scored_by_blocks(asked: DataFrame, sent: pa.Table, stored: dict[str, DataFrame], n: int) -> DataFrame:
    spark = asked.sparkSession
    ship(spark)
    terms = sorted({t for t in sent.column("term").to_pylist()})
    named = F.broadcast(spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, t int"))  # bounded by SENT_TERMS
    df = np.zeros(len(terms))
    for row in stored["terms"].join(named, "term").select("t", "df").collect():
        df[row["t"]] = row["df"]
    count, total = stored["corpus_stats"].select(F.col("n").cast("double"), F.col("total").cast("double")).first()
    idf, average = np.log(1.0 + (count - df + 0.5) / (df + 0.5)), max(1.0, total / count) if count else 1.0
    number, by_query = {t: i for i, t in enumerate(terms)}, {}
    for q, t in zip(sent.column("query_id").to_pylist(), sent.column("term").to_pylist()):
        by_query.setdefault(q, []).append(number[t])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        place, ids, dl = left.column("at").to_numpy(), left.column("id").combine_chunks(), left.column("dl").to_numpy().astype(np.float64)
        own = np.argsort(place)  # places are 0, 1, ...
        ids, dl = ids.take(pa.array(own)), dl[own]
        by_id = np.empty(len(own), np.int64)
        by_id[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(own))
        lists = {}
        for chunk in right.to_batches():
            flat = lambda name, c=chunk: c.column(name).flatten().to_numpy(zero_copy_only=False)
            at, tf = flat("at"), flat("tf").astype(np.float64)
            ends = np.cumsum(pa.compute.list_value_length(chunk.column("at")).to_numpy(zero_copy_only=False))
            t = chunk.column("t").to_numpy()
            part = np.repeat(idf[t], np.diff(ends, prepend=0)) * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * dl[at] / average))
            for k, a, b in zip(t.tolist(), np.concatenate([[0], ends[:-1]]), ends):
                lists[k] = (at[a:b], part[a:b])
        queries, picked, scores = [], [], []
        for q, wanted in by_query.items():
            own_lists = [lists[t] for t in wanted if t in lists]
            if not own_lists:
                continue
            at = np.concatenate([x for x, _ in own_lists])
            sums = np.round(np.bincount(at, np.concatenate([x for _, x in own_lists]), len(dl)), 6)
            hit = np.flatnonzero(np.bincount(at, minlength=len(dl)))
            if len(hit) > n:
                edge = np.partition(sums[hit], len(hit) - n)[len(hit) - n]
                hit = hit[sums[hit] >= edge]
            best = hit[np.lexsort((by_id[hit], -sums[hit]))][:n]
            queries += [q] * len(best)
            picked.append(best)
            scores.append(sums[best])
        chosen = pa.array(np.concatenate(picked) if picked else [], pa.int64())
        return pa.table({"query_id": pa.array(queries, left_type), "id": ids.take(chosen), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    left_type = sent.schema.field("query_id").type
    named_type = lambda c, d: d.schema[c].dataType.simpleString()
    wanted = stored["postings"].join(named, "term").select("block", "t", "at", "tf")
    documents = stored["doc_stats"].select(F.col("block").alias("own"), "at", "id", "dl")  # both sides may come from one table
    hits = documents.groupBy("own").cogroup(wanted.groupBy("block")).applyInArrow(score, f"query_id {named_type('query_id', asked)}, id {named_type('id', documents)}, score double")
    return top_k(hits, n, descending=True, by="score")


def bm25(queries: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``bm25_stored`` over tables made of ``docs``; of these only the questions' terms are listed."""
    sent = _sent(_asked(queries))
    only = None if sent is None else sorted({t.encode() for t in sent.column("term").to_pylist()})
    return bm25_stored(queries, tables(docs, only=only), n)


def score_floor(hits: DataFrame, share: float = 3.0) -> DataFrame:
    """Hits of at least a ``share``-th of their query's best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).where(F.col("score") >= F.col("best") / share).drop("best")


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame, k: int, constant: float = RRF) -> DataFrame:
    """``query_id, rank, id, fused``: reciprocal rank fusion with ranks from 0."""
    part = lambda df, name: df.select("query_id", "id", (F.lit(1.0) / (F.lit(constant) + F.col("rank") - 1)).alias(name))
    both = part(vector_hits, "a").join(part(lexical_hits, "b"), ["query_id", "id"], "full_outer")
    fused = both.select("query_id", "id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("fused"))
    return top_k(fused, k, descending=True, by="fused")


def augmented(vector_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Union of candidates, each pair once."""
    return vector_hits.select("query_id", "id").union(lexical_hits.select("query_id", "id")).distinct()


def hydrate(hits: DataFrame, records: DataFrame, few: bool = False) -> DataFrame:
    """Hits with their records; a hit without one keeps its id.  Names of hits win.

    Few hits (a bounded number of each of the questions) are sent to the records, which then aren't shuffled.
    """
    clash = [c for c in records.columns if c in hits.columns and c != "id"]
    if few:
        hits = small(hits, "hits")
        records = records.join(hits.select("id").distinct(), "id", "left_semi")
    return hits.join(records.drop(*clash), "id", "left")
