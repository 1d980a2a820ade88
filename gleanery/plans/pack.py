"""A searchable dataset: records, vectors, sketches and postings as verified tables.

``build`` writes everything a query needs once, so that no query tokenises or
codes the corpus again.  ``Pack`` opens it, answers batches of questions in one
plan, and proves what it holds.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._shared import shared_table
from ..errors import GleaneryError, check_metric, check_one_of, check_range
from ..functions import text as T
from ..functions import vector as V
from ..operators import calibrate as C
from ..operators import chunking, evaluate, knn, lexical, quality, sketch
from ..operators.encoders import Encoder, verify_encoder
from ..sources.vectors import entries, inspect_dataset, open_dataset, write_dataset

MODES = ("hybrid", "vector", "lexical", "augmented")
#: Lexical candidates of a question, records of a digest page, the ladder of candidate depths and queries that measure it.
LEXICAL, PAGE, LADDER, LADDER_QUERIES = 24, 256, (10, 20, 40, 80, 160, 320, 640), 256
HEADLINE_K = 5


def digested(records: DataFrame) -> DataFrame:
    """``records`` with ``digest``, of all their columns in the order of their names."""
    return records.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}), 256))


def digest_pages(records: DataFrame, rows: int = PAGE) -> DataFrame:
    """``page, n, digest``: records' digests by pages of so many ids, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x["digest"]), "")
    return records.groupBy(F.expr(f"id div {rows}").alias("page")).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


def row_digests(vectors: DataFrame, hex_digits: int = 32) -> DataFrame:
    """``id, digest``: a shortened digest of each coded row."""
    return vectors.select("id", F.substring(F.sha2(F.to_json(F.struct("q", "scale", "offset")), 256), 1, hex_digits).alias("digest"))


def depth_ladder(corpus: DataFrame, coarse: DataFrame, config: dict, count: int, k: int = 10) -> DataFrame:
    """``depth, recall`` of candidate depths, from evenly sampled rows as their own questions."""
    stride = max(1, -(-count // LADDER_QUERIES))
    asked = corpus.where(F.pmod("id", F.lit(stride)) == 0).orderBy("id").limit(LADDER_QUERIES).select(F.col("id").alias("query_id"), "vector")
    depths = sorted({min(d, count) for d in LADDER})
    found = sketch.candidates(asked, coarse, config["sketch_dims"], config["dim"] // config["sketch_dims"], depths[-1], config["metric"])
    return sketch.recall_by_depth(found, knn.knn_join(asked, corpus, min(k, count), config["metric"]), depths)


def build(
    records: DataFrame,
    vectors: DataFrame,
    path: str,
    metric: str = "cosine",
    sketch_dims: int | None = None,
    sketch_bits: int = 4,
    micro_dims: int | None = None,
    goldens: DataFrame | None = None,
    measure: bool = False,
    on_stage: Callable[[str], None] | None = None,
) -> str:
    """Write a pack of ``records`` (``id, text, ...``) and ``vectors`` (``id, vector``); returns its identity.

    All vectors are checked before anything is written.  Goldens (``text,
    expect_id, expect_title``) are kept for ``verify_goldens``.
    """
    check_metric(metric)
    check_one_of("sketch_bits", str(sketch_bits), ("4", "8"))
    said = on_stage or (lambda stage: None)
    vectors = shared_table(vectors.select("id", V.as_double(F.col("vector")).alias("vector")), "vectors")  # encoders run once
    sizes = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count("*").alias("n")).first()
    if not sizes["n"] or sizes["low"] != sizes["high"]:
        raise GleaneryError("DIMENSION_MISMATCH", "vectors must share one dimension", sizes=[sizes["low"], sizes["high"]])
    dim = sizes["low"]
    knn.unusable_batch(vectors, "vector", dim, metric == "cosine")
    dims = sketch_dims or (dim // 2 if dim % 2 == 0 else dim)
    if dim % dims or (micro_dims and dim % micro_dims):
        raise GleaneryError("INVALID_ARGUMENT", "pooled dimensions must divide the dimension", dim=dim, sketch_dims=dims)
    config = {"metric": metric, "dim": dim, "sketch_dims": dims, "sketch_bits": sketch_bits, "micro_dims": micro_dims, "records": sizes["n"]}
    said("vectors")
    coded = sketch.quantized(vectors, metric == "cosine", ("vector",))
    pooled = lambda n: V.nibbles(V.pooled(F.col("q"), n, dim // n)) if sketch_bits == 4 else V.pooled(F.col("q"), n, dim // n)
    tiers = [pooled(dims).alias("p"), *([pooled(micro_dims).alias("m")] if micro_dims else [])]
    said("lexical")
    words = lexical.tables(records.select("id", "text"))
    counts = shared_table(C.word_counts(records), "words")
    kept = counts.where(F.col("n") >= (3 if sizes["n"] >= 200 else 1))
    config["bloom_bits"] = T.bloom_bits(kept.count())
    stored = digested(records)
    by_term = lambda df: df.repartitionByRange("term").sortWithinPartitions("term")  # noqa: E731  ranges of terms prune the files
    tables = {
        "records": stored.repartitionByRange("id").sortWithinPartitions("id"),
        "pages": lambda written: digest_pages(written["records"]),
        "vectors": coded,
        "sketch": lambda written: written["vectors"].select("id", *tiers, "scale", "offset"),
        "postings": by_term(words["postings"]),
        "terms": by_term(words["terms"]),
        "doc_stats": words["doc_stats"],
        "corpus_stats": words["corpus_stats"],
        "bloom": C.bloom_filter(kept, config["bloom_bits"]),
        "common": C.common_words(counts, sizes["n"]),
        "goldens": goldens.select("text", "expect_id", "expect_title") if goldens is not None else records.sparkSession.createDataFrame([], "text string, expect_id long, expect_title string"),
    }
    if measure:
        said("depth")
        coarse = _sketch_rows(coded.select("id", *tiers, "scale", "offset"), "p", config)
        ladder = depth_ladder(vectors, coarse, config, sizes["n"])
        config["depth"] = sketch.recommended_depth(ladder, sizes["n"]).first()["depth"]
    said("write")
    return write_dataset(tables, path, config)


def _sketch_rows(table: DataFrame, tier: str, config: dict) -> DataFrame:
    p = V.from_nibbles(F.col(tier)) if config["sketch_bits"] == 4 else F.col(tier)
    return table.select("id", V.dequantize(p, F.col("scale"), F.col("offset")).alias("vector"))


class Pack:
    """An opened pack."""

    def __init__(self, spark: SparkSession, path: str, identity: str | None = None, verify: bool = False, expect: dict | None = None):
        manifest, self.tables = open_dataset(spark, path, identity, expect, verify)
        self.spark, self.path, self.config = spark, path, manifest["config"]
        self.cached: list[DataFrame] = []

    def cache(self, *names: str) -> Pack:
        """Keep tables in memory; results stay the same."""
        for name in names or ("sketch", "corpus_stats", "terms"):
            self.tables[name] = self.tables[name].cache()
            self.cached.append(self.tables[name])
        return self

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def info(self) -> DataFrame:
        """Tables, rows, digests, configuration and identity, from the manifest alone."""
        return inspect_dataset(self.spark, self.path)

    def record(self, ids: list[int]) -> DataFrame:
        """Records by id; one whose digest is wrong fails the query."""
        names = [c for c in self.tables["records"].columns if c != "digest"]
        rows = self.tables["records"].where(F.col("id").isin(list(ids)))
        again = F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
        wrong = F.raise_error(F.concat(F.lit("DIGEST_MISMATCH: record "), F.col("id").cast("string")))
        return rows.where(F.when(again != F.col("digest"), wrong).otherwise(F.lit(True))).select(*names)

    def verify_pages(self) -> DataFrame:
        """``page, intact``: digest pages made again from the records."""
        names = [c for c in self.tables["records"].columns if c != "digest"]
        again = digest_pages(digested(self.tables["records"].select(*names))).select("page", F.col("digest").alias("now"))
        both = self.tables["pages"].join(again, "page", "full_outer")
        return both.select("page", F.coalesce(F.col("digest") == F.col("now"), F.lit(False)).alias("intact"))

    def verify_encoder(self, encoder: Encoder, sample: int = 16, tolerance: float = 1e-3) -> DataFrame:
        """Whether an encoder gives the stored vectors of ``sample`` records."""
        some = self.tables["records"].orderBy("id").limit(sample).select("id", "text")
        return verify_encoder(encoder, some, self.tables["vectors"].select("id", "vector"), tolerance)

    def lexical(self, queries: DataFrame, n: int = LEXICAL) -> DataFrame:
        """``query_id, rank, id, score`` by BM25, from the stored postings."""
        return lexical.bm25_stored(queries, self.tables, n)

    def coarse(self, queries: DataFrame, depth: int, tier: str = "p") -> DataFrame:
        """The nearest sketches, of the full tier ``p`` or the micro tier ``m``."""
        dims = self.config["sketch_dims"] if tier == "p" else self.config["micro_dims"]
        if not dims:
            raise GleaneryError("NO_TIER", "the pack has no micro sketches")
        rows = _sketch_rows(self.tables["sketch"], tier, self.config)
        return sketch.candidates(queries, rows, dims, self.config["dim"] // dims, depth, self.config["metric"])

    def nearest(self, queries: DataFrame, k: int, rerank: int = 0, extras: DataFrame | None = None, tier: str = "p") -> DataFrame:
        """``query_id, rank, id, distance`` by sketch candidates and exact distances.

        With ``extras`` those pairs are candidates too, and every candidate comes
        back.  The micro tier looks four times as deep.  A depth of all rows, for
        which a sketch saves nothing, is searched exactly.
        """
        count = self.config["records"]
        depth = sketch.candidate_depth(count, k, rerank, self.config.get("depth") or 0)
        depth = min(count, depth * 4) if tier == "m" else depth
        rows, metric = self.tables["vectors"].select("id", "vector"), self.config["metric"]
        if depth >= count:
            return knn.knn_join(queries, rows, k if extras is None else count, metric)
        found = self.coarse(queries, depth, tier)
        if extras is None:
            return sketch.rerank(queries, rows, found, k, metric)
        return sketch.rerank(queries, rows, sketch.with_extras(found, extras), None, metric)

    def signals(self, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """``query_id`` and the features of abstention, from the distance order of ``hits``."""
        words = texts.select("query_id", F.explode(T.all_tokens(F.col("text"))).alias("term"))
        known = C.known_words(words, self.tables["bloom"], self.config["bloom_bits"], ["query_id"]).groupBy("query_id").agg(F.avg(F.col("known").cast("double")).alias("known_frac"))
        content = texts.select("query_id", F.explode(T.content_words(F.col("text"))).alias("w"))
        passages = lexical.hydrate(hits.where("rank <= 5").select("query_id", "id"), self.tables["records"].select("id", "text"), few=True)
        covered = C.coverage(content, passages, self.tables["common"])
        near = texts.select("query_id").join(quality.signals(hits), "query_id", "left")
        filled = {"d0": 1.0, "margin": 0.0, "mean10": 1.0, "known_frac": 0.0, "coverage": 0.0}
        return near.join(known, "query_id", "left").join(covered, "query_id", "left").fillna(filled)

    def query(self, queries: DataFrame, k: int = HEADLINE_K, mode: str = "hybrid", rerank: int = 0, encoder: Encoder | None = None, model: C.Calibration | None = None, tier: str = "p") -> DataFrame:
        """``query_id, rank, id, distance, match_quality`` and the record's columns.

        ``queries``: ``query_id, text`` and ``vector``, or an encoder for it.  Blank
        texts are refused.  Hybrid fuses distance and lexical ranks, vector and
        lexical take one order, augmented adds lexical candidates and keeps the
        distance order.  With a model a question it finds unsupported gives no rows.
        """
        check_range("k", k, 1, 1 << 16)
        check_one_of("mode", mode, MODES)
        texts = queries.select("query_id", F.btrim("text").alias("text"))
        texts = texts.where(F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.raise_error(F.lit("INVALID_ARGUMENT: a question has no text"))).otherwise(F.lit(True)))
        if "vector" in queries.columns:
            asked = queries.select("query_id", V.as_double(F.col("vector")).alias("vector"))
        elif encoder is not None:
            asked = encoder(texts.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
        else:
            raise GleaneryError("NO_ENCODER", "questions without vectors need an encoder")
        words = shared_table(lexical.score_floor(self.lexical(texts)), "lexical") if mode != "vector" else None  # candidates, and ranks beside them
        near = self.nearest(asked, k, rerank, words, tier)
        top = near.where(F.col("rank") <= k)
        if mode == "lexical":
            ordered = words.select("query_id", "id", F.col("rank").alias("place")).join(near.drop("rank"), ["query_id", "id"])
            ordered = evaluate.ranked_within(ordered, ["query_id"], [F.col("place")], k).drop("place")
        elif mode == "hybrid":
            ordered = fused(near, words, k)
        else:
            ordered = top
        if model is None:
            judged = ordered.withColumn("match_quality", F.lit("unscored"))
        else:
            verdicts = model.judged(self.signals(texts, top)).select("query_id", F.col("verdict").alias("match_quality"))
            judged = ordered.join(verdicts.where("match_quality <> 'none'"), "query_id")
        return lexical.hydrate(judged.select("query_id", "rank", "id", "distance", "match_quality"), self.tables["records"].drop("digest"), few=True)

    def with_goldens(self, goldens: DataFrame, path: str) -> Pack:
        """The pack with other probes, at ``path``: only these are written, the other tables stay where they are."""
        linked = {name: t for name, t in entries(self.path).items() if name != "goldens"}
        identity = write_dataset({"goldens": goldens.select("text", "expect_id", "expect_title")}, path, self.config, linked)
        return Pack(self.spark, path, identity)

    def verify_goldens(self, encoder: Encoder, k: int = HEADLINE_K, mode: str = "hybrid") -> DataFrame:
        """``text, found, passed``: stored probes asked again; ``found`` is the rank of what was expected."""
        goldens = self.tables["goldens"].withColumn("query_id", F.xxhash64("text", "expect_id", "expect_title"))
        results = self.query(goldens.select("query_id", "text").distinct(), k, mode, encoder=encoder)
        title = F.col("title") if "title" in results.columns else F.lit(None).cast("string")
        met = results.select("query_id", "rank", "id", title.alias("title")).join(goldens.select("query_id", "expect_id", "expect_title"), "query_id")
        match = (F.col("expect_id").isNull() | (F.col("id") == F.col("expect_id"))) & evaluate.meets({"title": F.col("title")}, {"title": F.col("expect_title")})
        matched = evaluate.first_match(goldens, met.select("query_id", "rank", match.alias("match")), ["query_id"])
        return matched.select("text", "found", F.col("found").isNotNull().alias("passed"))

    def verdict(self, encoder: Encoder) -> str:
        """pass, fail or no-tests."""
        found = self.verify_goldens(encoder).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")).first()
        return "no-tests" if not found["n"] else "pass" if found["passed"] == found["n"] else "fail"


#: Probe questions of each kind, made-up questions, and neighbours that signals are read from.
PROBES, GIBBERISH, PROBE_K = 48, 24, 10
FRAMES = ("", "what is known about ", "which ", "is anything said about ")


def _by_hash(df: DataFrame, columns: list[str], seed: int, most: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(most)


def _gibberish(n: int, seed: int) -> list[tuple[str]]:
    draw = C.Sequence(seed)
    pick = lambda low, span: low + min(span - 1, int(draw.next() * span))
    word = lambda: "".join("abcdefghijklmnopqrstuvwxyz"[pick(0, 26)] for _ in range(pick(5, 6)))
    return [(" ".join(word() for _ in range(pick(3, 4))),) for _ in range(n)]


def probes(pack: Pack, seed: int = 0x51F15E) -> DataFrame:
    """``text, source_id, source_title, kind, gibberish``: questions of known answerability, bounded in number.

    Positives ask for titles and for words of retained records.  Easy negatives are
    made-up words; hard ones ask for records that are held out, or mix rare words of
    two records that no record holds together.
    """
    records = pack.tables["records"]
    title = F.btrim(F.coalesce(F.col("title"), F.lit(""))) if "title" in records.columns else F.lit("")
    held = C.hold_out_titles(records.select("id", "text", title.alias("title")))
    kept, out = held.where("not held_out"), held.where("held_out")
    none = lambda kind: F.lit(None).cast(kind)

    def shaped(df: DataFrame, text, kind: str, source_id=None, source_title=None) -> DataFrame:
        source_id = none("long") if source_id is None else F.col(source_id)
        source_title = none("string") if source_title is None else F.col(source_title)
        return df.select(text.alias("text"), source_id.alias("source_id"), source_title.alias("source_title"), F.lit(kind).alias("kind"), F.lit(False).alias("gibberish"))

    frame = F.element_at(F.array(*map(F.lit, FRAMES)), (F.pmod(F.xxhash64("id"), F.lit(len(FRAMES))) + 1).cast("int"))
    words = F.array_distinct(F.filter(T.content_words(F.col("text")), lambda w: F.length(w) >= 4))
    some = lambda df, n, s: _by_hash(df.select("id", "title", words.alias("w")).where(F.size("w") >= 3), ["id"], s, n)
    asked = F.concat(frame, F.array_join(F.slice("w", 1 + F.pmod(F.xxhash64("id", F.lit(2)), F.size("w") - 2).cast("int"), 3), " "))
    by_title = _by_hash(kept.where("title <> ''").select("title").distinct(), ["title"], seed, PROBES)
    positives = shaped(by_title, F.concat(F.lit("what is "), F.lower("title")), "positive", source_title="title").union(shaped(some(kept, PROBES, seed + 1), asked, "positive", source_id="id"))
    hard = shaped(some(out, PROBES // 2, seed + 2), asked, "hard")
    rare = some(kept, 2 * PROBES, seed + 3).select("id", "title", F.explode("w").alias("term")).join(pack.tables["terms"], "term").where(F.col("df") <= max(2, round(0.05 * pack.config["records"])))
    two = rare.groupBy("id", "title").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]), 1, 2).alias("w")).where("size(w) = 2")
    numbered = lambda s, n: two.select("title", "w", F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(s)), "id")).alias("n")).toDF(f"t{n}", f"w{n}", "n")  # noqa: E731  a bounded number of rows
    mixed = numbered(5, "a").join(numbered(6, "b"), "n").where("ta <> tb").select(F.array_distinct(F.concat("wa", "wb")).alias("w")).where("size(w) = 4")
    mixed = mixed.withColumn("m", F.array_join("w", " "))
    together = mixed.select("m", F.explode("w").alias("term")).join(lexical.occurrences(pack.tables), "term").groupBy("m", "id").agg(F.count("*").alias("n")).where("n >= 3").select("m").distinct()
    text = F.array_join(F.array(*(F.get("w", i) for i in (0, 2, 1, 3))), " ")
    mixed = shaped(_by_hash(mixed.join(together, "m", "left_anti"), ["m"], seed + 4, PROBES // 2), text, "hard")
    made_up = pack.spark.createDataFrame(_gibberish(GIBBERISH, seed), "text string")
    easy = shaped(made_up, F.col("text"), "easy").withColumn("gibberish", F.lit(True))
    return positives.union(hard).union(mixed).union(easy).dropDuplicates(["text"])


def calibrated(pack: Pack, encoder: Encoder) -> C.Calibration | None:
    """An abstention model of a pack from probe questions, or None where they can't be told apart.

    All searches leave out the held-out titles.  A positive counts only where its
    source is found; a negative that comes nearer than the middle positive is
    doubtful and leaves the fit.
    """
    asked = shared_table(probes(pack).withColumn("query_id", F.xxhash64("text")), "probes")
    records = pack.tables["records"]
    title = F.btrim(F.coalesce(F.col("title"), F.lit(""))) if "title" in records.columns else F.lit("")
    titles = records.select("id", title.alias("title"))
    kept = C.hold_out_titles(titles).where("not held_out").select("id")
    vectors = encoder(asked.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    hits = shared_table(knn.knn_join(vectors, pack.tables["vectors"].select("id", "vector").join(kept, "id", "left_semi"), PROBE_K, pack.config["metric"]), "probe-hits")
    source = hits.join(titles, "id").join(asked.select("query_id", "source_id", "source_title"), "query_id")
    found = source.groupBy("query_id").agg(F.max(F.coalesce(F.col("id") == F.col("source_id"), F.lit(False)) | F.coalesce(F.col("title") == F.col("source_title"), F.lit(False))).alias("found"))
    rows = pack.signals(asked, hits).join(asked.select("query_id", "text", "kind", "gibberish"), "query_id").join(found, "query_id", "left")
    rows = shared_table(rows.where("kind <> 'positive' or coalesce(found, false)"), "probe-signals")
    middle = quality.floor_quantile(rows.where("kind = 'positive'").select(F.lit(1).alias("g"), "d0"), "g", "d0", 0.5, "d0").first()
    if middle is None:
        return None
    near = (F.col("kind") == "hard") & (F.col("d0") <= middle["d0"]) & (F.col("coverage") >= 0.5)
    label = F.when(F.col("kind") == "positive", 1).when(near, -1).otherwise(0)
    return C.calibrate(rows.withColumn("label", label).withColumn("kind", F.when(near, "weak").otherwise(F.col("kind"))))


def fused(near: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Reciprocal ranks of distances, plus those of lexical hits that are among them; ties to the nearer."""
    part = lambda c: F.lit(1.0) / (F.lit(lexical.RRF) + c - 1)
    both = near.join(words.select("query_id", "id", F.col("rank").alias("place")), ["query_id", "id"], "left")
    score = F.round(part(F.col("rank")) + F.coalesce(part(F.col("place")), F.lit(0.0)), 12)
    return evaluate.ranked_within(both.withColumn("fused", score).drop("rank"), ["query_id"], [F.desc("fused"), F.col("distance"), F.col("id")], k).drop("place", "fused")


@contextlib.contextmanager
def opened(spark: SparkSession, path: str, **options) -> Iterator[Pack]:
    """A pack whose cached tables are let go at the end."""
    pack = Pack(spark, path, **options)
    try:
        yield pack
    finally:
        pack.close()


def fan_out(packs: dict[str, Pack], queries: DataFrame, **options) -> DataFrame:
    """The same questions to several packs; results stay apart by ``pack`` and are never fused."""
    columns = ["query_id", "rank", "id", "distance", "match_quality"]
    found = [p.query(queries, **options).select(F.lit(name).alias("pack"), *columns) for name, p in sorted(packs.items())]
    if not found:
        raise GleaneryError("INVALID_ARGUMENT", "there is no pack to ask")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def provenance(results: DataFrame, pack: str, identity: str) -> DataFrame:
    """Results with where they come from: pack, identity, heading path, anchor and source."""
    have = set(results.columns)
    column = lambda n, kind="string": F.col(n) if n in have else F.lit(None).cast(kind)
    return results.select(
        F.lit(pack).alias("pack"), F.lit(identity).alias("identity"), "query_id", "rank", "id", column("title").alias("title"),
        column("heading_path", "array<string>").alias("heading_path"), column("anchor").alias("anchor"),
        F.coalesce(column("url"), column("source_path")).alias("source"), "distance", "text",
    )


def compile_pack(documents: DataFrame, path: str, encoder: Encoder, kind: str = "markdown", target: int = 256, overlap_percent: int = 15, goldens: DataFrame | None = None, on_stage: Callable[[str], None] | None = None) -> str:
    """From ``doc_id, title, url, source_path, text`` to a pack: sections, chunks, dedupe, numbers, vectors, tables.

    Goldens that the written pack doesn't answer are dropped, and the pack is
    written again without them.
    """
    said = on_stage or (lambda stage: None)
    said("chunk")
    chunks = chunking.chunk_documents(documents, kind, target, overlap_percent)
    numbered = chunking.renumbered(chunks, ["doc_id", "chunk"])
    records = chunking.public_chunks(numbered, documents)
    said("encode")
    vectors = encoder(records.select("id", "text"))
    records = records.join(vectors.select("id"), "id", "left_semi")
    identity = build(records, vectors, f"{path}/draft" if goldens is not None else path, goldens=goldens, on_stage=on_stage)
    if goldens is None:
        return identity
    said("replay")
    draft = Pack(documents.sparkSession, f"{path}/draft", identity)
    passed = draft.verify_goldens(encoder).where("passed").select("text")
    return build(draft.tables["records"].drop("digest"), draft.tables["vectors"].select("id", "vector"), f"{path}/final", goldens=goldens.join(passed, "text", "left_semi"), on_stage=on_stage)
