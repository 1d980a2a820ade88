"""The engine's queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._shared import new_path
from ..functions import text as T
from ..functions import vector as V
from ..operators import calibrate, chunking, encoders, knn, lexical, ordered, quality, sketch
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def rounded(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.select("query_id", "rank", "id", F.round("distance", digits).alias("distance"))


E = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT id AS query_id, v AS qv FROM e WHERE id % 100 = 0)"
COS = "round(1 - greatest(-1, least(1, list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))))), 9)"
L2 = "round(list_distance(qv, v), 9)"
TOP = "SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 10"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank"


def knn_sql(distance: str, where: str = "true") -> str:
    return f"WITH {E}, d AS (SELECT query_id, id, {distance} AS distance FROM q, e WHERE {where}), r AS (SELECT *, {RANK} FROM d) {TOP}"


@query(knn_sql(COS))
def knn_cosine(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return rounded(knn.knn_join(asked(x), x, 10))


@query(knn_sql(L2))
def knn_l2(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return rounded(knn.knn_join(asked(x), x, 10, "l2"))


@query(knn_sql(COS, "label < 5"))
def knn_filtered(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return rounded(knn.knn_join(asked(x), knn.allowed(x, x.where("label < 5")), 10))


@query(knn_sql(COS, "label <> 3"))
def knn_live(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return rounded(knn.knn_join(asked(x), knn.live(x, x.where("label = 3")), 10))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding) AS dim FROM embeddings")
def vector_norms(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.round(V.norm(V.as_double(F.col("vector"))), 6).alias("norm"), F.size("vector").cast("long").alias("dim"))


SPOILT = """(SELECT vec_id AS id, CASE vec_id % 10 WHEN 1 THEN NULL WHEN 2 THEN v[1:63] WHEN 3 THEN list_prepend('inf'::DOUBLE, v[2:64]) WHEN 4 THEN list_transform(v, lambda x: 0::DOUBLE)
  WHEN 5 THEN list_prepend(NULL::DOUBLE, v[2:64]) WHEN 6 THEN list_prepend('nan'::DOUBLE, v[2:64]) ELSE v END AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))"""


def spoilt(spark, sf_dir) -> DataFrame:
    """The vectors, six of ten in a way that validation must see."""
    v, last = V.as_double(F.col("vector")), F.col("id") % 10
    head = lambda x: F.concat(F.array(F.lit(x).cast("double")), F.slice(v, 2, 63))
    bad = F.when(last == 1, F.lit(None)).when(last == 2, F.slice(v, 1, 63)).when(last == 3, head(float("inf"))).when(last == 4, F.transform(v, lambda x: F.lit(0.0)))
    return corpus(spark, sf_dir).select("id", bad.when(last == 5, head(None)).when(last == 6, head(float("nan"))).otherwise(v).alias("vector"))


@query(f"""SELECT CASE WHEN v IS NULL THEN 'missing' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'null_component' WHEN len(v) <> 64 THEN 'dimension'
  WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 'norm' ELSE 'ok' END AS verdict, count(*) AS n FROM {SPOILT} GROUP BY 1""")
def vector_validate(spark, sf_dir):
    usable, rejected = knn.split_vectors(spoilt(spark, sf_dir), "vector", 64)
    verdicts = usable.select(F.lit("ok").alias("verdict")).union(rejected.select("reason"))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


CODE = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 b AS (SELECT id, v, list_min(v) AS lo, CASE WHEN list_max(v) - list_min(v) < 1e-30 THEN 1.0 ELSE list_max(v) - list_min(v) END AS span FROM e),
 c AS (SELECT id, v, lo AS off, span / 255 AS scale, list_transform(v, lambda x: floor(least(255.0, greatest(0.0, (x - lo) * 255 / span + 0.5)))::INTEGER) AS code FROM b)"""


@query(f"WITH {CODE} SELECT id, round(scale, 9) AS scale, round(off, 9) AS code_offset, list_sum(code)::BIGINT AS sum_q, list_sum(list_transform(code, lambda x: x * x))::BIGINT AS sum_q2 FROM c")
def quantize_u8_stats(spark, sf_dir):
    coded = sketch.quantized(corpus(spark, sf_dir))
    return coded.select("id", F.round("scale", 9).alias("scale"), F.round("offset", 9).alias("code_offset"), "sum_q", "sum_q2")


@query(f"""WITH {CODE}, d AS (SELECT a.id AS query_id, c.id,
  round(1 - greatest(-1, least(1, (c.off * list_sum(a.v) + c.scale * list_dot_product(a.v, list_transform(c.code, lambda x: x::DOUBLE)))
   / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_sum(list_transform(c.code, lambda x: (c.off + c.scale * x) * (c.off + c.scale * x))))))), 9) AS distance
  FROM c a, c WHERE a.id % 100 = 0), r AS (SELECT *, {RANK} FROM d) {TOP}""")
def quantized_search(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coded = sketch.quantized(x).select("id", V.dequantize(F.col("q"), F.col("scale"), F.col("offset")).alias("vector"))
    return rounded(knn.knn_join(asked(x), coded, 10))


@query(f"""WITH {CODE}, s AS (SELECT id, off, scale, code, list_sum(code)::DOUBLE AS sq, list_sum(list_transform(code, lambda x: x * x))::DOUBLE AS sq2 FROM c),
 p AS (SELECT a.id AS query_id, b.id AS id, a.off AS ao, a.scale AS sa, a.sq AS aq, a.sq2 AS aq2, b.off AS bo, b.scale AS sb, b.sq AS bq, b.sq2 AS bq2,
   list_dot_product(list_transform(a.code, lambda x: x::DOUBLE), list_transform(b.code, lambda x: x::DOUBLE)) AS dot FROM s a, s b WHERE a.id % 100 = 0 AND b.id <> a.id),
 d AS (SELECT query_id, id, round(sqrt(greatest(0, 64 * (ao - bo) * (ao - bo) + 2 * (ao - bo) * (sa * aq - sb * bq) + sa * sa * aq2 + sb * sb * bq2 - 2 * sa * sb * dot)), 6) AS distance FROM p),
 r AS (SELECT *, {RANK} FROM d) {TOP}""")
def symmetric_distance(spark, sf_dir):
    return coded_pairs(spark, sf_dir, "l2", V.symmetric_l2)


def coded_pairs(spark, sf_dir, metric, closed):
    """The 10 nearest by a closed form over codes, among the 40 nearest dequantised rows."""
    coded = sketch.quantized(corpus(spark, sf_dir))
    plain = coded.select("id", V.dequantize(F.col("q"), F.col("scale"), F.col("offset")).alias("vector"))
    hits = knn.knn_join(asked(plain), plain, 40, metric, self_hits=False).select("query_id", "id")
    of = lambda key, name: coded.select(F.col("id").alias(key), F.struct("q", "scale", "offset", "sum_q", "sum_q2").alias(name))
    pairs = hits.join(of("id", "b"), "id").join(of("query_id", "a"), "query_id")
    return knn.top_k(pairs.select("query_id", "id", F.round(closed(F.col("a"), F.col("b")), 6).alias("distance")), 10)


POOL = CODE + """, p AS (SELECT id, scale, off, list_transform(range(0, 32), lambda i: floor((code[2*i+1] + code[2*i+2]) / 2.0 + 0.5)::INTEGER) AS pool FROM c)"""


@query(f"WITH {POOL} SELECT id, array_to_string(pool, ',') AS pool FROM p")
def sketch8_pool(spark, sf_dir):
    return sketch.quantized(corpus(spark, sf_dir)).select("id", F.array_join(V.pooled(F.col("q"), 32, 2).cast("array<string>"), ",").alias("pool"))


@query(f"WITH {POOL} SELECT id, array_to_string(list_transform(pool, lambda x: least(15, floor(x / 17.0 + 0.5)::INTEGER)), ',') AS pool FROM p")
def sketch4_pool(spark, sf_dir):
    pool = V.nibbles(V.pooled(F.col("q"), 32, 2))
    return sketch.quantized(corpus(spark, sf_dir)).select("id", F.array_join(pool.cast("array<string>"), ",").alias("pool"))


SKETCH = POOL + """, k AS (SELECT id, list_transform(pool, lambda x: off + scale * 17 * least(15, floor(x / 17.0 + 0.5)::INTEGER)) AS sv FROM p),
 qq AS (SELECT id AS query_id, v AS qv, list_transform(range(0, 32), lambda i: (v[2*i+1] + v[2*i+2]) / 2) AS pv FROM e WHERE id % 100 = 0),
 cd AS (SELECT query_id, k.id, qv, round(list_distance(pv, sv), 9) AS cdist FROM qq, k),
 cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cdist, id) AS crank FROM cd)"""


@query(f"WITH {SKETCH}, d AS (SELECT query_id, cr.id, {L2} AS distance FROM cr JOIN e ON e.id = cr.id WHERE crank <= 100), r AS (SELECT *, {RANK} FROM d) {TOP}")
def sketch_rerank(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coarse = sketch.candidates(asked(x), sketch.sketches(sketch.quantized(x), 32, 2, 4), 32, 2, 100)
    return rounded(sketch.rerank(asked(x), x, coarse, 10))


@query(f"""WITH {SKETCH}, t AS (SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(qv, v), 9), e.id) AS rank FROM qq, e),
 l AS (SELECT unnest([10, 20, 40, 80, 160, 320]) AS depth), h AS (SELECT depth, t.query_id, avg(CASE WHEN crank <= depth THEN 1.0 ELSE 0.0 END) AS r
  FROM t JOIN cr USING (query_id, id), l WHERE t.rank <= 10 GROUP BY 1, 2) SELECT depth, round(avg(r), 6) AS recall FROM h GROUP BY depth""")
def rerank_sweep(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coarse = sketch.candidates(asked(x), sketch.sketches(sketch.quantized(x), 32, 2, 4), 32, 2, 320)
    found = sketch.recall_by_depth(coarse, knn.knn_join(asked(x), x, 10, "l2"), [10, 20, 40, 80, 160, 320])
    return found.select("depth", F.round("recall", 6).alias("recall"))


@query(f"""WITH {SKETCH}, t AS (SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(qv, v), 9), e.id) AS rank FROM qq, e)
 SELECT t.query_id, avg(CASE WHEN crank <= 10 THEN 1.0 ELSE 0.0 END) AS recall FROM t JOIN cr USING (query_id, id) WHERE rank <= 10 GROUP BY 1""")
def recall_at_k(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coarse = sketch.candidates(asked(x), sketch.sketches(sketch.quantized(x), 32, 2, 4), 32, 2, 10)
    return knn.recall(coarse, knn.knn_join(asked(x), x, 10, "l2"))


@query(f"WITH {E}, d AS (SELECT query_id, id, {COS} AS distance FROM q, e), r AS (SELECT *, {RANK} FROM d) SELECT query_id, min(CASE WHEN id = query_id THEN rank END)::INTEGER AS self_rank FROM r WHERE rank <= 5 GROUP BY 1")
def self_recall(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return knn.self_recall(x, x.where("id % 100 = 0"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: len(w) BETWEEN 2 AND 32)"
TOKS = f"list_filter({TOK}, lambda w: NOT list_contains({STOP}, w))"


@query(f"SELECT doc_id, coalesce(len({TOK}), 0)::BIGINT AS n_tokens, coalesce(len(list_distinct({TOK})), 0)::BIGINT AS n_terms FROM documents")
def tokenize_counts(spark, sf_dir):
    tokens = T.lexical_tokens(F.col("text"))
    return docs(spark, sf_dir).select(F.col("id").alias("doc_id"), F.coalesce(F.size(tokens), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.array_distinct(tokens)), F.lit(0)).cast("long").alias("n_terms"))


@query(f"SELECT count(*) AS n, sum(len({TOKS}))::BIGINT AS total, round(sum(len({TOKS})) / count(*)::DOUBLE, 6) AS avgdl FROM documents")
def doc_lengths(spark, sf_dir):
    lengths = lexical.doc_lengths(docs(spark, sf_dir))
    return lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.sum("dl") / F.count("*"), 6).alias("avgdl"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def term_df(spark, sf_dir):
    return lexical.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


BM25 = f"""qt AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
 tok AS (SELECT doc_id AS id, {TOKS} AS ts FROM documents), dl AS (SELECT id, len(ts)::DOUBLE AS dl FROM tok),
 st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS total FROM dl),
 po AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(ts) AS term FROM tok) GROUP BY 1, 2), df AS (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY 1),
 sc AS (SELECT query_id, po.id, round(sum(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE)
   / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(1::DOUBLE, total / n)))), 6) AS score
  FROM qt JOIN df USING (term) JOIN po USING (term) JOIN dl ON dl.id = po.id, st GROUP BY 1, 2),
 lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""


def lexical_hits(spark, sf_dir, n=24):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25(items, docs(spark, sf_dir), n)


@query(f"WITH {BM25} SELECT query_id, rank::INTEGER AS rank, id, score FROM lx WHERE rank <= 24")
def bm25_topn(spark, sf_dir):
    return lexical_hits(spark, sf_dir)


@query(f"WITH {BM25}, b AS (SELECT query_id, max(score) AS best FROM lx WHERE rank <= 24 GROUP BY 1) SELECT query_id, rank::INTEGER AS rank, id, score FROM lx JOIN b USING (query_id) WHERE rank <= 24 AND score >= best / 3")
def lexical_mode(spark, sf_dir):
    return lexical.score_floor(lexical_hits(spark, sf_dir))


HASHED = """(SELECT id, b, sum(2 * v - 255)::BIGINT AS s FROM (SELECT id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 64 AS b, ('0x' || h[9:10])::BIGINT AS v
  FROM (SELECT id, sha256(w) AS h FROM (SELECT {id} AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {table}))) GROUP BY 1, 2)"""


@query("SELECT id AS doc_id, b AS bucket, s AS cell FROM " + HASHED.format(id="doc_id", table="documents"))
def hash_embedding(spark, sf_dir):
    return encoders.hash_cells(docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("b").alias("bucket"), F.col("s").alias("cell"))


hash_vectors = encoders.hash_encoder(64)
VEC = "vd AS (SELECT id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)::DOUBLE) AS v FROM (SELECT id, map(list(b), list(s)) AS m FROM " + HASHED.format(id="doc_id", table="documents") + " GROUP BY id)), vq AS (SELECT id AS query_id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)::DOUBLE) AS qv FROM (SELECT id, map(list(b), list(s)) AS m FROM " + HASHED.format(id="item_id", table="benchmark") + f" GROUP BY id)), vh AS (SELECT *, {RANK} FROM (SELECT query_id, id, {COS} AS distance FROM vq, vd WHERE list_dot_product(v, v) > 0))"


def vector_hits(spark, sf_dir, k=24):
    q = hash_vectors(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    return knn.knn_join(q, hash_vectors(docs(spark, sf_dir)), k)


@query(f"""WITH {BM25}, {VEC}, bs AS (SELECT query_id, max(score) AS best FROM lx WHERE rank <= 24 GROUP BY 1), l AS (SELECT lx.* FROM lx JOIN bs USING (query_id) WHERE rank <= 24 AND score >= best / 3),
 f AS (SELECT query_id, id, round(coalesce(1 / (60::DOUBLE + a.rank - 1), 0) + coalesce(1 / (60::DOUBLE + b.rank - 1), 0), 9) AS fused FROM (SELECT * FROM vh WHERE rank <= 24) a FULL JOIN l b USING (query_id, id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM f) SELECT query_id, rank::INTEGER AS rank, id, fused FROM r WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    return lexical.rrf(vector_hits(spark, sf_dir), lexical.score_floor(lexical_hits(spark, sf_dir)), 10)


@query(f"WITH {BM25}, {VEC} SELECT query_id, count(*) AS n, sum(id)::BIGINT AS id_sum FROM (SELECT query_id, id FROM vh WHERE rank <= 24 UNION SELECT query_id, id FROM lx WHERE rank <= 24) GROUP BY 1")
def augmented_candidates(spark, sf_dir):
    return lexical.augmented(vector_hits(spark, sf_dir), lexical_hits(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


NORM = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\r', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
WORDS = "list_filter(string_split_regex(" + NORM.format("text") + ", '\\s+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 256) / 218.0))::BIGINT + 1)) AS chunk FROM t WHERE len(ws) >= 25),
 w AS (SELECT doc_id, chunk, ws[(chunk * 218 + 1):(chunk * 218 + 256)] AS part FROM c) SELECT doc_id, chunk, len(part) AS n_tokens, sha256(array_to_string(part, ' ')) AS text_sha FROM w""")
def chunk_windows(spark, sf_dir):
    return chunking.token_windows(table(spark, sf_dir, "documents")).select("doc_id", "chunk", "n_tokens", F.sha2("text", 256).alias("text_sha"))


@query(f"SELECT * FROM (SELECT doc_id, len({WORDS}) AS tokens FROM documents) WHERE tokens < 25")
def short_doc_drop(spark, sf_dir):
    return chunking.short_documents(table(spark, sf_dir, "documents"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha, count(*) AS copies FROM documents GROUP BY 2")
def dedupe_exact(spark, sf_dir):
    return chunking.first_of_equal_texts(table(spark, sf_dir, "documents"))


ENT = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


@query("SELECT page_id, " + NORM.format(ENT.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")) + """ AS title,
 len(regexp_extract_all(html, 'href\\s*=\\s*"([^"]*)"', 1, 'i'))::BIGINT AS n_links, coalesce(array_to_string(regexp_extract_all(html, 'href\\s*=\\s*"([^"]*)"', 1, 'i'), ' '), '') AS links FROM pages""")
def html_title_links(spark, sf_dir):
    links = T.html_links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


def _html_text_sql() -> str:
    body = "coalesce(" + ", ".join(f"nullif(regexp_extract(html, '<{t}[^>]*>(.*?)</{t}>', 1, 'is'), '')" for t in ("main", "article", "body")) + ", html)"
    for tag in T.CHROME:
        body = f"regexp_replace({body}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    body = f"regexp_replace(regexp_replace({body}, '<br\\s*/?>', chr(10), 'gi'), '</(p|li|div|tr|pre)>', chr(10), 'gi')"
    return f"SELECT page_id, {NORM.format(ENT.format(f"regexp_replace({body}, '<[^>]+>', ' ', 'g')"))} AS text FROM pages"


@query(_html_text_sql())
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


SLUG = "replace(regexp_replace(lower(trim({}, ' ')), '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' ', '-')"


@query(f"""WITH h AS (SELECT doc_id, generate_subscripts(ls, 1) AS position, unnest(ls) AS heading FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
 b AS (SELECT doc_id, position, {SLUG.format('heading')} AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY position) - 1 AS n FROM b)
 SELECT doc_id, count(*) AS n_slugs, sha256(string_agg(CASE WHEN n = 0 THEN base ELSE base || '-' || n END, chr(10) ORDER BY position)) AS slugs_sha FROM n GROUP BY 1""")
def slug_dedupe(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "heading"))
    slugs = chunking.unique_slugs(lines)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "slug"))), lambda x: x["slug"]), "\n")
    return slugs.groupBy("doc_id").agg(F.count("*").alias("n_slugs"), F.sha2(ordered, 256).alias("slugs_sha"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(p, '\\.(md|mdx|html|txt)$', '', 'i'), '(^|/)[0-9]+-', '\\1', 'g'), '/+$', '') AS route
 FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1), '(^|/)(index|readme)$', '\\1', 'i') AS p FROM pages)""")
def route_map(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.route(path).alias("route"))


@query("SELECT doc_id, sha256(doc_id || chr(31) || coalesce(text, '') || chr(31) || coalesce(source, '')) AS digest FROM documents")
def record_digest(spark, sf_dir):
    row = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(row, 256).alias("digest"))


@query("SELECT doc_id // 256 AS page, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def page_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda x: x["d"]), "")
    return rows.groupBy(F.expr("doc_id div 256").alias("page")).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


FNV = "list_reduce(list_prepend({}::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)) * 16777619) % 4294967296)"


@query(f"""WITH t AS (SELECT DISTINCT unnest({TOK}) AS term FROM documents), h AS (SELECT term, {FNV.format(0x811C9DC5, 'term')} AS h0, {FNV.format(0x811C9DC5 ^ 0x9E3779B9, 'term')} AS h1 FROM t)
 SELECT term, h0, h1, ((CASE WHEN h0 >= 2147483648 THEN h0 - 4294967296 ELSE h0 END) * 4294967296 + h1)::BIGINT AS term_key FROM h""")
def fnv1a_hash(spark, sf_dir):
    terms = docs(spark, sf_dir).select(F.explode(T.lexical_tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.fnv1a(F.col("term")).alias("h0"), T.fnv1a(F.col("term"), 0x9E3779B9).alias("h1"), T.term_key(F.col("term")).alias("term_key"))


ALL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')"


@query(f"""WITH v AS (SELECT term FROM (SELECT unnest({ALL}) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 3),
 z AS (SELECT least(2097152, greatest(16384, pow(2, ceil(log2(32 * greatest(1, count(*)))))))::BIGINT AS bits FROM v),
 f AS (SELECT DISTINCT unnest([{FNV.format(0x811C9DC5, 'term')} % bits, {FNV.format(0x811C9DC5 ^ 0x9E3779B9, 'term')} % bits]) AS bit FROM v, z),
 k AS (SELECT item_id, unnest({ALL}) AS term FROM benchmark),
 p AS (SELECT term, {FNV.format(0x811C9DC5, 'term')} % bits AS b0, {FNV.format(0x811C9DC5 ^ 0x9E3779B9, 'term')} % bits AS b1 FROM (SELECT DISTINCT term FROM k), z)
 SELECT item_id, round(avg(CASE WHEN b0 IN (SELECT bit FROM f) AND b1 IN (SELECT bit FROM f) THEN 1.0 ELSE 0.0 END), 6) AS known_frac FROM k JOIN p USING (term) GROUP BY 1""")
def bloom_known_frac(spark, sf_dir):
    tokens = docs(spark, sf_dir).select(F.explode(T.all_tokens(F.col("text"))).alias("term"))
    kept = tokens.groupBy("term").agg(F.count("*").alias("n")).where("n >= 3")
    bits = T.bloom_bits(kept.count())
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.all_tokens(F.col("text"))).alias("term"))
    known = calibrate.known_words(words, calibrate.bloom_filter(kept, bits), bits, ["item_id"])
    return known.groupBy("item_id").agg(F.round(F.avg(F.col("known").cast("double")), 6).alias("known_frac"))


SIG = f"""WITH {E}, d AS (SELECT query_id, id, {COS} AS distance FROM q, e WHERE id <> query_id), r AS (SELECT *, {RANK} FROM d),
 s AS (SELECT query_id, min(distance) AS d0, max(CASE WHEN rank = 5 THEN distance END) - min(distance) AS margin, avg(distance) AS mean10 FROM r WHERE rank <= 10 GROUP BY 1)"""


def _signals(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return quality.signals(knn.knn_join(asked(x), x, 10, self_hits=False))


@query(f"{SIG} SELECT query_id, round(d0, 6) AS d0, round(margin, 6) AS margin, round(mean10, 6) AS mean10 FROM s")
def retrieval_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", *(F.round(c, 6).alias(c) for c in ("d0", "margin", "mean10")))


@query(f"""{SIG}, z AS (SELECT query_id, 1 / (1 + exp(-(4 - 8 * d0 + 2 * margin - 1 * mean10))) AS p FROM s)
 SELECT query_id, round(p, 6) AS p, CASE WHEN p < 0.4 THEN 'abstain' WHEN p < 0.6 THEN 'weak' ELSE 'answer' END AS verdict FROM z""")
def abstain_verdict(spark, sf_dir):
    p, verdict = quality.verdict(F.lit(4.0) - 8 * F.col("d0") + 2 * F.col("margin") - F.col("mean10"), 0.4, 0.6)
    return _signals(spark, sf_dir).select("query_id", F.round(p, 6).alias("p"), verdict.alias("verdict"))


ASKED = "[" + ", ".join(f"'{w}'" for w in T.QUESTION_WORDS) + "]"
CONTENT = f"list_filter({ALL}, lambda w: len(w) >= 3 AND NOT list_contains({ASKED}, w))"


@query(f"""WITH {BM25}, hit AS (SELECT query_id, id FROM lx WHERE rank <= 5),
 m AS (SELECT w FROM (SELECT DISTINCT doc_id, unnest({CONTENT}) AS w FROM documents) GROUP BY 1 HAVING count(*) > greatest(4, floor((SELECT count(*) FROM documents) * 0.05::DOUBLE + 0.5::DOUBLE))),
 c AS (SELECT query_id, w, n * (CASE WHEN w IN (SELECT w FROM m) THEN 1::DOUBLE / 3 ELSE 1::DOUBLE END) AS weight FROM (SELECT item_id AS query_id, w, count(*) AS n FROM (SELECT item_id, unnest({CONTENT}) AS w FROM benchmark) GROUP BY 1, 2)),
 p AS (SELECT query_id, id, list_distinct({ALL}) AS ws FROM hit JOIN documents ON doc_id = id),
 g AS (SELECT query_id, id, sum(weight) AS g FROM c JOIN p USING (query_id) WHERE list_contains(ws, w) OR list_contains(ws, w || 's') OR list_contains(ws, w || 'es') OR (w LIKE '%s' AND list_contains(ws, w[:-2])) GROUP BY 1, 2),
 b AS (SELECT query_id, max(g) AS g FROM g GROUP BY 1), t AS (SELECT query_id, sum(weight) AS total FROM c GROUP BY 1)
 SELECT query_id, round(coalesce(g, 0) / total, 6) AS coverage FROM t LEFT JOIN b USING (query_id)""")
def coverage_frac(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.content_words(F.col("text"))).alias("w"))
    texts = docs(spark, sf_dir)
    passages = lexical.hydrate(lexical_hits(spark, sf_dir, 5).select("query_id", "id"), texts, few=True)
    found = calibrate.coverage(items, passages, calibrate.common_words(calibrate.word_counts(texts), texts.count()))
    return found.select("query_id", F.round("coverage", 6).alias("coverage"))


@query("""WITH s AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), p AS (SELECT s FROM s WHERE y = 1), m AS (SELECT s FROM s WHERE y = 0)
 SELECT round((SELECT avg(CASE WHEN p.s > m.s THEN 1.0 WHEN p.s = m.s THEN 0.5 ELSE 0.0 END) FROM p, m), 6) AS auc, (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM m) AS n_neg""")
def auc_pairs(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    found = quality.auc(scored, "n_chars", "quality")
    return found.select(F.round("auc", 6).alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


@query(f"WITH {BM25} SELECT query_id, rank::INTEGER AS rank, id, lang, coalesce(source, 'unknown') AS source, left(d.text, 220) AS preview, coalesce(quality, -1) AS quality FROM lx JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id WHERE rank <= 5")
def hydrate_provenance(spark, sf_dir):
    records = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").withColumn("rank", F.lit(None))
    full = lexical.hydrate(lexical.hydrate(lexical_hits(spark, sf_dir, 5), records, few=True), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), few=True)
    return full.select("query_id", "rank", "id", "lang", F.coalesce("source", F.lit("unknown")).alias("source"), F.substring("text", 1, 220).alias("preview"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark, sf_dir):
    return live.request_windows(table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT event_id, user_id, n, true AS accepted, [us] AS held FROM e WHERE n = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.n, len(list_filter(held, lambda t: us - t < 3600000000)) < 2,
   CASE WHEN len(list_filter(held, lambda t: us - t < 3600000000)) < 2 THEN list_append(list_filter(held, lambda t: us - t < 3600000000), us) ELSE list_filter(held, lambda t: us - t < 3600000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, user_id, accepted FROM r""")
def rate_limit(spark, sf_dir):
    return live.rate_limited(table(spark, sf_dir, "events"), 2, 3_600)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
 SELECT user_id, event_id, event_type, value FROM r WHERE n = 1 AND event_type <> 'error'""")
def stream_upsert_compact(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    folder = new_path(spark, "live")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("deleted", F.col("event_type") == "error")
    state = live.LiveTable(spark, f"{folder}/table", "user_id", ["ts", "event_id"])
    live.ingest(stream, state, f"{folder}/checkpoint")
    state.compact()
    return state.live().select("user_id", "event_id", "event_type", "value")


@query("""SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS ids FROM (SELECT source, doc_id, sum(g) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM
 (SELECT source, doc_id, CASE WHEN doc_id - lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) <= 8 THEN 0 ELSE 1 END AS g FROM documents)) GROUP BY source, run""")
def id_runs(spark, sf_dir):
    return ordered.runs(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 8)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, max(CASE WHEN i = least(n - 1, floor(n * 0.9::DOUBLE)) THEN value END) AS p90, max(CASE WHEN i = least(n - 1, floor(n * 0.5::DOUBLE)) THEN value END) AS median FROM r GROUP BY 1""")
def floor_quantiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return quality.floor_quantile(events, "event_type", "value", 0.9, "p90").join(quality.floor_quantile(events, "event_type", "value", 0.5, "median"), "event_type")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1), '^/en/[^/]*$')")
def path_glob(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1)
    return table(spark, sf_dir, "pages").where(path.rlike(T.glob_regex("/en/*"))).select("page_id", "url")


@query(f"SELECT conv_id, turn, CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT conv_id, turn, {FNV.format(0x811C9DC5, 'conv_id::VARCHAR')} % 10 AS h FROM conversations)")
def fnv_split(spark, sf_dir):
    h = T.fnv1a(F.col("conv_id").cast("string")) % 10
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(h < 6, "train").when(h < 8, "val").otherwise("test").alias("split"))


@query(None)
def section_chunks(spark, sf_dir):
    return chunking.chunk_markdown(table(spark, sf_dir, "documents"))
