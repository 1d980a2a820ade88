"""More of the engine's queries: codes, packs, approximate search, evaluation, ingestion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .._shared import new_path, shared_table
from ..functions import text as T
from ..functions import vector as V
from ..operators import calibrate, chunking, encoders, evaluate, ivf, knn, lexical, ordered, sketch
from . import catalog as base
from .catalog import ALL, BM25, CODE, COS, E, FNV, L2, POOL, RANK, SKETCH, TOK, TOKS, TOP, VEC, asked, corpus, docs, hash_vectors, query, rounded, table
from .pack import Pack, build

# codes


@query(f"""WITH {CODE}, d AS (SELECT a.id AS query_id, c.id, round(sqrt(list_sum(list_transform(list_zip(a.v, c.code), lambda z: (z[1] - (c.off + c.scale * z[2])) ** 2))), 6) AS distance
  FROM c a, c WHERE a.id % 100 = 0), r AS (SELECT *, {RANK} FROM d) {TOP}""")
def asymmetric_l2(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coded = sketch.quantized(x)
    plain = coded.select("id", V.dequantize(F.col("q"), F.col("scale"), F.col("offset")).alias("vector"))
    pairs = knn.knn_join(asked(x), plain, 40, "l2").select("query_id", "id").join(coded, "id")
    pairs = pairs.join(asked(x).select("query_id", V.as_double(F.col("vector")).alias("y")), "query_id")
    closed = V.asymmetric_l2(F.col("y"), F.col("q"), F.col("scale"), F.col("offset"), F.col("sum_q"), F.col("sum_q2"))
    return knn.top_k(pairs.select("query_id", "id", F.round(closed, 6).alias("distance")), 10)


@query(f"""WITH {CODE}, x AS (SELECT id, list_transform(code, lambda q: off + scale * q) AS v FROM c), q AS (SELECT id AS query_id, v AS qv FROM x WHERE id % 100 = 0),
 d AS (SELECT query_id, id, round({COS}, 6) AS distance FROM q, x WHERE id <> query_id), r AS (SELECT *, {RANK} FROM d) {TOP}""")
def symmetric_cosine(spark, sf_dir):
    return base.coded_pairs(spark, sf_dir, "cosine", V.symmetric_cosine)


@query(f"WITH {CODE} SELECT id, array_to_string(list_transform(range(0, 16), lambda i: floor(list_sum(code[4*i+1:4*i+4]) / 4.0 + 0.5)::INTEGER), ',') AS micro FROM c")
def micro_pool(spark, sf_dir):
    return sketch.quantized(corpus(spark, sf_dir)).select("id", F.array_join(V.micro(F.col("q"), 32, 2, 16).cast("array<string>"), ",").alias("micro"))


@query(f"""WITH {E}, s AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e)
 SELECT id, round(scale, 9) AS scale, array_to_string(list_transform(v, lambda x: round_even(x / scale, 0)::INTEGER), ',') AS q FROM s""")
def int8_rows(spark, sf_dir):
    coded = V.int8_row(V.as_double(F.col("vector")))
    return corpus(spark, sf_dir).select("id", coded.alias("c")).select("id", F.round("c.scale", 9).alias("scale"), F.array_join(F.col("c.q").cast("array<string>"), ",").alias("q"))


@query(f"WITH {E} SELECT id, round(list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v))) ** 2)), 6) AS square, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e")
def unit_vectors(spark, sf_dir):
    unit = corpus(spark, sf_dir).select("id", V.l2_normalize(V.as_double(F.col("vector"))).alias("u"))
    return unit.select("id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("square"), F.round(F.get("u", 0), 6).alias("first"))


# approximate search: the answers depend on centroids, recall is tested


def _lists(spark, sf_dir, lists=16):
    x = corpus(spark, sf_dir)
    centroids = ivf.train(x, lists)
    return x, centroids, ivf.assigned(x, centroids)


@query(None)
def ivf_search(spark, sf_dir):
    x, centroids, lists = _lists(spark, sf_dir)
    return rounded(ivf.ivf_join(asked(x), lists, centroids, 10, 10))


@query(None)
def ivf_filtered(spark, sf_dir):
    x, centroids, lists = _lists(spark, sf_dir)
    return rounded(ivf.ivf_join(asked(x), lists, centroids, 10, 10, allowed=x.where("label < 5")))


@query(f"WITH {E}, d AS (SELECT query_id, id, {COS} AS distance FROM q, e), r AS (SELECT *, {RANK} FROM d) {TOP}")
def ivf_all_lists(spark, sf_dir):
    x, centroids, lists = _lists(spark, sf_dir, 8)
    return rounded(ivf.ivf_join(asked(x), lists, centroids, 10, 8))


@query(None)
def cluster_layout(spark, sf_dir):
    """Rows in the order of their lists' chain, and the reads that fetch each query's neighbours there."""
    x, centroids, lists = _lists(spark, sf_dir)
    placed = chunking.dense_ids(ivf.laid_out(lists, centroids).select("id", "place"), ["place", "id"], "position")
    return ivf.coalesced(knn.knn_join(asked(x), x, 10), placed, 8)


@query(f"""WITH {E}, d AS (SELECT query_id, id, {COS} AS distance FROM q, e), r AS (SELECT *, {RANK} FROM d), p AS (SELECT query_id, id, id - lag(id) OVER (PARTITION BY query_id ORDER BY id) - 1 AS skipped FROM r WHERE rank <= 10)
 SELECT query_id, count(*) FILTER (skipped IS NULL OR skipped > 20) AS ranges, coalesce(sum(skipped) FILTER (skipped <= 20), 0)::BIGINT AS filler FROM p GROUP BY 1""")
def coalesced_reads(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return ivf.coalesced(knn.knn_join(asked(x), x, 10), x.select("id", F.col("id").alias("position")), 20)


@query(None)
def diverse_neighbours(spark, sf_dir):
    x = corpus(spark, sf_dir)
    return rounded(knn.diverse(asked(x), knn.knn_join(asked(x), x, 40), x, 10))


@query("WITH " + VEC.split(", vq AS")[0] + f""", q AS (SELECT id AS query_id, v AS qv FROM vd WHERE id % 100 = 0), h AS (SELECT query_id, id, {COS} AS distance FROM q, vd WHERE id <> query_id AND list_dot_product(v, v) > 0 AND list_dot_product(qv, qv) > 0),
 r AS (SELECT *, {RANK} FROM h) SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5 AND distance <= 0.2""")
def near_duplicate_knn(spark, sf_dir):
    x = shared_table(hash_vectors(docs(spark, sf_dir)), "vectors")  # questions and rows
    return rounded(knn.knn_join(asked(x), x, 5, self_hits=False).where("distance <= 0.2"))


@query(f"""WITH {SKETCH}, t AS (SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY {L2}, e.id) AS rank FROM qq, e)
 SELECT query_id, count(*) FILTER (crank <= 10) / 10.0::DOUBLE AS overlap FROM t JOIN cr USING (query_id, id) WHERE rank <= 10 GROUP BY 1""")
def encoder_overlap(spark, sf_dir):
    x = corpus(spark, sf_dir)
    coarse = sketch.candidates(asked(x), sketch.sketches(sketch.quantized(x), 32, 2, 4), 32, 2, 10)
    return evaluate.overlap(knn.knn_join(asked(x), x, 10, "l2"), coarse, 10)


# packs

PACKED = f"""{BM25}, {VEC.split(", vq AS")[0]}, {"vq AS" + VEC.split(", vq AS")[1].split(", vh AS")[0]},
 un AS (SELECT id, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vd WHERE list_dot_product(v, v) > 0),
 bb AS (SELECT id, v, u, list_min(u) AS lo, CASE WHEN list_max(u) - list_min(u) < 1e-30 THEN 1.0 ELSE list_max(u) - list_min(u) END AS span FROM un),
 cc AS (SELECT id, v, lo AS off, span / 255 AS scale, list_transform(u, lambda x: floor(least(255.0, greatest(0.0, (x - lo) * 255 / span + 0.5)))::INTEGER) AS code FROM bb),
 pp AS (SELECT id, v, list_transform(range(0, 32), lambda i: off + scale * 17 * least(15, floor(floor((code[2*i+1] + code[2*i+2]) / 2.0 + 0.5) / 17.0 + 0.5)::INTEGER)) AS sv FROM cc),
 pq AS (SELECT query_id, qv, list_transform(range(0, 32), lambda i: 2 * ((qv[2*i+1] + qv[2*i+2]) / sqrt(list_dot_product(qv, qv)) / 2)) AS pv FROM vq WHERE list_dot_product(qv, qv) > 0),
 cs AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - greatest(-1, least(1, list_dot_product(pv, sv))), 9), id) AS crank FROM pq, pp),
 lf AS (SELECT l.* FROM lx l JOIN (SELECT query_id, max(score) AS best FROM lx WHERE rank <= 24 GROUP BY 1) USING (query_id) WHERE rank <= 24 AND score >= best / 3),
 cand AS (SELECT query_id, id FROM cs WHERE crank <= 100 {{extras}}),
 near AS (SELECT *, {RANK} FROM (SELECT query_id, id, {COS} AS distance FROM cand JOIN pq USING (query_id) JOIN pp USING (id)))"""
EXTRAS = "UNION SELECT query_id, id FROM lf"


def _built(spark, sf_dir) -> Pack:
    """A pack of the documents and their hash vectors, in the shared folder.

    Each query writes its own: a pack kept by its path would be an old one once the tables there have changed.
    """
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.coalesce("source", F.lit("unknown")).alias("title"))
    path = new_path(spark, "pack")
    return Pack(spark, path, build(records, hash_vectors(records), path))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


ENCODER = encoders.hash_encoder(64)


@query(f"""WITH {PACKED.format(extras=EXTRAS)}, f AS (SELECT query_id, id, distance, round(1 / (60::DOUBLE + near.rank - 1) + coalesce(1 / (60::DOUBLE + lf.rank - 1), 0), 12) AS fused FROM near LEFT JOIN lf USING (query_id, id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, distance, id) AS rank FROM f)
 SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance, lang FROM r JOIN documents ON doc_id = id WHERE rank <= 5""")
def pack_hybrid(spark, sf_dir):
    found = _built(spark, sf_dir).query(_questions(spark, sf_dir), 5, encoder=ENCODER)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"), "lang")


@query(f"WITH {PACKED.format(extras=EXTRAS)} SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 5")
def pack_augmented(spark, sf_dir):
    return rounded(_built(spark, sf_dir).query(_questions(spark, sf_dir), 5, "augmented", encoder=ENCODER))


@query(f"WITH {PACKED.format(extras='')} SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 5")
def pack_vector(spark, sf_dir):
    return rounded(_built(spark, sf_dir).query(_questions(spark, sf_dir), 5, "vector", encoder=ENCODER))


@query(f"""WITH {PACKED.format(extras=EXTRAS)}, r AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY lf.rank) AS rank FROM near JOIN lf USING (query_id, id))
 SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def pack_lexical(spark, sf_dir):
    return rounded(_built(spark, sf_dir).query(_questions(spark, sf_dir), 5, "lexical", encoder=ENCODER))


@query(f"""WITH {PACKED.format(extras='')}, v AS (SELECT * FROM near WHERE rank <= 5), l AS (SELECT * FROM lx WHERE rank <= 5),
 m AS (SELECT 'vector' AS mode, query_id, rank, id FROM v UNION ALL SELECT 'lexical', query_id, rank, id FROM l),
 h AS (SELECT mode, query_id, min(rank) AS found, count(*) AS k FROM (SELECT m.*, contains(lower(d.text), lower(left(b.text, 40))) AS hit FROM m JOIN documents d ON d.doc_id = m.id JOIN benchmark b ON b.item_id = m.query_id) WHERE hit GROUP BY 1, 2),
 q AS (SELECT item_id AS query_id, mode, CASE WHEN item_id % 2 = 0 THEN 'exact' ELSE 'semantic' END AS kind FROM benchmark, (SELECT unnest(['vector', 'lexical']) AS mode)),
 n AS (SELECT mode, query_id, count(*) AS k FROM m GROUP BY 1, 2)
 SELECT mode, kind, round(avg(CASE WHEN found <= 1 THEN 1.0 ELSE 0.0 END), 6) AS success_1, round(avg(CASE WHEN found <= 3 THEN 1.0 ELSE 0.0 END), 6) AS success_3,
  round(avg(coalesce(1.0::DOUBLE / found, 0)), 6) AS mrr, count(*) FILTER (n.k IS NULL) AS abstained, count(*) AS n FROM q LEFT JOIN h USING (mode, query_id) LEFT JOIN n USING (mode, query_id) GROUP BY 1, 2""")
def retrieval_report(spark, sf_dir):
    pack, items = _built(spark, sf_dir), _questions(spark, sf_dir)
    results = pack.nearest(ENCODER(items.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), 5).select(F.lit("vector").alias("mode"), "query_id", "rank", "id")
    results = results.union(pack.lexical(items, 5).select(F.lit("lexical"), "query_id", "rank", "id"))
    expected = items.select("query_id", F.substring("text", 1, 40).alias("part"))
    met = lexical.hydrate(results.join(expected, "query_id"), docs(spark, sf_dir), few=True).withColumn("match", evaluate.meets({"path": F.col("text")}, {"path": F.col("part")}))
    modes = F.explode(F.array(F.lit("vector"), F.lit("lexical"))).alias("mode")
    queries = items.select("query_id", F.when(F.col("query_id") % 2 == 0, "exact").otherwise("semantic").alias("kind"), modes)
    found = evaluate.report(evaluate.first_match(queries, met, ["mode", "query_id"]), ["mode", "kind"])
    return found.select("mode", "kind", *(F.round(c, 6).alias(c) for c in ("success_1", "success_3", "mrr")), "abstained", "n")


@query("SELECT doc_id // 256 AS page, true AS intact FROM documents GROUP BY 1")
def pack_pages_intact(spark, sf_dir):
    return _built(spark, sf_dir).verify_pages()


@query("SELECT 'records' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'pages', count(DISTINCT doc_id // 256) FROM documents UNION ALL SELECT 'doc_stats', count(*) FROM documents UNION ALL SELECT 'corpus_stats', 1")
def pack_info(spark, sf_dir):
    return _built(spark, sf_dir).info().where("name in ('records', 'pages', 'doc_stats', 'corpus_stats')").select("name", "rows")


@query("SELECT doc_id AS id, text, lang FROM documents WHERE doc_id IN (3, 5, 8)")
def pack_record(spark, sf_dir):
    return _built(spark, sf_dir).record([3, 5, 8]).select("id", "text", "lang")


@query(f"WITH {PACKED.format(extras='')}, g AS (SELECT query_id, id FROM near WHERE rank = 1) SELECT b.text, 1::INTEGER AS found, true AS passed FROM g JOIN benchmark b ON b.item_id = query_id")
def pack_goldens(spark, sf_dir):
    """Probes whose expectation is what the vectors find first are found first by the distance order."""
    pack = _built(spark, sf_dir)
    first = pack.query(_questions(spark, sf_dir), 1, "vector", encoder=ENCODER).select("query_id", F.col("id").alias("expect_id"))
    goldens = first.join(_questions(spark, sf_dir), "query_id").select("text", "expect_id", F.lit(None).cast("string").alias("expect_title"))
    return pack.with_goldens(goldens, new_path(spark, "goldens")).verify_goldens(ENCODER, mode="vector")


@query(None)
def pack_signals(spark, sf_dir):
    """Abstention signals of every question, and the verdict of a fixed model."""
    pack, items = _built(spark, sf_dir), _questions(spark, sf_dir)
    hits = pack.nearest(ENCODER(items.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), 10)
    flat = dict.fromkeys(calibrate.FEATURES, 0.0)
    model = calibrate.Calibration(flat, dict.fromkeys(calibrate.FEATURES, 1.0), flat | {"d0": -6.0, "coverage": 3.0, "known_frac": 2.0}, 0.0, 0.4, 0.6)
    return model.judged(pack.signals(items, hits))


# evaluation


@query("""WITH m AS (SELECT event_type AS g, value AS x, 1.0 + (event_id % 3) AS w FROM events), a AS (SELECT sum(w * x) / sum(w) AS mean FROM m)
 SELECT 'value' AS feature, round(any_value(mean), 6) AS mean, round(sqrt(sum(w * (x - mean) * (x - mean)) / sum(w)), 6) AS std FROM m, a""")
def weighted_moments(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("w", 1.0 + (F.col("event_id") % 3))
    found = calibrate.weighted_moments(events, ["value"], "w")
    return found.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT count(DISTINCT nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '')) AS titles FROM pages")
def distinct_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return evaluate.distinct_titles(pages)


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 5")
def vocabulary(spark, sf_dir):
    return evaluate.vocabulary(docs(spark, sf_dir).select(F.explode(T.lexical_tokens(F.col("text"))).alias("term")), 5)


@query(f"""WITH d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKS}) AS term FROM documents) GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
 SELECT term, df, floor(ln(1 + n / df) / ln(1 + n / (SELECT min(df) FROM d)) * 255 + 0.5::DOUBLE)::INTEGER AS bucket FROM d, n""")
def idf_buckets(spark, sf_dir):
    texts = docs(spark, sf_dir)
    return evaluate.idf_buckets(lexical.postings(texts), texts.count())


@query("SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS id FROM documents")
def dense_ids(spark, sf_dir):
    return chunking.dense_ids(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "id")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents),
 s AS (SELECT DISTINCT floor(i * n / 64.0::DOUBLE)::BIGINT AS id FROM n, (SELECT unnest(range(0, 64)) AS i)) SELECT doc_id, r.id FROM r JOIN s USING (id)""")
def even_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return evaluate.even_sample(chunking.dense_ids(rows, ["doc_id"]), 64, rows.count()).select("doc_id", "id")


@query("SELECT DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS folded FROM conversations WHERE role = 'user'")
def folded_queries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(T.folded_query(F.col("text")).alias("folded")).distinct()


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN false ELSE {FNV.format(0x811C9DC5, 'trim(source)')} % 100 < 30 END AS held_out FROM documents")
def held_out_titles(spark, sf_dir):
    return calibrate.hold_out_titles(table(spark, sf_dir, "documents"), 30, "source").select("doc_id", "held_out")


@query("""SELECT event_id, p.p_name AS part, n.n_name AS nation, coalesce(r.r_name, 'none') AS region FROM events e LEFT JOIN part p ON p.p_partkey = e.event_id % 300
 LEFT JOIN nation n ON n.n_nationkey = p.p_size % 30 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def catalog_hops(spark, sf_dir):
    """Hits to products, products to what is live now: each hop keeps a hit that finds nothing."""
    hits = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 300).alias("id"))
    first = lexical.hydrate(hits, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("part"), (F.col("p_size") % 30).alias("at")))
    second = lexical.hydrate(first.drop("id").withColumnRenamed("at", "id"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"), "n_regionkey"))
    third = lexical.hydrate(second.drop("id").withColumnRenamed("n_regionkey", "id"), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region")))
    return third.select("event_id", "part", "nation", F.coalesce("region", F.lit("none")).alias("region"))


# ingestion

HREF = """regexp_extract_all(html, 'href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''<>=`]+)', 1, 'i')"""


@query(f"SELECT page_id, array_to_string(list_transform({HREF}, lambda t: regexp_replace(t, '^[\"'']|[\"'']$', '', 'g')), ' ') AS targets FROM pages")
def link_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.link_targets(F.col("html")), " ").alias("targets"))


@query(None)
def same_origin_links(spark, sf_dir):
    return chunking.links(table(spark, sf_dir, "pages"))


@query("""SELECT page_id, nullif(regexp_extract(regexp_extract(html, '<meta[^>]*http-equiv\\s*=\\s*["'']?refresh["'']?[^>]*>', 0, 'i'), 'content\\s*=\\s*["'']?[^"''>]*?url\\s*=\\s*([^"''>\\s;]+)', 1, 'i'), '') AS target
 FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '<meta http-equiv=refresh content="0; url=/moved/' || page_id || '">' || html ELSE html END AS html FROM pages)""")
def meta_refresh(spark, sf_dir):
    moved = F.concat(F.lit('<meta http-equiv=refresh content="0; url=/moved/'), F.col("page_id").cast("string"), F.lit('">'), F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, moved).otherwise(F.col("html")).alias("html"))
    return pages.select("page_id", T.meta_refresh(F.col("html")).alias("target"))


@query("""SELECT page_id, url FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url || '/print.html' ELSE url END AS url FROM pages)
 WHERE NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '^(?:.*/print\\.html|/de/.*)$')""")
def crawl_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/print.html"))).otherwise(F.col("url")).alias("url"))
    return pages.where(T.crawlable(F.col("url"), exclude=["/de/*"]))


@query(None)
def html_sections(spark, sf_dir):
    return chunking.sections(table(spark, sf_dir, "pages"), "html", "page_id", "html").withColumnRenamed("doc_id", "page_id")


@query(None)
def sentence_chunks(spark, sf_dir):
    return chunking.chunk_sentences(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id,
  array_to_string(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN list_position(k, k[i]) = i THEN k[i] END), lambda w: w IS NOT NULL)[1:10], ' ') AS keywords
 FROM (SELECT doc_id, list_filter({ALL}, lambda w: len(w) >= 3 AND NOT list_contains({base.ASKED}, w)) AS k FROM d)""")
def keywords(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("id").alias("doc_id"), T.keywords(F.coalesce("text", F.lit(""))).alias("keywords"))


@query(None)
def student_vectors(spark, sf_dir):
    """The hashed n-gram student with tables from a fixed generator, for want of trained ones."""
    rng = np.random.default_rng(11)
    tables = (rng.integers(-127, 128, (512, 16), dtype=np.int8), np.full(512, 0.01), rng.integers(-127, 128, (32, 16), dtype=np.int8), np.full(32, 0.01), np.zeros(32))
    encoded = encoders.student_encode(_questions(spark, sf_dir).withColumnRenamed("query_id", "id"), encoders.StudentModel(*tables))
    p, verdict = calibrate.student_verdict(F.lit(1.0), F.col("n_feats"), F.col("pre_norm"))
    return encoded.select("id", F.round("pre_norm", 6).alias("pre_norm"), "n_feats", p.alias("p"), verdict.alias("verdict"))
