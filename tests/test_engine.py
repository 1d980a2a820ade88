"""Engine operators against brute force, hand-made cases and damaged inputs."""

import hashlib
import json
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.errors import GleaneryError
from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators import calibrate, chunking, encoders, evaluate, ivf, knn, lexical, ordered
from gleanery.plans import catalog_retrieval
from gleanery.plans import pack as P
from gleanery.sources import vectors as S
from gleanery.streaming import live as L


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def cloud(spark):
    """Clustered unit vectors and questions near them."""
    rng = np.random.default_rng(12345)
    centres = rng.standard_normal((6, 32))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, q = unit(centres[np.arange(384) % 6] + 0.6 * rng.standard_normal((384, 32))), unit(centres[np.arange(24) % 6] + 0.5 * rng.standard_normal((24, 32)))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    return x, q, corpus.repartition(5), queries


def brute(q, x, k, allowed=None):
    d = np.round(1 - q @ x.T, 9)
    ids = np.arange(len(x)) if allowed is None else np.array(sorted(allowed))
    return {i: [int(j) for j in ids[np.lexsort((ids, d[i, ids]))][:k]] for i in range(len(q))}


def found(df):
    out = {}
    for r in sorted(rows(df), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_holds_little_whatever_ties(metric):
    """Equal rows all reach the edge; they are cut before they pile up."""
    near = knn.Nearest(np.arange(500), np.ones((500, 4)), 5, metric, self_hits=False)
    tracemalloc.start()
    near.add(np.arange(20_000)[::-1], np.ones((20_000, 4)))
    near.add(np.arange(20_000, 20_100), np.ones((100, 4)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = near.table()
    assert got["id"].reshape(500, 5).tolist() == [[j for j in range(6) if j != i][:5] for i in range(500)] and not got["distance"].any()
    assert peak < 120e6


def test_exact_join_by_sent_queries_and_by_blocks(cloud, monkeypatch):
    x, q, corpus, queries = cloud
    want = brute(q, x, 10)
    assert found(knn.knn_join(queries, corpus, 10)) == found(knn.knn_join(queries, corpus, 10, impl="blocks")) == want
    monkeypatch.setattr(knn, "SENT_BYTES", 100)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    monkeypatch.setattr(knn, "CELLS", 64)
    assert found(knn.knn_join(queries, corpus, 10)) == want
    assert found(knn.knn_join(queries, corpus, 0)) == {}
    assert {len(v) for v in found(knn.knn_join(queries, corpus, 1_000)).values()} == {384}
    with pytest.raises(GleaneryError):
        knn.knn_join(queries, corpus, 5, "other")


def test_every_task_sends_k_rows_a_query_at_most(cloud):
    x, q, _, _ = cloud
    near = knn.Nearest(np.arange(24), q, 10, "cosine")
    for at in range(0, 384, 7):  # many batches
        near.add(np.arange(at, min(at + 7, 384)), x[at : at + 7])
        assert len(near.held[0]) <= 24 * 10
    table = near.table()
    assert {i: table["id"][table["query_id"] == i].tolist() for i in range(24)} == brute(q, x, 10)


def test_unusable_rows_are_refused_whole(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0])], "id long, vector array<double>")
    good, bad = knn.split_vectors(df, "vector", 2)
    assert [r["id"] for r in rows(good)] == [0] and {r["id"]: r["reason"] for r in rows(bad)} == {1: "norm", 2: "not_finite", 3: "missing", 4: "dimension"}
    with pytest.raises(GleaneryError):
        knn.unusable_batch(df, "vector", 2)
    knn.unusable_batch(df.where("id = 0"), "vector", 2)


def test_self_recall_verdicts(spark):
    verdict = lambda ranks: rows(knn.self_recall_verdict(spark.createDataFrame([(i, r) for i, r in enumerate(ranks)], "query_id long, self_rank int")))[0]["verdict"]
    assert [verdict(r) for r in ([1, 1], [1, 3], [1, None])] == ["exact", "degraded", "error"]


def test_diverse_takes_spread_candidates(cloud):
    x, q, corpus, queries = cloud
    hits = knn.knn_join(queries, corpus, 30)
    got = found(knn.diverse(queries, hits, corpus, 8))
    for i, ids in brute(q, x, 30).items():
        taken = []
        for c in ids:
            if len(taken) < 8 and all(np.round(1 - q[i] @ x[c], 9) < np.round(1 - x[c] @ x[t], 9) for t in taken):
                taken.append(c)
        taken += [c for c in ids if c not in taken][: 8 - len(taken)]
        assert sorted(got[i]) == sorted(taken)


# inverted lists
def recall(got, want):
    return sum(len(set(got.get(i, ())) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


def test_inverted_lists_reach_their_recall(cloud, monkeypatch):
    x, q, corpus, queries = cloud
    centroids = ivf.train(corpus, 12)
    lists = ivf.assigned(corpus, centroids)
    placed = {r["id"]: r["list"] for r in rows(lists)}
    assert placed == dict(enumerate((x @ centroids.T).argmax(1).tolist())) and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    want = brute(q, x, 10)
    assert recall(found(ivf.ivf_join(queries, lists, centroids, 10, 4)), want) >= 0.9
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 10)  # lists in several chunks
    assert found(ivf.ivf_join(queries, lists, centroids, 10, 12)) == want
    assert ivf.ivf_join(queries, lists, centroids, 0, 12).count() == 0
    for modulo in (2, 10, 20):
        allowed = corpus.where(F.col("id") % modulo == 0)
        got = found(ivf.ivf_join(queries, lists, centroids, 10, 4, allowed=allowed))
        assert all(i % modulo == 0 for v in got.values() for i in v)
        assert recall(got, brute(q, x, 10, range(0, 384, modulo))) >= 0.9


def test_lists_on_the_tables(spark, sf_dir):
    from gleanery.plans.catalog import asked, corpus

    x = corpus(spark, "/root/testdata/sf0.1")
    centroids = ivf.train(x, 16)
    got = found(ivf.ivf_join(asked(x), ivf.assigned(x, centroids), centroids, 10, 10))
    assert recall(got, found(knn.knn_join(asked(x), x, 10))) >= 0.9


def test_chain_and_layout(cloud):
    _, _, corpus, _ = cloud
    centroids = ivf.train(corpus, 6)
    place = ivf.chain_order(centroids)
    assert sorted(place) == list(range(6)) and place[0] == 0
    order, alike = np.argsort(place), centroids @ centroids.T
    for at in range(5):
        assert order[at + 1] == max(order[at + 1 :], key=lambda c: alike[order[at], c])
    got = [r["place"] for r in rows(ivf.laid_out(ivf.assigned(corpus, centroids), centroids))]
    assert got == sorted(got)


# order without one task
@pytest.mark.parametrize("groups", [1, 7])
def test_running_sums_and_neighbours(spark, groups):
    rng = np.random.default_rng(groups)
    data = [(int(g), int(v), int(w)) for g, v, w in zip(rng.integers(0, groups, 500), rng.permutation(5_000)[:500], rng.integers(0, 9, 500))]
    df = ordered.ranged(spark.createDataFrame(data, "g long, v long, w long").repartition(6), ["g"], ["v"])
    sums = {(r["g"], r["v"]): r["s"] for r in rows(ordered.running_sum(df, ["g"], ["v"], F.col("w"), "s"))}
    prev = {(r["g"], r["v"]): r["p"] for r in rows(ordered.previous(df, ["g"], ["v"], "v", "p"))}
    for g in range(groups):
        own, total, before = sorted((v, w) for h, v, w in data if h == g), 0, None
        for v, w in own:
            total += w
            assert sums[g, v] == total and prev[g, v] == before
            before = v
    assert len(sums) == len(prev) == 500


def test_dense_ids_and_even_samples(spark):
    df = spark.createDataFrame([(i * 3 % 101, f"t{i % 40}") for i in range(101)], "k long, text string").repartition(5)
    got = {r["k"]: r["id"] for r in rows(chunking.dense_ids(df, ["k"], start=7))}
    assert got == {k: k + 7 for k in range(101)}
    numbered = spark.range(101)
    for most in (1, 2, 10, 64, 100, 200):
        want = list(range(101)) if most >= 101 else sorted({math.floor(i * (101 / most)) for i in range(most)})
        assert sorted(r["id"] for r in rows(evaluate.even_sample(numbered, most, 101))) == want, most
    once = rows(chunking.renumbered(df, ["k"]))
    assert sorted(r["id"] for r in once) == list(range(40)) and len({r["text"] for r in once}) == 40


# codes
def test_vector_expressions_read_their_input_once(spark):
    """A random vector shows how often it is computed: once, not once for every component."""
    same, pair = F.array_repeat(F.rand() * 200, 8), F.transform(F.array_repeat(F.rand(), 2), lambda x, i: x + i)
    for pooled in (V.pooled(same, 8, 1), V.micro(same, 4, 2, 8), V.pooled_query(same, 8, 1)):
        assert [r["n"] for r in rows(spark.range(20).select(F.size(F.array_distinct(pooled)).alias("n")))] == [1] * 20
    assert {tuple(r["q"]) for r in rows(spark.range(20).select(V.quantize(pair).alias("q")))} == {(0, 255)}
    assert all(r["s"] == pytest.approx(1 / 255) for r in rows(spark.range(20).select(V.quantization(pair)["scale"].alias("s"))))


# lexical
def brute_bm25(queries, docs, n):
    words = lambda t: [w for w in re.findall("[a-z0-9']+", (t or "").lower()) if 2 <= len(w) <= 32]
    texts = {}
    for i, t in docs:
        texts[i] = texts.get(i, []) + [w for w in words(t) if w not in T.STOP_WORDS]
    df, mean = Counter(w for t in texts.values() for w in set(t)), max(1, sum(map(len, texts.values())) / len(texts))
    out = {}
    for q, t in queries:
        asked, scores = set(words(t)), []
        for i, own in texts.items():
            tf = Counter(w for w in own if w in asked)
            part = [math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, c in tf.items()]
            scores += [(-round(sum(part), 6), i)] if tf else []
        out[q] = [i for _, i in sorted(scores)[:n]]
    return {q: ids for q, ids in out.items() if ids}


def test_postings_are_lists_of_blocks_and_score_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = [f"w{i}" for i in range(60)] + ["the", "it's", "x", "Über", "y" * 33, "a1"]
    docs = [(i, " ".join(rng.choice(names, rng.integers(1, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 W2"), (902, "w1 the w3"), (-5, "w1 w1 K w2")]
    queries = [(q, " ".join(rng.choice(names, 6))) for q in range(12)] + [(50, "the nothing"), (51, None), (52, "W1 w1 it's")]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    want = brute_bm25(queries, docs, 7)
    assert found(lexical.bm25(q, d, 7)) == want
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 500)
    stored = lexical.tables(d)
    lists, blocks = stored["postings"], stored["doc_stats"].select("block").distinct().count()
    assert blocks > 3 and lists.count() == lists.select("term", "block").distinct().count() < lexical.occurrences(stored).count() / 3
    assert rows(stored["corpus_stats"])[0]["n"] == 304 and stored["doc_stats"].where("id = 902").first()["dl"] == 4
    assert found(lexical.bm25_stored(q, stored, 7)) == found(lexical.bm25(q, d, 7)) == want
    monkeypatch.setattr(lexical, "SENT_TERMS", 3)
    assert found(lexical.bm25_stored(q, stored, 7)) == found(lexical.bm25(q, d, 7)) == want


# sources
def test_json_vectors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "vector": [1, 0]}\n\n{"id": "y", "vector": [0, 1]}\n')
    (tmp_path / "b.json").write_text('[{"id": "x", "vector": [1, 2]}, {"id": "z"}]')
    assert {r["id"] for r in rows(S.read_json_vectors(spark, f"{tmp_path}/a.jsonl"))} == {"x", "y"}
    with pytest.raises(Exception, match="MISSING_KEY.*vector"):
        S.read_json_vectors(spark, f"{tmp_path}/b.json").collect()
    assert S.read_json_vectors(spark, f"{tmp_path}/b.json", strict=False).count() == 2
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        S.read_json_vectors(spark, f"{tmp_path}/c.jsonl").collect()


def test_matrices(spark, tmp_path, monkeypatch):
    m = np.random.default_rng(3).standard_normal((37, 5)).astype("<f4")
    (tmp_path / "m.f32").write_bytes(m.tobytes())
    np.save(tmp_path / "m.npy", m)
    (tmp_path / "m.fvecs").write_bytes(b"".join(np.int32(5).tobytes() + r.tobytes() for r in m))
    (tmp_path / "m.bvecs").write_bytes(b"".join(np.int32(4).tobytes() + bytes([i, 1, 2, 3]) for i in range(9)))
    monkeypatch.setattr(S, "RANGE_BYTES", 100)  # several tasks a file
    as_matrix = lambda df: np.array([r["vector"] for r in sorted(rows(df), key=lambda r: r["row"])], "<f4")
    for df in (S.read_f32_matrix(spark, f"{tmp_path}/m.f32", 5), S.read_npy(spark, f"{tmp_path}/m.npy"), S.read_fvecs(spark, f"{tmp_path}/m.fvecs")):
        assert df.rdd.getNumPartitions() > 1 and np.array_equal(as_matrix(df), m)
    assert as_matrix(S.read_fvecs(spark, f"{tmp_path}/m.bvecs", "u1"))[:, 0].tolist() == list(range(9))
    with pytest.raises(GleaneryError):
        S.read_f32_matrix(spark, f"{tmp_path}/m.f32", 6)
    np.save(tmp_path / "flat.npy", m[0])
    with pytest.raises(GleaneryError):
        S.read_npy(spark, f"{tmp_path}/flat.npy")


def test_folders_goldens_and_shelves(spark, tmp_path):
    for name in ("a.md", "deep/b.txt", "deep/skip.md", "c.py"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(name)
    assert {r["text"] for r in rows(S.read_folder(spark, f"{tmp_path}/docs"))} == {"a.md", "deep/b.txt", "deep/skip.md"}
    assert {r["text"] for r in rows(S.read_folder(spark, f"{tmp_path}/docs", exclude=["skip.*"]))} == {"a.md", "deep/b.txt"}
    (tmp_path / "g.jsonl").write_text('{"text": "q", "expect_id": 3}\n')
    assert rows(S.read_goldens(spark, f"{tmp_path}/g.jsonl")) == [{"text": "q", "expect_id": 3, "expect_title": None}]
    shelf = {"packs": [{"name": "a", "path": "p/a", "identity": "0" * 64}, {"name": "b", "url": "https://x/b"}]}
    (tmp_path / "s.json").write_text(json.dumps(shelf))
    assert {r["name"]: r["location"] for r in rows(S.read_shelf(spark, f"{tmp_path}/s.json"))} == {"a": f"{tmp_path}/p/a", "b": "https://x/b"}
    (tmp_path / "bad.json").write_text(json.dumps({"packs": [{"name": "a", "path": "x", "identity": "zz"}]}))
    with pytest.raises(Exception, match="INVALID_IDENTITY"):
        S.read_shelf(spark, f"{tmp_path}/bad.json").collect()
    assert S.segment(spark.range(10), "id", 2, 4).count() == 3


def test_datasets_prove_what_they_hold(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    identity = S.write_dataset({"t": spark.range(5)}, path, {"metric": "l2"})
    assert S.open_dataset(spark, path, identity, {"metric": "l2"}, verify=True)[0]["tables"]["t"]["rows"] == 5
    assert rows(S.inspect_dataset(spark, path))[0]["identity"] == identity
    for arguments in ({"identity": "0" * 64}, {"expect": {"metric": "cosine"}}):
        with pytest.raises(GleaneryError):
            S.open_dataset(spark, path, **arguments)
    spark.range(1).write.mode("append").parquet(f"{path}/t")
    assert S.verify_dataset(spark, path) == {"t": False}
    with pytest.raises(GleaneryError):
        S.open_dataset(spark, path, verify=True)
    spark.range(1).selectExpr("id AS other").write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(GleaneryError):
        S.open_dataset(spark, path)
    with pytest.raises(GleaneryError):
        S.write_dataset({"t": spark.range(2).withColumn("deleted", F.lit(True))}, f"{path}2")


# text
def test_markdown_sections():
    text = """---
title: "Guide"
---
import X from 'x'

# Guide

Opening *words*.

## Set up {#start}

```
# no heading
```

Deeper
------

### One
### One

Text with a [link](http://x) and <Widget a="b" /> end."""
    got = chunking.markdown_sections(text)
    assert [(s["path"], s["anchor"]) for s in got] == [
        ([], "guide"), (["Set up"], "start"), (["Deeper"], "deeper"), (["Deeper", "One"], "one"), (["Deeper", "One"], "one-1"),
    ]
    assert got[0]["text"] == "Guide\n\nOpening words ." or got[0]["text"].startswith("Guide")
    assert "no heading" in got[1]["text"] and got[-1]["text"].endswith("end.") and "Widget" not in got[-1]["text"] and "http" not in got[-1]["text"]


def test_html_sections_and_links(spark):
    html = """<html><head><title>Page | Site</title></head><body><nav><h2>Menu</h2></nav><main><p>Lead</p>
    <h1 id=top>Page</h1><p>First</p><h2><a id='in'>Inner</a> part</h2>Body &amp; more<h2>No id</h2><li>x</li></main></body></html>"""
    got = chunking.html_sections(html)
    assert [(s["path"], s["anchor"]) for s in got] == [([], ""), ([], "top"), (["Inner part"], "in"), (["No id"], "no-id")]
    assert got[0]["text"] == "Lead" and got[2]["text"] == "Inner part\nBody & more"
    page = """<a href="/a#x">1</a><a href='b'>2</a><a href="../c?d=1">3</a><a href=bare=x>7</a><a href="https://other.org/e">4</a><a href="mailto:f">5</a><a href="HTTPS://Site.org/g">6</a>"""
    df = spark.createDataFrame([(1, "https://site.org/dir/page", page), (2, "https://x.org/", None)], "page_id long, url string, html string")
    assert [r["link"] for r in rows(chunking.links(df))][:3] == ["https://site.org/a", "https://site.org/dir/b", "https://site.org/c?d=1"]
    assert chunking.links(df).count() == 5


def test_chunks(spark):
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    section = lambda n, path: {"path": [path], "anchor": path, "text": words(n, path)}
    got = chunking.section_chunks([section(400, "a"), section(10, "b"), section(500, "c"), {"path": [], "anchor": "", "text": words(200) + "\n\n" + words(100) + "\n\n" + words(150)}])
    assert [len(t.split()) for *_, t in got] == [410, 256, 256, 64, 200, 250] and got[0][1] == "a"
    assert chunking.section_chunks([section(24, "a")]) == []
    text = "One two. " * 200
    parts = chunking.sentence_chunks("T", text)
    assert all(p.startswith("T: ") for p in parts) and all(len(p) <= 3 + 810 for p in parts) and " ".join(p[3:] for p in parts).split() == text.split()
    assert chunking.sentence_chunks("T", " \n ") == [] and chunking.sentence_chunks("T", "x" * 900 + ". y.") == ["T: " + "x" * 900 + ".", "T: y."]


def test_text_expressions(spark):
    df = spark.createDataFrame([("  How the Cats'  run / fast | now > ok. Then more?  And ",)], "t string")
    r = rows(df.select(T.clean_title(F.col("t")).alias("title"), T.first_sentence(F.col("t"), 5).alias("s"), T.folded_query(F.col("t")).alias("q"), T.keywords(F.col("t"), 3).alias("k"), T.word_dropout(F.col("t"), F.lit(1)).alias("d"), T.word_dropout(F.lit("a b"), F.lit(1), 1.0).alias("two")))[0]
    assert r["title"] == "How the Cats'  run fast now ok. Then more?  And" and r["s"] == "How the Cats' run /" and r["q"].startswith("how the cats' run")
    assert r["k"] == "cats' run fast" and set(r["d"].split()) <= set("How the Cats' run / fast | now > ok. Then more? And".split()) and r["two"] == "a b"
    forms = rows(spark.createDataFrame([("cats",), ("box",)], "w string").select(T.word_forms(F.col("w")).alias("f")))
    assert [x["f"] for x in forms] == [["cats", "catss", "catses", "cat"], ["box", "boxs", "boxes"]]
    assert T.bloom_bits(0) == 1 << 14 and T.bloom_bits(10_000) == 1 << 19 and T.bloom_bits(10**9) == 1 << 21
    for url, ok in (("https://a/b/print.html", False), ("https://a/de/x", False), ("https://a/en/x?print.html", True), ("https://a", True)):
        assert rows(spark.createDataFrame([(url,)], "u string").select(T.crawlable(F.col("u"), exclude=["/de/*"]).alias("c")))[0]["c"] is ok
    assert rows(spark.createDataFrame([("https://a/en/x",)], "u string").select(T.crawlable(F.col("u"), include=["/fr/*"]).alias("c")))[0]["c"] is False


# encoders
def test_word_pieces(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!", "日", "本", "a"]
    w = encoders.WordPiece(vocabulary)
    names = lambda t: [vocabulary[i] for i in w.encode(t)]
    assert names("Unaffable CAFÉ!日本") == ["[CLS]", "un", "##aff", "##able", "cafe", "!", "日", "本", "[SEP]"]
    assert names("unx " + "a" * 101 + "\x00a") == ["[CLS]", "[UNK]", "[UNK]", "[SEP]"] and names("") == ["[CLS]", "[SEP]"]
    df = spark.createDataFrame([(1, "a!"), (2, None)], "id long, text string")
    assert {r["id"]: r["ids"] for r in rows(encoders.word_pieces(df, vocabulary))} == {1: [2, 11, 8, 3], 2: [2, 3]}


def brute_features(text, buckets, seed, most):
    out, before = [], None
    for token in re.findall("[a-z0-9']+", (text or "").lower()):
        token = token[:48]
        padded = f"^{token}$"
        own = [("w:" + token, "word")] + [(f"c{n}:{padded[i : i + n]}", "char") for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
        own += [(f"b:{before}:{token}", "word")] if before is not None else []
        out, before = out + own, token
    hashed = []
    for feature, family in out[:most]:
        h = seed
        for c in feature:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        hashed.append((h % buckets, family))
    return hashed


def test_student(spark):
    texts = ["The quick brown fox", "a", None, "", "x" * 60 + " it's 42", "same same"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for most in (5, 1_000):
        got = {r["id"]: [tuple(f) for f in r["f"]] for r in df.select("id", encoders.student_features(F.col("text"), 97, 5, most).alias("f")).collect()}
        assert got == {i: brute_features(t, 97, 5, most) for i, t in enumerate(texts)}
    rng = np.random.default_rng(1)
    model = encoders.StudentModel(rng.integers(-127, 128, (97, 8), dtype=np.int8), rng.random(97), rng.integers(-127, 128, (6, 8), dtype=np.int8), rng.random(6), rng.random(6), 5, 1_000)
    for r in rows(encoders.student_encode(df, model)):
        buckets = [b for b, _ in brute_features(texts[r["id"]], 97, 5, 1_000)]
        assert r["n_feats"] == len(buckets)
        if buckets:
            h = np.tanh((model.embedding.astype(float) * model.embedding_scales[:, None])[buckets].mean(0))
            v = (model.projection.astype(float) * model.projection_scales[:, None]) @ h + model.bias
            assert np.allclose(r["vector"], v / np.linalg.norm(v)) and np.isclose(r["pre_norm"], np.linalg.norm(v)) and np.allclose(r["hidden"], h)
        else:
            assert r["pre_norm"] == 0 and not any(r["vector"])
    encoded = encoders.student_encode(df, model)
    p = rows(encoded.where("id = 0").select(calibrate.hidden_probe(F.col("hidden"), [0.5] * 8, 0.1).alias("p"), F.col("hidden").alias("h"), calibrate.known_features(F.col("features"), [b for b, f in brute_features(texts[0], 97, 5, 9) if f == "word"], []).alias("k")))[0]
    assert np.isclose(p["p"], 1 / (1 + math.exp(-(0.1 + 0.5 * sum(p["h"]))))) and 0 < p["k"]["known_word"] <= 1 and p["k"]["known_char"] == 0
    go, refused = calibrate.before_search(encoded, norm_floor=0.0)
    assert {r["id"] for r in rows(refused)} == {1, 2, 3} and go.count() == 3  # "a" has two features


def test_encoders_are_checked(spark):
    encode = encoders.hash_encoder(16)
    texts = spark.createDataFrame([(1, "one two"), (2, "three")], "id long, text string")
    stored = encode(texts).selectExpr("id", "transform(vector, x -> x * 3) AS vector")
    assert rows(encoders.verify_encoder(encode, texts, stored))[0]["checked"] == 2
    for wrong in (stored.selectExpr("id", "reverse(vector) AS vector"), stored.where("false"), stored.selectExpr("id", "slice(vector, 1, 3) AS vector")):
        with pytest.raises(GleaneryError):
            encoders.verify_encoder(encode, texts, wrong)


def test_hash_sums_against_brute_force(spark):
    texts = [(1, "One two\tTWO\u00a0three\x0b"), (2, None), (3, " \n"), (4, "a"), (4, "b a"), (5, "\u00c9t\u00e9 " * 50 + "z" * 500)]
    cells = {}
    for i, text in texts:
        for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()):
            if w:
                h = hashlib.sha256(w.encode()).digest()
                b = int.from_bytes(h[:4], "little") % 16
                cells[i, b] = cells.get((i, b), 0) + 2 * h[4] - 255
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    assert {(r["id"], r["b"]): r["s"] for r in rows(encoders.hash_cells(df, 16))} == cells
    assert {r["id"]: r["vector"] for r in rows(encoders.hash_encoder(16)(df))} == {i: [float(cells.get((i, b), 0)) for b in range(16)] for i in (1, 4, 5)}


def test_word_counts(spark, monkeypatch):
    texts = ["the cat's cat", "The dog", None, "", "cat " * 9, "x" * 70]
    want, held = Counter(w for t in texts for w in re.findall("[a-z0-9']+", (t or "").lower())), Counter(w for t in texts for w in set(re.findall("[a-z0-9']+", (t or "").lower())))
    counts = calibrate.word_counts(spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4))
    assert {r["term"]: (r["n"], r["texts"]) for r in rows(counts)} == {w: (3 * n, 3 * held[w]) for w, n in want.items()}
    assert {r["w"] for r in rows(calibrate.common_words(counts, 18))} == {"cat"}


# calibration
def test_small_generator_and_samples():
    draw = calibrate.Sequence(1)
    assert draw.next() == ((1664525 + 1013904223) & 0xFFFFFFFF) / 0xFFFFFFFF
    picked = calibrate.seeded_sample(list(range(50)), 20, 9)
    assert len(set(picked)) == 20 and picked == calibrate.seeded_sample(list(range(50)), 20, 9) != calibrate.seeded_sample(list(range(50)), 20, 10)
    assert sorted(calibrate.seeded_sample([1, 2, 3], 10, 4)) == [1, 2, 3]


def test_areas_and_thresholds():
    rng = np.random.default_rng(2)
    pos, neg = rng.integers(0, 9, 40).astype(float), rng.integers(0, 7, 30).astype(float)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert calibrate.area(pos, neg) == pytest.approx(want) and calibrate.area(pos, neg[:0]) is None
    hard, weak = calibrate.thresholds(np.full(20, 0.9), np.full(20, 0.1), np.full(5, 0.2), np.array([]))
    assert hard == pytest.approx(0.2 + 0.25 * 0.7) and weak == pytest.approx(0.81)
    hard, weak = calibrate.thresholds(np.full(20, 0.99), np.full(20, 0.9), np.full(5, 0.95), np.array([]))
    assert hard == 0.5 and hard + 0.08 <= weak <= 0.95
    assert calibrate.floor_quantile([3, 1, 2], 0.5) == 2 and calibrate.floor_quantile([3, 1], 1.0) == 3


def test_calibration_separates_or_refuses(spark):
    rng = np.random.default_rng(4)
    probe = lambda i, label, kind, at: (f"q{i}", label, kind, False, *(float(at + 0.1 * rng.standard_normal()) for _ in range(2)))
    schema = "text string, label int, kind string, gibberish boolean, d0 double, coverage double"
    good = [probe(i, 1, "positive", 1) for i in range(40)] + [probe(i + 40, 0, "easy", -1) for i in range(30)] + [probe(i + 70, 0, "hard", -0.5) for i in range(20)]
    model = calibrate.calibrate(spark.createDataFrame(good, schema), ("d0", "coverage"))
    assert model.report["auc"] > 0.99 and 0 < model.hard < model.weak <= 0.95
    judged = {r["text"]: r["verdict"] for r in rows(model.judged(spark.createDataFrame(good, schema)))}
    assert sum(judged[f"q{i}"] == "strong" for i in range(40)) >= 38 and sum(judged[f"q{i}"] == "none" for i in range(40, 90)) >= 45
    same = [probe(i, i % 2, "hard" if i % 2 == 0 else "positive", 0) for i in range(60)]
    assert calibrate.calibrate(spark.createDataFrame(same, schema), ("d0", "coverage")) is None
    assert calibrate.calibrate(spark.createDataFrame(good[:3] + good[40:], schema), ("d0", "coverage")) is None


# live tables
def test_live_table(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "id long, at long, v string, deleted boolean")
    state = L.LiveTable(spark, f"file://{tmp_path}/t", "id", ["at"])
    with pytest.raises(GleaneryError):
        state.read()
    state.apply(make([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (3, 1, "x", False)]), 0)
    state.apply(make([(2, 2, "d", False), (1, 1, "late", False)]), 1)
    state.apply(make([(9, 9, "again", False)]), 1)  # the same batch, sent again
    values = lambda: {r["id"]: r["v"] for r in rows(state.live())}
    assert values() == {1: "b", 2: "d", 3: "x"}
    ids = spark.createDataFrame([(3,), (7,)], "id long")
    assert {r["id"]: r["deleted_now"] for r in rows(state.delete(ids, 2))} == {3: True, 7: False}
    assert {r["id"]: r["deleted_now"] for r in rows(state.delete(ids))} == {3: False, 7: False}
    assert values() == {1: "b", 2: "d"} and rows(state.stats()) == [{"live": 2, "deleted": 1, "ratio": pytest.approx(1 / 3)}]
    assert state.compact_if(0.5) is False and state.compact_if(0.3) is True
    state.apply(make([(5, 1, "n", False)]), 3)
    state.compact()
    state.compact()
    assert values() == {1: "b", 2: "d", 5: "n"} and sum(p[1] == "base" for p in state._parts()) == 2

    def refuse(batch):
        raise GleaneryError("INVALID_VECTOR", "no")

    strict = L.LiveTable(spark, f"file://{tmp_path}/t", "id", ["at"], refuse)
    with pytest.raises(GleaneryError):
        strict.apply(make([(1, 9, "z", False)]), 4)
    assert values()[1] == "b" and L.memory_estimate(10, 64) == 10 * (64 + 192 + 39)


def test_churn_keeps_recall(spark, tmp_path, cloud):
    x, q, corpus, queries = cloud
    state = L.LiveTable(spark, f"file://{tmp_path}/c", "slot", ["at"])
    for turn in range(3):  # the whole population, replaced
        own = np.roll(x, turn, axis=1)
        batch = spark.createDataFrame([(i, turn, i + 1_000 * turn, v.tolist(), False) for i, v in enumerate(own)], "slot long, at long, id long, vector array<double>, deleted boolean")
        state.apply(batch, turn)
        live = state.live()
        assert live.count() == 384
        got = found(knn.knn_join(queries, live, 5))
        assert {i: [j - 1_000 * turn for j in v] for i, v in got.items()} == brute(q, own, 5)
    state.compact()
    assert state.live().count() == 384


def test_request_windows_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 2)
    rng = np.random.default_rng(8)
    times = np.sort(rng.integers(-5_000_000, 900_000_000, 400))
    df = spark.createDataFrame([(i, int(i % 3), int(t)) for i, t in enumerate(times)], "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    want = {i: sum(1 for j, s in enumerate(times) if j % 3 == i % 3 and t - 60_000_000 < s <= t) for i, t in enumerate(times)}
    assert {r["event_id"]: r["in_window"] for r in rows(L.request_windows(df))} == want


# packs
@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    topics = {"cats": "cat whiskers purring kitten feline paws", "ships": "ship harbour anchor sail vessel crew", "bread": "bread flour oven yeast dough crust"}
    rng = np.random.default_rng(6)
    filler = [f"word{i}" for i in range(60)]
    data = []
    for n in range(90):
        name = list(topics)[n % 3]
        text = " ".join(rng.choice(topics[name].split(), 8).tolist() + rng.choice(filler, 20).tolist())
        data.append((n, f"{name} {n}", f"https://x/{name}/{n}", None, f"# {name} {n}\n\nNumber{n} {text}"))
    docs = spark.createDataFrame(data, "doc_id long, title string, url string, source_path string, text string")
    encode = encoders.hash_encoder(32)
    path = f"file://{tmp_path_factory.mktemp('pack')}"
    goldens = spark.createDataFrame([("number7 word", None, "cats"), ("harbour anchor", None, "ships"), ("nothing like it", 5, "zebra")], "text string, expect_id long, expect_title string")
    stages = []
    identity = P.compile_pack(docs, path, encode, goldens=goldens, on_stage=stages.append)
    return f"{path}/final", identity, encode, docs, stages


def test_compiled_pack(spark, library):
    path, identity, encode, docs, stages = library
    assert stages[0] == "chunk" and {"encode", "vectors", "lexical", "write", "replay"} <= set(stages)
    with P.opened(spark, path, identity=identity, verify=True) as pack:
        pack.cache()
        assert pack.config["records"] == 90 and pack.verify_pages().where("not intact").count() == 0
        asked = spark.createDataFrame([(1, "number42"), (2, "harbour sail vessel")], "query_id long, text string")
        for mode in P.MODES:
            got = found(pack.query(asked, 5, mode, encoder=encode))
            assert all(len(set(v)) == len(v) <= 5 for v in got.values())
        hit = rows(pack.query(asked, 5, "lexical", encoder=encode))
        assert [r["title"] for r in hit if r["query_id"] == 1] == ["cats 42"] and all("ships" in r["title"] for r in hit if r["query_id"] == 2)
        assert rows(pack.query(asked, 1, "hybrid", encoder=encode))[0]["match_quality"] == "unscored"
        told = {r["text"]: r["passed"] for r in rows(pack.verify_goldens(encode))}
        assert "nothing like it" not in told and all(told.values()) and pack.verdict(encode) == ("pass" if told else "no-tests")
        assert rows(pack.verify_encoder(encode))[0]["checked"] == 16
        assert rows(pack.record([3]))[0]["id"] == 3
        shown = rows(P.provenance(pack.query(asked, 2, encoder=encode), "lib", identity))
        assert shown and all(r["pack"] == "lib" and r["source"].startswith("https://x/") for r in shown)
        both = P.fan_out({"a": pack, "b": pack}, asked, k=3, encoder=encode)
        assert Counter(r["pack"] for r in rows(both)) == {"a": 6, "b": 6}
        with pytest.raises(GleaneryError):
            pack.query(asked, 5, "other", encoder=encode)
        with pytest.raises(GleaneryError):
            pack.query(asked, 5)
        with pytest.raises(Exception, match="no text"):
            pack.query(spark.createDataFrame([(1, "  ")], "query_id long, text string"), 5, encoder=encode).collect()
    assert not pack.cached


def test_pack_abstains_and_reports_depth(spark, library, tmp_path):
    path, identity, encode, docs, _ = library
    pack = P.Pack(spark, path, identity)
    asked = spark.createDataFrame([(1, "number42 cat whiskers"), (2, "qqqq zzzz")], "query_id long, text string")
    flat = dict.fromkeys(calibrate.FEATURES, 0.0)
    model = calibrate.Calibration(flat, dict.fromkeys(calibrate.FEATURES, 1.0), flat | {"known_frac": 8.0}, -4.0, 0.3, 0.6)
    got = rows(pack.query(asked, 3, encoder=encode, model=model))
    assert {r["query_id"] for r in got} == {1} and {r["match_quality"] for r in got} == {"strong"}
    signals = {r["query_id"]: r for r in rows(pack.signals(asked, pack.nearest(encode(asked.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), 5)))}
    assert signals[2]["known_frac"] == 0 and signals[2]["coverage"] == 0 and signals[1]["coverage"] > 0.3
    records, vectors = pack.tables["records"].drop("digest"), pack.tables["vectors"].select("id", "vector")
    P.build(records, vectors, f"file://{tmp_path}/m", micro_dims=8, sketch_bits=8, measure=True)
    measured = P.Pack(spark, f"file://{tmp_path}/m")
    assert 10 <= measured.config["depth"] <= 90
    encoded = encode(asked.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
    exact = found(knn.knn_join(encoded, vectors, 5))
    assert found(measured.nearest(encoded, 5, rerank=90)) == exact  # all rows: the sketch is skipped
    assert recall(found(measured.nearest(encoded, 5, rerank=20, tier="m")), exact) >= 0.9
    with pytest.raises(GleaneryError):
        pack.coarse(encoded, 10, "m")


def test_pack_calibrates_itself(spark, library):
    path, identity, encode, _, _ = library
    pack = P.Pack(spark, path, identity)
    asked = rows(P.probes(pack))
    kinds = Counter(r["kind"] for r in asked)
    assert kinds["positive"] >= 20 and kinds["easy"] == P.GIBBERISH and kinds["hard"] >= 3 and len({r["text"] for r in asked}) == len(asked)
    assert all(r["gibberish"] == (r["kind"] == "easy") for r in asked)
    model = P.calibrated(pack, encode)
    if model is not None:  # else the probes of so small a library can't be told apart
        assert model.report["auc"] >= calibrate.LEAST_AUC and 0 < model.hard < model.weak <= 0.95
        nonsense = spark.createDataFrame([(i, t) for i, (t,) in enumerate(P._gibberish(8, 99))], "query_id long, text string")
        assert pack.query(nonsense, 3, encoder=encode, model=model).count() == 0


def test_damaged_packs_are_seen(spark, library, tmp_path):
    path, identity, encode, _, _ = library
    pack = P.Pack(spark, path, identity)
    records = pack.tables["records"]
    pack.tables["records"] = records.withColumn("text", F.when(F.col("id") == 3, F.lit("other")).otherwise(F.col("text")))
    assert [r["page"] for r in rows(pack.verify_pages().where("not intact"))] == [0]
    with pytest.raises(Exception, match="DIGEST_MISMATCH"):
        pack.record([3]).collect()
    assert len(rows(pack.record([4]))) == 1
    bad = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "id long, vector array<double>")
    with pytest.raises(GleaneryError):
        P.build(spark.createDataFrame([(0, "a"), (1, "b")], "id long, text string"), bad, f"file://{tmp_path}/x")


def test_a_pack_encodes_once_and_takes_other_goldens_without_being_written_again(spark, tmp_path):
    texts, base, read = [(i, f"text {i} of word{i}") for i in range(300)], encoders.hash_encoder(32), spark.sparkContext.accumulator(0)

    def encode(df):
        def counted(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return base(df.select("id", "text").mapInArrow(counted, "id long, text string"))

    records = spark.createDataFrame(texts, "id long, text string")
    path = f"file://{tmp_path}/pack"
    pack = P.Pack(spark, path, P.build(records, encode(records), path, micro_dims=16))
    assert read.value == 300
    for goldens, verdict in (([("word7", 7, None)], "pass"), ([("word7", 8, None)], "fail"), ([], "no-tests")):
        other = pack.with_goldens(spark.createDataFrame(goldens, "text string, expect_id long, expect_title string"), f"file://{tmp_path}/{verdict}")
        assert other.verdict(base) == verdict and sorted(p.name for p in (tmp_path / verdict).iterdir()) == ["_manifest.json", "goldens"]
        assert all(S.verify_dataset(spark, other.path).values()) and other.config == pack.config
    again = other.with_goldens(pack.tables["goldens"], f"file://{tmp_path}/again")
    assert S.entries(again.path)["records"]["location"] == f"{path}/records" and again.tables["records"].count() == 300


def test_a_pack_query_answers_from_the_tables_as_they_are(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = []
    for n in (120, 90):
        documents.where(F.col("doc_id") < n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        shown.append({r["name"]: r["rows"] for r in rows(catalog_retrieval.pack_info(spark, str(tmp_path)))}["records"])
    assert shown == [120, 90]
