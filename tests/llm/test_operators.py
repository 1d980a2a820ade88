"""Operators against brute force, round trips, SQL and held-out rows."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import queries as Q
from gleanery.llm.bpe import ForcedBoundaryBPE, bpe_round_trip
from gleanery.llm.chat_format import preference_pairs, repeating_answers
from gleanery.llm.collision_knn import collision_knn
from gleanery.llm.common import documents
from gleanery.llm.exact_dedup import ExtendibleIndex, exact_groups, keep_first
from gleanery.llm.license_scan import LicenseScanner, license_scan, seeds
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.packing import ByteLevelEncoder, SumOfSquares, pack
from gleanery.llm.shingle_sets import keep_one, similar_groups
from gleanery.llm.simhash_dedup import exact_masks, majority, near_rows, pivot_table, shingle_hashes, simhash_groups
from gleanery.llm.token_counts import WordPieceCounter, token_counts
from gleanery.llm.toxicity import STRIP, Scorer, lattice, may_begin, may_count, reject_toxic, toxicity, train, trigram_counts, viterbi, word_features

WS = " \t\n\x0b\x0c\r"
LONG = ("Some Words of a long text\n\tthat goes on, über and über.\n" * 4000) + "end"
ODD = [
    (1, "Hello  World under the MIT License"),
    (2, "hello world under the mit license"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG),
    (8, "Ünïcödé wörds ÉCOLE école     ʼn ﬁ İstanbul ΣΑΣ é \x1c 日本語 🙂🙂 don't I'LL 12345"),
    (8, "Ünïcödé wörds ÉCOLE école     ʼn ﬁ İstanbul ΣΑΣ é \x1c 日本語 🙂🙂 don't I'LL 12345"),
    (9, "a <|endoftext|> b<|startoftext|>c"),
    (10, "x" * 3000 + "aB" * 700),
    (11, "one two three"),
    (None, "one two three"),
    (None, None),
]
CLASH = "keep_id string, score string, w0 string, lines string, cell string, component string, toxic string, held_out string, `__gone` string, key string, pos string, count string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", None, *["x"] * 12) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in documents(spark, sf_dir).select("doc_id", "text").collect()]


# 1 token counts
def greedy(word, initial, suffix):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at, pieces = n + 1, end, suffix
    return n


def test_word_pieces_equal_greedy_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        make = lambda k: {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(k)}
        initial, suffix = make(12), make(12)
        counter = WordPieceCounter(initial, suffix)
        for _ in range(150):
            word = "".join(rng.choice(list("abcd"), rng.integers(1, 14), p=[0.33, 0.33, 0.33, 0.01]))
            assert counter.count(word) == greedy(word, initial, suffix), (word, initial, suffix)


def test_token_counts_query(spark, sf_dir, odd, none):
    from gleanery.llm.token_counts import sentencepiece_vocabulary

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    initial, suffix = map(set, sentencepiece_vocabulary(vocabulary))
    memo = {}

    def want(text):
        words = text.encode().split()
        n = [memo.setdefault(w, greedy("▁" + w.decode(), initial, suffix)) for w in words]
        return len(words), sum(max(1, x) for x in n), n.count(0)

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in rows(Q.op1_token_counts(spark, sf_dir))}
    assert got == {i: want(t) for i, t in texts(spark, sf_dir)}
    found = rows(token_counts(odd, vocabulary))
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in found) == Counter((i, *want(t or "")) for i, t in ODD)
    assert token_counts(none, vocabulary).count() == 0


# 2 nearest neighbours
def test_collision_knn_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in table}
    ids = np.array(list(vectors))
    x = np.stack(list(vectors.values()))
    hit = total = 0
    by_query = defaultdict(list)
    for r in rows(Q.op2_collision_knn(spark, sf_dir)):
        by_query[r["query_id"]].append(r)
    assert set(by_query) == {i for i in vectors if i % 20 == 0}
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r["vec_id"] != q for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(abs(r["score"] - vectors[r["vec_id"]] @ vectors[q]) < 1e-12 for r in found)
        score = x @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hit += len({ids[i] for i in order} & {r["vec_id"] for r in found})
        total += 20
    assert hit / total >= 0.9


def test_collision_knn_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]), (3, [5.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in table], "vec_id long, embedding array<float>, b string, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(collision_knn(df, df.where("vec_id in (0, 5, 6)"), 3))]
    assert sorted(got) == [(0, 1, 3, 5.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    assert len(rows(collision_knn(df, df.where("vec_id = 0"), 20))) == 4
    assert rows(collision_knn(df.where("false"), df, 3)) == rows(collision_knn(df, df.where("false"), 3)) == []


def test_collision_knn_counts_ids_not_rows(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((60, 8))
    near = [(100, (x[0] * (3 - 0.001 * i)).tolist()) for i in range(80)]  # one id on most of the best rows
    table = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + near
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    query = spark.createDataFrame([(0, x[0].tolist())], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows(collision_knn(df, query, 20, verified=1.0)))
    score = {i: float(v @ x[0]) for i, v in enumerate(x)} | {100: float(3 * (x[0] @ x[0]))}
    want = sorted((i for i in score if i), key=lambda i: (-score[i], i))[:20]
    assert [(r, i) for r, i, _ in got] == list(enumerate(want, 1)) and all(abs(s - score[i]) < 1e-9 for _, i, s in got)
    assert len({r["vec_id"] for r in rows(collision_knn(df, query, 20))}) == 20


def unit_rows(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_windows_expand_as_counted_afresh():
    from gleanery.llm.collision_knn import CollisionIndex

    x = unit_rows(700, 12, 4) * np.random.default_rng(5).uniform(0.2, 3, (700, 1))
    index = CollisionIndex(x, 40)
    assert np.allclose(index.axes[:, :13].T @ index.axes[:, :13], np.eye(13))
    scaled = x / np.abs(x).max()
    at = scaled @ index.axes[:-1] + np.outer(np.sqrt(np.maximum(index.top - (scaled**2).sum(1), 0)), index.axes[-1])
    for query, found in zip(x[:20], index.candidates(x[:20], 90, 0.3, 1.1, 0.7)):
        centre = (query * np.sqrt(index.top) / np.linalg.norm(query)) @ index.axes[:-1]
        half = 0.3 * index.unit
        while len(want := np.flatnonzero((np.abs(at - centre) <= half).sum(1) >= np.ceil(0.7 * 40))) < 90:
            half *= 1.1
        assert found.tolist() == want.tolist()


def test_collision_recall_of_a_full_block():
    from gleanery.llm import collision_knn as C

    x = unit_rows(C.BLOCK_ROWS, 64, 6)  # nothing but noise: the hardest neighbours
    index, hit, share = C.CollisionIndex(x), 0, 0
    queries = x[:40]
    least = max(C.VERIFIED_TIMES * 21, int(np.ceil(C.VERIFIED * len(x))))
    for i, found in enumerate(index.candidates(queries, least, C.HALF_WIDTH, C.WIDEN, C.THRESHOLD)):
        near = [j for j in np.argsort(-(x @ queries[i]), kind="stable") if j != i][:20]
        hit += len(set(near) & set(found))
        share += len(found) / len(x)
    assert hit / 800 >= 0.9 and share / 40 < 0.25


def test_collision_knn_over_several_blocks(spark, monkeypatch):
    import gleanery.llm.collision_knn as C

    for name, value in (("BLOCK_ROWS", 1_000), ("QUERY_ROWS", 40), ("LEAST_ROWS", 500)):
        monkeypatch.setattr(C, name, value)
    x = unit_rows(4_000, 32, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in rows(collision_knn(df, df.where("vec_id % 40 = 0"), 20)):
        got[r["query_id"]].append(r["vec_id"])
    hit = 0
    for q, found in got.items():
        near = [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]
        assert len(set(found)) == 20
        hit += len(set(near) & set(found))
    assert len(got) == 100 and hit / 2_000 >= 0.9


def test_collision_knn_with_huge_components(spark):
    table = [(0, [1e160, 0.0, 1.0]), (1, [1e160, 1e150, 0.0]), (2, [-1e160, 3.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [1e-170, 0.0, 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in rows(collision_knn(df, df.where("vec_id in (0, 3)"), 4))}
    assert [got[0, i] for i in range(1, 5)] == [1, 3, 4, 2] and [got[3, i] for i in range(1, 5)] == [1, 0, 4, 2]


# 3 SimHash
def brute_print(text, k=4):
    w = [x for x in regex.split("[\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints, bits=4):
    ids = [i for i in prints if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_equals_brute_force(spark, sf_dir):
    prints = {i: brute_print(t) for i, t in texts(spark, sf_dir)}
    want = brute_components(prints)
    got = rows(Q.op3_simhash(spark, sf_dir))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_simhash_odd_documents(spark, odd, none):
    got = rows(simhash_groups(odd))
    prints = {i: brute_print(t or "") for i, t in ODD}
    want = brute_components(prints)
    assert len(got) == len(ODD)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert simhash_groups(none).count() == 0


def test_masks_miss_no_pair():
    rng = np.random.default_rng(1)
    masks = exact_masks(4)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_pivots_discard_no_near_pair(bits):
    rng = np.random.default_rng(2)
    w = np.repeat(rng.integers(0, 2**63, 6, dtype=np.uint64), 30)
    for row in range(len(w)):
        for bit in rng.choice(64, rng.integers(0, bits + 1), replace=False):
            w[row] ^= np.uint64(1 << int(bit))
    sizes = np.array([100, 1, 79])
    cell = np.repeat([0, 1, 2], sizes)
    want = {(a, b) for a in range(180) for b in range(a + 1, 180) if cell[a] == cell[b] and np.bitwise_count(w[a] ^ w[b]) <= bits}
    table = pivot_table(w)
    assert table.shape == (180, 32) and table.max() <= 64
    assert want and {tuple(p) for p in near_rows(w, table, sizes, bits).tolist()} == want


def test_hot_cell_is_split_without_loss(spark, monkeypatch):
    import gleanery.llm.simhash_dedup as S

    monkeypatch.setattr(S, "CELL_ROWS", 8)
    rng = np.random.default_rng(5)
    prints, p = {}, int(rng.integers(0, 2**62))
    for i in range(120):  # a chain, of which one high block never changes
        prints[i] = p = p ^ sum(1 << int(b) for b in rng.choice(40, int(rng.integers(1, 5)), replace=False))
    nodes = spark.createDataFrame([(p,) for p in set(prints.values())], "node long")
    roots = {r["node"]: r["root"] for r in rows(S.connected(S.links(nodes, 4)))}
    assert {p: roots.get(p, p) for p in prints.values()} == brute_components({p: p for p in prints.values()})


def test_one_id_with_several_texts_links_by_each_alone(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "c"), (4, "d"), (4, "d"), (None, a)], "doc_id long, text string")
    for groups in (simhash_groups(df), similar_groups(df)):
        found = Counter((r["doc_id"], r["component_id"]) for r in rows(groups))
        assert found == Counter([(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4), (4, 4), (None, None)])
    kept = Counter((r["doc_id"], r["text"]) for r in rows(keep_one(df)))
    assert kept == Counter([(1, a), (2, b), (4, "c"), (4, "d"), (None, a)])


def test_majority_of_many_hashes():
    h = np.frombuffer(np.random.default_rng(1).bytes(8 * 70_001), "<u8")
    want = sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))
    assert majority(h) & (2**64 - 1) == want
    assert len(shingle_hashes(b"", 4)) == 0 and len(shingle_hashes(b"a b", 4)) == 1 and len(shingle_hashes(b"a b c d e", 4)) == 2


def brute_similar(docs, limit=0.8):
    sets = {i: set(shingle_hashes(t.encode(), 5).tolist()) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_stage_links_similar_documents_and_no_others(spark, monkeypatch):
    import corpus_pipeline
    import gleanery.llm.shingle_sets as S

    monkeypatch.setattr(S, "CELL_ROWS", 8)
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    docs = []
    for n, cut in ((400, 44), (400, 43), (400, 45), (400, 58), (40, 4), (13, 1), (12, 1), (10, 1), (8, 1), (6, 1), (3, 1)):
        for _ in range(8):  # cut words replaced at the end: similarities on both sides of 0.8, down to 0.75
            w = word(n)
            docs += [" ".join(w), " ".join([*w[: n - cut], *word(cut)]), " ".join([*w, *word(1)])]
    line = word(60)
    docs += [" ".join([*line, *word(int(n))]) for n in rng.integers(5, 25, 60)]  # hot cells
    docs += [" ".join(word(30) * 5) for _ in range(3)] + ["", " ", docs[0].upper()]
    docs = list(enumerate(docs))
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (docs[3][0], docs[3][1])], "doc_id long, text string")
    want = brute_similar(docs)
    assert 30 < sum(i != c for i, c in want.items()) < 150
    got = rows(similar_groups(df))
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, **want} and len(got) == len(docs) + 2
    kept = Counter(r["doc_id"] for r in rows(corpus_pipeline.near_stage(spark, df, "")))
    assert kept == Counter([None, *(i for i, c in want.items() if i == c)])


def test_near_copies_of_one_family_are_not_all_compared(spark, monkeypatch):
    import gleanery.llm.shingle_sets as S

    compared, table = [], S.shared_table

    def counted(df, label):
        out = table(df, label)
        compared.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(S, "shared_table", counted)
    rng = np.random.default_rng(21)
    line, docs = [f"f{i}" for i in range(300)], []
    for i in range(240):  # one run of words is another: about half of all pairs are similar
        n = int(rng.integers(4, 23))
        at = int(rng.integers(0, 300 - n))
        docs.append((i, " ".join([*line[:at], *(f"r{i}x{j}" for j in range(n)), *line[at + n :]])))
    got = rows(similar_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_similar(docs)
    assert sum(compared) < 16 * len(docs)


def test_near_stage_verifies_sets_of_near_fingerprints(spark, monkeypatch):
    import corpus_pipeline
    import gleanery.llm.shingle_sets as S

    rng = np.random.default_rng(23)
    docs = []
    for i in range(0, 40, 2):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        docs += [(i, " ".join(w)), (i + 1, " ".join([*w, "more"]))]
    docs += [(40, "a b c d e f g h"), (41, "a b c d e f g h a b c d e f g x")]  # unlike sets, whatever their fingerprints
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: S.shingle_set(t.encode(), 5) for i, t in docs}
    prints = {i: majority(s) for i, s in sets.items()}
    found = {(r["u"], r["v"]) for r in rows(S._fingerprint_pairs(spark.createDataFrame(list(prints.items()), "node long, w0 long")))}
    near = {(j, i) for i in prints for j in prints if i < j and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4}
    assert found <= near and {j for j, _ in found} == {j for j, _ in near}
    # without any cell of prefixes near fingerprints still link, and verified sets alone do
    monkeypatch.setattr(S, "_pairs", lambda cells, *_: cells.where("false").select(F.col("node").alias("u"), F.col("node").alias("v")))
    kept = Counter(r["doc_id"] for r in rows(corpus_pipeline.near_stage(spark, df, "")))
    similar = {j for j, i in near if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert len(similar) > 10 and kept == Counter(i for i in sets if i not in similar)


def test_parity_maps_never_differ_by_more_than_sets():
    from gleanery.llm.shingle_sets import maps_differ, parity_map

    rng = np.random.default_rng(22)
    for n, m in ((0, 0), (0, 3), (100, 130), (127, 129), (5000, 6000), (9000, 8000)):
        common = rng.integers(0, 2**64, min(n, m), dtype=np.uint64)[: min(n, m) * 9 // 10]
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, k - len(common), dtype=np.uint64)))) for k in (n, m))
        differ = len(np.setxor1d(a, b))
        assert maps_differ(parity_map(a), parity_map(b)) == maps_differ(parity_map(b), parity_map(a)) <= differ
        assert maps_differ(parity_map(a), parity_map(a)) == 0
    long = [np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64)) for _ in range(2)]
    assert maps_differ(*map(parity_map, long)) > 12_000 / 9  # unlike long sets are told apart without their elements


def test_sets_are_read_at_wanted_places_only(spark, monkeypatch):
    import gleanery.llm.shingle_sets as S

    monkeypatch.setattr(S, "MAP_ROWS", 16)
    df = spark.createDataFrame([(f, i, f"{f} {i}") for f in "ab" for i in range(50)], "row_file string, row_at long, text string")
    want = [(7, "a", 0), (8, "a", 15), (9, "a", 16), (10, "a", 49), (11, "b", 31)]
    got = rows(S._sets(df, spark.createDataFrame(want, "node long, row_file string, row_at long"), 5))
    assert {r["node"]: bytes(r["elements"]) for r in got} == {n: S.shingle_set(f"{f} {i}".encode(), 5).tobytes() for n, f, i in want} and len(got) == 5


# 4 chat formatting
def test_chat_pairs(spark):
    c = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "fine"), (2, 0, "user", "x"), (3, 0, "user", None), (None, 0, "user", "n"), (5, 0, "user", "only chosen")]
    r = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad!"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, None, "y"), (None, 0, "user", "n")]
    schema = "conv_id long, turn int, role string, text string"
    got = {x["conv_id"]: x for x in rows(preference_pairs(spark.createDataFrame(c, schema).withColumn("n", F.lit(1)).withColumn("c", F.lit(1)), spark.createDataFrame(r, schema)))}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["n_prompt_turns"] == 2 and one["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    cut = lambda text, spans: [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(",") if s)]
    assert cut(one["chosen"], one["chosen_loss"]) == ["good<|im_end|>\n", "fine<|im_end|>\n"]
    assert cut(one["rejected"], one["rejected_loss"]) == ["bad!<|im_end|>\n"]
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert got[3]["n_prompt_turns"] == 0 and got[3]["prompt"] == ""
    assert preference_pairs(spark.createDataFrame([], schema), spark.createDataFrame(r, schema)).count() == 0


def test_chat_pairs_with_clashing_columns_and_long_turns(spark):
    long = "word " * 40_000
    schema = "conv_id long, turn int, role string, text string, key string, turns string, c string, r string, n string"
    make = lambda data: spark.createDataFrame([(*d, "x", None, "x", "x", None) for d in data], schema)
    c = make([(1, 0, "user", long), (1, 1, "assistant", long + "a"), (2, None, "user", ""), (2, None, "user", "")])
    r = make([(1, 0, "user", long), (1, 1, "assistant", long + "b"), (2, None, "user", None)])
    got = {x["conv_id"]: x for x in rows(preference_pairs(c, r))}
    assert got[1]["prompt"].count("word") == 40_000 and got[1]["chosen"].endswith("a<|im_end|>\n") and got[1]["rejected"].endswith("b<|im_end|>\n")
    assert got[1]["chosen_loss"] == f"{len('<|im_start|>assistant' + chr(10))}:{len(got[1]['chosen'])}"
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert preference_pairs(c.where("false"), r.where("false")).count() == 0


def oracle(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    return Counter(tuple(sorted(zip(names, r))) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert Counter(tuple(sorted(r.items())) for r in rows(Q.QUERIES[name](spark, sf_dir))) == oracle(name, sf_dir)


def test_repeating_answers(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "assistant", "z")], "conv_id long, turn int, role string, text string")
    assert [r["text"] for r in df.transform(repeating_answers).orderBy("turn").collect()] == ["a", "", ""]


# 5 licences
def brute_base(text):
    words = regex.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in hits)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in hits}))


def test_license_query(spark, sf_dir, odd, none):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = {r["doc_id"]: r for r in rows(Q.op5_license_scan(spark, sf_dir))}
    for i, t in texts(spark, sf_dir):
        assert tuple(got[i][n] for n in names) == brute_base(t)
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1
    assert any(r["n_base"] for r in got.values())
    assert LicenseScanner().scan(b"This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl"
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows(license_scan(odd))) == Counter((i, *brute_base(t or "")) for i, t in ODD)
    assert license_scan(none).count() == 0


def brute_notice(scanner, notice, pattern, words):
    """Whether any place of the text, without seeds, holds the notice with its distinguishing words."""
    for at in range(len(words)):
        m = pattern.match(words, at)
        if m and scanner.tells(notice, words, m.start(), m.end()):
            return True
    return False


def test_edits_never_turn_one_licence_into_another():
    scan = lambda t: LicenseScanner().scan(t.encode())
    for text in ("under the MPL license", "Apache License Version 1.0", "Mozilla Public License, version 1.1", "licensed under cc by sa", "licensed under cc by", "licensed under cc by nd"):
        assert scan(text)["labels"] == "", text
    for text, label in (("under the mti license", ""), ("under the mpl license under the mit licence", "mit"), ("Apache Licence, Version 2.0", "apache-2"), ("licenced under the Apache License", "apache"), ("Mozila Public Licence version 2", "mpl-2")):
        assert scan(text)["labels"] == label, text
    spans = scan("under the mit licence under the mit license")["spans"]
    assert [(s["first"], s["last"], s["edits"]) for s in spans] == [(0, 3, 1), (4, 7, 0)]


def test_fuzzy_notices_equal_search_without_seeds():
    rng = np.random.default_rng(4)
    scanner = LicenseScanner()
    for notice, _, pattern in scanner.notices:
        for _ in range(25):
            text = list(notice.text)
            for _ in range(rng.integers(0, notice.edits + 2)):
                at = int(rng.integers(0, len(text)))
                text[at : at + int(rng.integers(0, 2))] = list("".join(rng.choice(list("xyz "), int(rng.integers(0, 2)))))
            words = (" lorem " + "".join(text) + " ipsum dolor ").encode()
            want = {n.label for n, _, p in scanner.notices if brute_notice(scanner, n, p, words)}
            assert want == {label for *_, label, _ in scanner.fuzzy(words)}
    found = scanner.scan(b"Released under the MTT licence, friends. Permission is herby granted, free of charge")
    assert found["labels"] == "mit" and found["n_base"] == 0 and 0.8 < found["score"] < 1
    assert (found["spans"][0]["first"], found["spans"][0]["last"], found["spans"][0]["edits"]) == (1, 4, 2)
    assert [len(p) for _, p in seeds("abcdefg", 2)] == [2, 3, 2]


# 6 packing
def check_packing(found, docs, tokenizer):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == 1 or len(ids) > 1024
        assert all(r["length"] == 1024 for r in own[1:]) and 1 <= own[0]["length"] <= 1024
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
    total = 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    return len(bins), -(-total // 1024)


def test_packing_query(spark, sf_dir, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    used, least = check_packing(rows(Q.op6_packing(spark, sf_dir)), texts(spark, sf_dir), tokenizer)
    assert used <= 1.05 * least + 2
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(rows(pack(unique, path)), [(i, t or "") for i, t in dict(ODD).items() if i is not None], tokenizer)
    assert pack(odd, path).select("doc_id").where("doc_id is null").count() == 2
    assert pack(none, path).count() == 0


def test_chunks_encode_as_the_library_does():
    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.fast
    rng = np.random.default_rng(6)
    signs = list("ab Z9'’,.\n\t\r\x0b\x0c\x1c\x85\xa0   　é日é🙂_") + ["'s", "'ll", "  ", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(signs, rng.integers(0, 14)))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(7)
    packer = SumOfSquares(12)
    gaps = {}
    for size in rng.integers(1, 13, 400).tolist():
        stock = Counter(g for g in gaps.values() if g)

        def squares(old, new, stock=stock):
            s = stock.copy()
            s[old] -= 1 if old else 0
            s[new] += 1 if new else 0
            return sum(n * n for g, n in s.items() if 0 < g < 12)

        best = min([squares(g, g - size) for g in stock if stock[g] > 0 and g >= size] + [squares(0, 12 - size)])
        number, offset = packer.place(size)
        old = gaps.get(number, 12)
        assert offset == 12 - old and squares(0 if old == 12 else old, old - size) == best
        gaps[number] = old - size


# 7 BPE
def test_bpe_query_equals_library(spark, sf_dir, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(Q.op7_bpe(spark, sf_dir))}
    assert got == {i: want(t) for i, t in texts(spark, sf_dir)}
    found = rows(bpe_round_trip(odd, path, full=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == Counter((i, *want(t or "")) for i, t in ODD)
    assert all(len(r["ids"]) == r["n_tokens"] and sha(r["decoded"]) == r["decoded_sha256"] for r in found)
    assert bpe_round_trip(none, path).count() == 0


def test_bpe_random_texts_and_boundaries():
    encoder = ForcedBoundaryBPE(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(8)
    signs = list("abtheinQZ9'’,.!\n\t\x0b\x1c\x85\xa0 éÉß日é🙂_İΣ") + ["'s", "'LL", "ing", "the", " "]
    for _ in range(1500):
        text = "".join(rng.choice(signs, rng.integers(0, 30)))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        n, joined, decoded = encoder.encode(text)
        assert (n, joined) == (len(ids), " ".join(map(str, ids))), repr(text)
        assert decoded == encoder.tokenizer.decode(ids, skip_special_tokens=False)
    for length in (3, 90, 101, 400):
        symbols = encoder.symbols("".join(rng.choice(list("aehinst"), length)) + "</w>")
        plain = list(symbols)
        while len(plain) > 1:
            rank, at = min((encoder.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(plain, plain[1:])))
            if rank == 1 << 60:
                break
            plain[at : at + 2] = [plain[at] + plain[at + 1]]
        assert encoder._merge_long(list(symbols)) == plain


def test_bpe_cuts_texts_at_special_tokens():
    encoder = ForcedBoundaryBPE(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.native
    rng = np.random.default_rng(18)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "|>", "a", " ", "é", "The", "\n", "42", "!"]
    for _ in range(600):
        text = "".join(rng.choice(signs, rng.integers(0, 10)))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == (len(ids), " ".join(map(str, ids)), encoder.tokenizer.decode(ids, skip_special_tokens=False)), repr(text)


def test_native_merging_equals_the_merge_list():
    encoder = ForcedBoundaryBPE(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(19)
    for _ in range(2_000):
        fragment = bytes(rng.choice(list(b"aehinstroul\xc3\xa9"), int(rng.integers(1, 30)))) + rng.choice([b"", b"\xff"])
        body, mark = (fragment[:-1], encoder.suffix) if fragment.endswith(b"\xff") else (fragment, "")
        if not body:
            continue
        want = encoder.merge(encoder.symbols("".join(encoder.characters[b] for b in body) + mark))
        assert encoder._fragment(bytes(fragment))[1] == " ".join(map(str, want))


def test_memo_is_bounded_and_keeps_what_is_asked_for():
    from gleanery.llm.common import Memo

    calls = Counter()
    memo = Memo(lambda k: calls.update([k]) or len(k), 2_000, 100, 1)
    for i in range(500):
        assert memo["often"] == 5 and memo[f"k{i}"] == len(f"k{i}")
        assert len(memo) + len(memo.old) <= 20
    assert calls["often"] == 1
    assert memo["x" * 5_000] == 5_000 and "x" * 5_000 not in memo
    memo.remember({f"r{i}": i for i in range(5)})
    assert memo["r3"] == 3


# 8 line dedup
def brute_lines(docs, min_docs=2):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < min_docs or min(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, odd, none, min_docs):
    more = [(20, "ÉCOLE Normale\nshared line here\nshort"), (21, " éCOLE normale\t\nSHARED line here \nshort"), (22, "École normale\nshared line here"), (23, "\n\n\n"), (24, None)]
    df = odd.select("doc_id", "text", "lines", "pos", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows(line_dedup(df, min_docs=min_docs)))
    assert got == brute_lines(ODD + more, min_docs)
    assert line_dedup(none).count() == 0


def test_line_dedup_is_native(spark, sf_dir):
    for name in ("op4_chat_format", "op8_line_dedup"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


# 9 exact dedup
def test_extendible_index():
    rng = np.random.default_rng(10)
    index, plain = ExtendibleIndex(4, 12), defaultdict(list)
    keys = [int(k) for k in rng.integers(0, 2**63, 500)] + [5, 5 + (1 << 40), 5 + (1 << 41), 5 + (1 << 42), 5 + (1 << 43), 5 + (1 << 44)]
    for n, key in enumerate(keys * 2):
        index.chain(key).append(n)
        plain[key].append(n)
    assert all(index.chain(k) == v for k, v in plain.items()) and index.depth > 4
    assert all(len(b[1]) <= 4 or b[0] == 12 for b in index.directory)


def test_exact_dedup_odd_documents(spark, odd, none):
    norm = lambda t: regex.sub("[\\x20\\x09-\\x0D]+", " ", t or "")
    members = defaultdict(list)
    for i, t in ODD:
        members[norm(t)].append(i)
    want = Counter()
    for i, t in ODD:
        ids = [x for x in members[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want[i, keep, len(members[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    groups = exact_groups(odd)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(groups)) == want
    kept = keep_first(odd)
    first = {norm(t): None for _, t in ODD}
    for i, t in ODD:
        if i is not None and (first[norm(t)] is None or i < first[norm(t)]):
            first[norm(t)] = i
    assert kept.schema == odd.schema and Counter((r["doc_id"], norm(r["text"])) for r in rows(kept)) == Counter((i, t) for t, i in first.items())
    assert exact_groups(none).count() == 0 and keep_first(none).count() == 0


def test_keep_first_judges_rows_not_ids(spark, tmp_path):
    data = [(1, "alpha beta"), (2, "alpha  beta"), (2, "something wholly different"), (None, "alpha beta"), (None, "only here"), (None, "only here"), (3, "twice"), (3, "twice"), (4, None), (5, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("__at", F.lit(1))
    want = Counter([(1, "alpha beta"), (2, "something wholly different"), (None, "only here"), (3, "twice"), (4, None)])
    assert Counter((r["doc_id"], r["text"]) for r in rows(keep_first(df))) == want
    df.repartition(3).write.parquet(f"file://{tmp_path}/t")
    read = spark.read.parquet(f"file://{tmp_path}/t")
    assert Counter((r["doc_id"], r["text"]) for r in rows(keep_first(read.where("true")))) == want


def test_equal_keys_are_told_apart_by_bytes(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    import gleanery.llm.exact_dedup as E
    import zstandard

    pages = [zstandard.compress(t) for t in (b"aaa", b"bbb", b"aaa")]
    (tmp_path / "f").write_bytes(b"".join(pages))
    at = [0, len(pages[0]), len(pages[0]) + len(pages[1])]
    batch = pa.RecordBatch.from_pydict({"key": [7] * 3, "file": ["f"] * 3, "place": at, "stored": [len(p) for p in pages], "size": [3] * 3, "missing": [False] * 3, "doc_id": [9, 4, 2], "row_file": [""] * 3, "row_at": [0] * 3, "n": [1, 1, 5]})
    got = [r for b in E._owned(iter([batch]), f"file://{tmp_path}") for r in b.to_pylist()]
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(2, 6), (4, 1), (2, 6)]


# 10 toxicity
@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.1"
    return train(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def test_toxicity_on_held_out_rows(spark, trained):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in rows(toxicity(documents(spark, sf), trained))]
    assert len(got) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = Counter((r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels)
    assert sum(held.values()) > 500
    assert held[1, 1] / (held[1, 1] + held[0, 1]) >= 0.9, held  # recall
    assert held[1, 1] / (held[1, 1] + held[1, 0]) >= 0.9, held  # precision
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_sees_through_disguises(trained):
    scorer = Scorer(*trained)
    words = [f[:-2] for f, w in trained[0].weights.items() if f.endswith("$1") and f.isascii() and len(f) > 6 and w > 0.5][:6]
    assert words
    leet = str.maketrans({"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"})
    for w in words:
        plain = scorer.score(f"the ha {w} re")
        assert plain > 0.3
        for form in (w.upper(), w.translate(leet), " ".join(w), ".".join(w), "-".join(w), w[0] + w[1] * 5 + w[2:], f"**{w}**!!"):
            assert scorer.score(f"the ha {form} re") > 0.3, form
    assert viterbi("th3", trained[1]) == "the"


def test_disguises_of_every_form_are_decoded():
    from gleanery.llm.toxicity import BYTE_CODES, Restorer

    n = np.zeros((64, 64, 64))  # a language of few words
    c = BYTE_CODES[np.frombuffer(b" you stupid idiot said the asshole is a total moron and left " * 50, np.uint8)]
    np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    p1 = (n.sum((0, 1)) + 1) / (n.sum() + 64)
    p2 = (n.sum(0) + 5 * p1) / (n.sum(0).sum(1, keepdims=True) + 5)
    restorer = Restorer(-np.log((n + 5 * p2) / (n.sum(2, keepdims=True) + 5)).astype(np.float32))
    for text, word in (
        ("s t u p i d.", "stupid"), ("(s t u p i d)", "stupid"), ("s\tt\tu\tp\ti\td", "stupid"), ("s - t - u - p - i - d", "stupid"), ("i d i o t, x", "idiot"),
        ("*diot", "idiot"), ("stuupid", "stupid"), ("!diot", "idiot"), ("tota|", "total"),
        ("st" + "u" * 100 + "pid", "stupid"), ("y o u i d i o t", "idiot"), ("s t u p ! d", "stupid"), ("i d i o t t o t a l", "idiot"),
    ):
        assert word in restorer.words(text), (text, restorer.words(text))
    assert restorer.words("the total moron") == {"the", "total", "moron"}
    assert len(viterbi("5tup1d" * 5000, restorer.model)) == 30_000


def small_model(text):
    from gleanery.llm.toxicity import BYTE_CODES

    n = np.zeros((64, 64, 64))
    c = BYTE_CODES[np.frombuffer(text.encode(), np.uint8)]
    np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    p1 = (n.sum((0, 1)) + 1) / (n.sum() + 64)
    p2 = (n.sum(0) + 5 * p1) / (n.sum(0).sum(1, keepdims=True) + 5)
    return -np.log((n + 5 * p2) / (n.sum(2, keepdims=True) + 5))


def test_viterbi_finds_the_best_of_all_readings():
    from itertools import product

    from gleanery.llm.toxicity import CHAR_CODES

    model = small_model(" you stupid idiot said the asshole is a total moron and left " * 20).tolist()
    rng = np.random.default_rng(3)

    def cost(text):
        codes = [0, 0, *(CHAR_CODES.get(c, 63) for c in text), 0]
        return sum(model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    def options(word, breaks):
        for i, run in enumerate(lattice(word)):
            more = list(run)
            if breaks:
                more += [(f"{r[0]} {r[1:]}", c) for r, c in run if len(r) == 2 and r[0] == r[1]]
                more += [(" " + r, c) for r, c in more] if i else []
            yield more

    for _ in range(200):
        word = "".join(rng.choice(list("aiostdm013@$!*#|"), int(rng.integers(1, 7))))
        for breaks in (False, True):
            costs = sorted((cost("".join(r for r, _ in path)) + sum(c for _, c in path), "".join(r for r, _ in path)) for path in product(*options(word, breaks)))
            best = viterbi(word, model, breaks)
            assert any(t == best for c, t in costs if c <= costs[0][0] + 1e-9), (word, best, costs[:3])


def test_one_doubled_letter_is_read_as_viterbi_reads_it():
    from gleanery.llm.toxicity import one_double, undoubled

    rng = np.random.default_rng(24)
    model = rng.exponential(2.0, (64, 64, 64)).astype(np.float32).tolist()
    words = ["".join(rng.choice(list("abcéßжя"), int(rng.integers(1, 8)))) for _ in range(4000)]
    assert one_double("abb") == 1 and [one_double(w) for w in ("ab", "abbb", "aabb", "bb1", "")] == [-1] * 5
    some = [w for w in words if one_double(w) >= 0]
    assert len(some) > 500 and {undoubled(w, one_double(w), model) == w for w in some} == {True, False}
    for level in (model, np.ones((64, 64, 64)).tolist(), np.full((64, 64, 64), 3.0).tolist()):  # the last: ties
        assert all(undoubled(w, one_double(w), level) == viterbi(w, level) for w in some)


def test_forms_are_left_undecoded_only_where_no_reading_can_count():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(400):
        form = "".join(rng.choice(list("asdfg!*@(.1"), int(rng.integers(1, 6))))
        readings = {"".join(r for r, _ in path) for path in product(*lattice(form))}
        begins = {(w + "$")[:3] for r in readings for w in (r, r.strip(STRIP)) if w}
        for starts in ({str(b)} for b in begins):
            assert may_begin(form, starts), (form, starts)
    assert not may_begin("ellement", {"stu"}) and may_begin("sstupid", {"stu"})
    for _ in range(400):
        form = "".join(rng.choice(list("aabs"), int(rng.integers(3, 11))))
        for reading in {"".join(r for r, _ in path) for path in product(*lattice(form))}:
            assert all(may_count(form, {f}) for f in word_features(reading)), (form, reading)
    assert may_count("stuupid", {"stupid$"}) and not may_count("stuupid", {"stupe", "pid", "stu$"}) and may_count("aabb" * 20, {"x"})


def test_scores_equal_a_plain_sum_and_words_are_cut_once(trained, monkeypatch):
    import gleanery.llm.toxicity as T

    cut = []
    monkeypatch.setattr(T, "word_features", lambda word, plain=T.word_features: cut.append(word) or plain(word))
    lexicon, model = trained
    scorer, restorer = Scorer(lexicon, model), T.Restorer(model)
    some = sorted(f[:-2] for f in lexicon.weights if f[-2] == "$")
    texts = ["", "plain words only, seen twice: plain words", " ".join(some), f"{some[0]} {some[0]}! {some[0].upper()}", " ".join(" ".join(w) for w in some[:5]), " ".join(w[:4] + "zzy" for w in some)]
    for text in texts:
        found = sorted(T.text_features(restorer.words(text)) & lexicon.weights.keys())
        z = max(-30.0, min(30.0, lexicon.intercept + sum(lexicon.weights[f] for f in found)))
        assert scorer.score(text) == max([1 / (1 + math.exp(-z)), *(lexicon.sure.get(f, 0.0) for f in found)])
    cut.clear()
    assert scorer.score(texts[2]) == scorer.score(texts[2]) and not cut  # known words aren't cut into features again


def test_trigrams_equal_a_plain_count(spark):
    from gleanery.llm.toxicity import BYTE_CODES

    data = ["", None, "a", "Hello, wörld! ", "日本 x" * 9, "İİ" * 5, "q" * 300]
    want = Counter()
    for t in data:
        c = BYTE_CODES[np.frombuffer((" " + (t or "").lower() + " ").encode("latin-1", "replace"), np.uint8)].tolist()
        want.update((a * 64 + b) * 64 + d for a, b, d in zip(c, c[1:], c[2:]))
    got = {r["gram"]: r["n"] for r in rows(trigram_counts(spark.createDataFrame([(t,) for t in data], "text string").coalesce(1)))}
    assert got == dict(want)


def test_an_id_with_both_labels_is_toxic(spark):
    from gleanery.llm.toxicity import training_labels

    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (3, 0, 0), (3, 0, None), (None, 0, 1), (4, 0, 7)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["toxic"]) for r in rows(training_labels(labels)) if r["doc_id"] in (1, 3)} <= {(1, 1), (3, 0)}


def test_toxicity_odd_documents(spark, odd, none, trained):
    got = rows(toxicity(odd, trained))
    assert len(got) == len(ODD) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    kept = reject_toxic(odd, trained)
    assert kept.schema == odd.schema and kept.count() == sum(not r["predicted"] for r in got)
    assert toxicity(none, trained).count() == 0
    empty = train(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in rows(toxicity(odd, empty))} == {0}
