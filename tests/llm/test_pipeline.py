"""The corpus pipeline against a brute-force version, and its stages on odd tables."""

import regex
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, ODD, brute_similar, check_packing, rows

import corpus_pipeline
from gleanery.llm.common import documents
from gleanery.llm.toxicity import Scorer, train

NORM = regex.compile("[\\x20\\x09-\\x0D]+")


def norm(text):
    return NORM.sub(" ", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i, t, "en", None, None, *["x"] * 12) for i, t in ODD]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = documents(spark, sf_dir)
    scorer = Scorer(*train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = [(r["doc_id"], r["text"] or "") for r in rows(docs) if scorer.score(r["text"] or "") < 0.3]
    assert 0 < len(kept) < docs.count()
    first = {}
    for i, t in sorted(kept):
        first.setdefault(norm(t), (i, t))
    component = brute_similar(list(first.values()))
    want = [(i, t) for i, t in first.values() if component[i] == i]
    assert len(want) < len(first) < len(kept)
    got = rows(corpus_pipeline.run(spark, sf_dir))
    assert {r["doc_id"] for r in got} == {i for i, _ in want}
    used, least = check_packing(got, want, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert used <= 1.05 * least + 2


def test_every_stage_takes_odd_tables(spark, odd, odd_dir, tmp_path):
    none = odd.where("false")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, odd_dir).count() == 0, name
        out = stage(spark, docs, odd_dir)
        assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString(), name
        out.write.parquet(f"file://{tmp_path}/{name}")  # as the driver does between stages
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, none, odd_dir).count() == 0
    left = Counter(r["doc_id"] for r in rows(docs))
    assert left[8] == 1 and left[6] + left[7] == 1 and left[9] == 1  # repeated rows and copies once, others stay
    packed = Counter((r["doc_id"], r["piece"]) for r in rows(corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir)))
    assert {i for i, _ in packed} == set(left) and packed[6, 0] == 1


def test_stages_keep_unlike_texts_of_one_id(spark, odd_dir):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    data = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("a") + " more"), (None, text("a")), (None, text("c")), (None, text("c")), (4, "x"), (4, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("note", F.lit(None).cast("string"))
    exact = corpus_pipeline.exact_stage(spark, df, odd_dir)
    assert Counter((r["doc_id"], r["text"]) for r in rows(exact)) == Counter([(1, text("a")), (2, text("b")), (3, text("a") + " more"), (None, text("c")), (4, "x")])
    near = corpus_pipeline.near_stage(spark, df, odd_dir)
    assert Counter((r["doc_id"], r["text"]) for r in rows(near)) == Counter([(1, text("a")), (2, text("b")), (None, text("a")), (None, text("c")), (None, text("c")), (4, "x")])
