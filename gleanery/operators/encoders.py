"""Encoders: the hook, its check against stored vectors, word pieces and the hashed n-gram student."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import GleaneryError
from ..functions import text as T
from ..functions import vector as V

#: An encoder takes ``id, text`` and gives ``id, vector``.
Encoder = Callable[[DataFrame], DataFrame]
#: Words whose hashes a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 18, 64


def hash_sums(df: DataFrame, dims: int = 64) -> DataFrame:
    """``id, s``: for each row that has a word, the sum of its words' hashes in each bucket, null in one without words.

    Words are hashed once and remembered, up to a bound.
    """
    ship(df.sparkSession)

    class Codes(dict):
        """Bucket and value of a word in one number."""

        def __missing__(self, word: bytes) -> int:
            digest = hashlib.sha256(word).digest()
            code = int.from_bytes(digest[:4], "little") % dims * 512 + 2 * digest[4]
            if len(word) <= LONGEST:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = code
            return code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Codes().__getitem__
        for batch in batches:
            sums, absent, kept = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().split() if text.is_valid else []  # of bytes, at the white space of the expression \s
                if words:
                    codes = np.fromiter(map(of, words), np.int64, len(words))
                    bucket = codes >> 9
                    sums.append(np.bincount(bucket, (codes & 511) - 255, dims))
                    absent.append(np.bincount(bucket, minlength=dims) == 0)
                    kept.append(i)
            flat = pa.array(np.concatenate(sums).astype(np.int64), mask=np.concatenate(absent)) if kept else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * dims, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), lists], ["id", "s"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", F.lower("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, s array<long>")


def hash_cells(df: DataFrame, dims: int = 64) -> DataFrame:
    """``id, b, s``: integer cells of the deterministic hash embedding."""
    cells = hash_sums(df, dims).select("id", F.posexplode("s").alias("b", "s")).where("s is not null")
    return cells.groupBy("id", F.col("b").cast("long").alias("b")).agg(F.sum("s").alias("s"))


def hash_encoder(dims: int = 64) -> Encoder:
    """Sums of word hashes; texts without words, or with a zero sum, have no vector.  Rows of one id are one text."""

    def encode(df: DataFrame) -> DataFrame:
        sums = hash_sums(df, dims).select("id", F.transform("s", lambda x: F.coalesce(x, F.lit(0)).cast("double")).alias("v"))
        own = sums.groupBy("id").agg(F.collect_list("v").alias("vs"))
        zero = F.array_repeat(F.lit(0.0), dims)
        vector = F.when(F.size("vs") == 1, F.get("vs", 0)).otherwise(F.aggregate("vs", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)))
        return own.select("id", vector.alias("vector")).where(F.exists("vector", lambda x: x != 0))

    return encode


def verify_encoder(encoder: Encoder, texts: DataFrame, stored: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row ``checked, worst``: the largest difference of any component of unit vectors.

    Raises where it is over the tolerance, or where nothing can be compared.
    """
    made = encoder(texts.select("id", "text")).select("id", V.l2_normalize(V.as_double(F.col("vector"))).alias("a"))
    both = made.join(stored.select("id", V.l2_normalize(V.as_double(F.col("vector"))).alias("b")), "id")
    gap = F.when(F.size("a") == F.size("b"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))).otherwise(float("inf"))
    found = both.agg(F.count("*").alias("checked"), F.max(gap).alias("worst"))
    row = found.first()
    if not row["checked"] or row["worst"] > tolerance:
        raise GleaneryError("ENCODER_MISMATCH", "the encoder doesn't give the stored vectors", checked=row["checked"], worst=row["worst"])
    return found


class WordPiece:
    """Uncased word pieces: accents stripped, punctuation and ideographs apart, greedy longest match."""

    LONGEST = 100
    _CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")

    def __init__(self, vocabulary: list[str]):
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.first, self.last, self.unknown = (self.ids[t] for t in ("[CLS]", "[SEP]", "[UNK]"))

    @staticmethod
    def _alone(char: str) -> bool:
        code = ord(char)
        if 33 <= code <= 47 or 58 <= code <= 64 or 91 <= code <= 96 or 123 <= code <= 126:
            return True
        ideograph = any(a <= code <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)))
        return ideograph or unicodedata.category(char).startswith("P")

    def words(self, text: str) -> list[str]:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
        return "".join(f" {c} " if self._alone(c) else c for c in self._CONTROL.sub("", text)).split()

    def pieces(self, word: str) -> list[int]:
        if len(word) > self.LONGEST:
            return [self.unknown]
        out, start = [], 0
        while start < len(word):
            for end in range(len(word), start, -1):
                piece = self.ids.get(("##" if start else "") + word[start:end])
                if piece is not None:
                    break
            else:
                return [self.unknown]
            out.append(piece)
            start = end
        return out

    def encode(self, text: str) -> list[int]:
        return [self.first, *(p for w in self.words(text) for p in self.pieces(w)), self.last]


def word_pieces(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``id, ids`` of ``id, text``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordPiece(vocabulary)
        for batch in batches:
            found = [tokenizer.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select("id", "text").mapInArrow(run, "id long, ids array<int>")


def student_features(text: Column, bucket_count: int, seed: int, most: int) -> Column:
    """Hashed features in order: each word, its 3- to 5-grams between marks, and the pair with the word before.

    Structs of ``bucket`` and ``family`` (word or char).
    """
    tokens = F.transform(T.all_tokens(F.coalesce(text, F.lit(""))), lambda w: F.substring(w, 1, 48))

    def of_token(w: Column, i: Column, before: Column) -> Column:
        padded = F.concat(F.lit("^"), w, F.lit("$"))
        size = F.length(padded)
        word = F.array(F.struct(F.concat(F.lit("w:"), w).alias("f"), F.lit("word").alias("family")))
        grams = [
            F.when(
                size >= n,
                F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.struct(F.concat(F.lit(f"c{n}:"), F.substring(padded, at, F.lit(n))).alias("f"), F.lit("char").alias("family"))),
            ).otherwise(F.slice(word, 1, 0))
            for n in (3, 4, 5)
        ]
        pair = F.when(i > 0, F.array(F.struct(F.concat(F.lit("b:"), before, F.lit(":"), w).alias("f"), F.lit("word").alias("family")))).otherwise(F.slice(word, 1, 0))
        return F.concat(word, *grams, pair)

    before = F.concat(F.array(F.lit("")), tokens)
    found = F.flatten(F.transform(tokens, lambda w, i: of_token(w, i, F.get(before, i))))
    start = F.lit(seed & 0xFFFFFFFF).cast("long")
    codes = lambda f: F.transform(F.filter(F.split(f, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = lambda f: F.aggregate(codes(f), start, lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.transform(F.slice(found, 1, most), lambda x: F.struct((h(x["f"]) % bucket_count).alias("bucket"), x["family"].alias("family")))


@dataclass(frozen=True)
class StudentModel:
    """Signed byte tables with a scale a row: features to hidden units, hidden units to a vector."""

    embedding: np.ndarray
    embedding_scales: np.ndarray
    projection: np.ndarray
    projection_scales: np.ndarray
    bias: np.ndarray
    seed: int = 0
    max_features: int = 2_048


def student_encode(df: DataFrame, model: StudentModel) -> DataFrame:
    """``id, vector, pre_norm, n_feats, hidden, features`` of ``id, text``: the mean of feature rows, squashed, projected, made unit."""
    ship(df.sparkSession)
    features = df.select("id", student_features(F.col("text"), len(model.embedding), model.seed, model.max_features).alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.embedding.astype(np.float64) * model.embedding_scales[:, None]
        project = (model.projection.astype(np.float64) * model.projection_scales[:, None]).T
        for batch in batches:
            vectors, norms, hidden, counts = [], [], [], []
            for row in batch.column(1).to_pylist():
                buckets = [f["bucket"] for f in row]
                h = np.tanh(table[buckets].mean(axis=0)) if buckets else np.zeros(table.shape[1])
                v = h @ project + model.bias if buckets else np.zeros(project.shape[1])
                norm = float(np.linalg.norm(v))
                norm = norm if np.isfinite(norm) else 0.0
                vectors.append(v / norm if norm else np.zeros_like(v))
                norms.append(norm)
                hidden.append(h)
                counts.append(len(buckets))
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, floats), pa.array(norms, pa.float64()), pa.array(counts, pa.int64()), pa.array(hidden, floats), batch.column(1)],
                ["id", "vector", "pre_norm", "n_feats", "hidden", "features"],
            )

    schema = "id long, vector array<double>, pre_norm double, n_feats long, hidden array<double>, features array<struct<bucket:bigint,family:string>>"
    return features.mapInArrow(run, schema)
