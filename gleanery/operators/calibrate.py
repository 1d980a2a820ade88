"""Abstention: does the corpus support a question?  Signals, scores, and their calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ..functions import text as T

FEATURES = ("d0", "margin", "mean10", "known_frac", "coverage")
#: Fits below these areas under the curve, or with fewer positives, aren't used.
LEAST_AUC, LEAST_HARD_AUC, LEAST_POSITIVES = 0.85, 0.75, 4
#: The highest hard threshold, the least width of the weak band, the highest weak threshold.
HARD_AT_MOST, WEAK_BAND, WEAK_AT_MOST = 0.5, 0.08, 0.95
EPOCHS, RATE, RIDGE, FOLDS = 4_000, 0.1, 1e-3, 5
#: What a query of made-up words weighs in the fit.
GIBBERISH_WEIGHT = 0.25
#: Distinct words, and bytes read, after which a task sends its sums; rows of them that it sends at once.
HELD_WORDS, HELD_BYTES, SUMS = 1 << 18, 32 << 20, 1 << 14


class Sequence:
    """A small congruential generator, the same on every machine."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def next(self) -> float:
        self.state = (self.state * 1664525 + 1013904223) & 0xFFFFFFFF
        return self.state / 0xFFFFFFFF


def seeded_sample(items: list, n: int, seed: int) -> list:
    """n distinct places of a short list, in the order they are drawn."""
    draw, used, out = Sequence(seed), set(), []
    while len(out) < n and len(used) < len(items):
        i = math.floor(draw.next() * len(items))
        if i not in used and i < len(items):
            used.add(i)
            out.append(items[i])
    return out


def hold_out_titles(chunks: DataFrame, share: int = 12, title: str = "title") -> DataFrame:
    """``chunks`` with ``held_out``: about ``share`` of a hundred titles, whole, by a hash; none without a title."""
    cleaned = F.btrim(F.coalesce(F.col(title), F.lit("")))
    return chunks.withColumn("held_out", (cleaned != "") & (T.fnv1a(cleaned) % 100 < share))


def weighted_moments(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """``feature, mean, std`` (population) of weighted columns; a constant has a spread of 1."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")
    long = df.select(F.col(weight).cast("double").alias("w"), pairs).select("w", "p.*")
    sums = long.groupBy("feature").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    mean = sums.select("feature", (F.col("wx") / F.col("w")).alias("mean"))
    apart = long.join(F.broadcast(mean), "feature")  # a row a feature
    spread = apart.groupBy("feature", "mean").agg(F.sqrt(F.sum(F.col("w") * (F.col("x") - F.col("mean")) ** 2) / F.sum("w")).alias("std"))
    return spread.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))


def bloom_filter(words: DataFrame, bits: int) -> DataFrame:
    """``bit``: the set bits of a filter over ``term``; at most ``bits`` rows."""
    return words.select(F.explode(T.bloom_places(F.col("term"), bits)).alias("bit")).distinct()


def known_words(words: DataFrame, filter_bits: DataFrame, bits: int, key: list[str], term: str = "term") -> DataFrame:
    """``words`` with ``known``: whether the filter has all bits of the word, which it may by chance.

    Distinct words are looked up, and the filter, bounded by its bits, is what is sent.
    """
    places = words.select(term).distinct().select(term, F.explode(T.bloom_places(F.col(term), bits)).alias("bit"))
    hit = places.join(F.broadcast(filter_bits.withColumn("set", F.lit(1))), "bit", "left")
    known = hit.groupBy(term).agg((F.count("set") == F.count("*")).alias("known"))
    return words.select(*key, term).join(known, term)


def coverage(words: DataFrame, passages: DataFrame, common: DataFrame) -> DataFrame:
    """``query_id, coverage``: the best share of a query's content words that one passage holds.

    ``words``: ``query_id, w`` (repeats count); ``passages``: ``query_id, id, text``;
    ``common``: ``w`` that the corpus uses everywhere, which weigh a third.  A word
    is held in its plurals and singular too.  Without content words it is 0.
    """
    counted = words.groupBy("query_id", "w").agg(F.count("*").alias("n"))
    weighed = counted.join(common.select("w", F.lit(T.COMMON_WEIGHT).alias("light")).distinct(), "w", "left").withColumn("weight", F.col("n") * F.coalesce("light", F.lit(1.0)))
    total = weighed.groupBy("query_id").agg(F.sum("weight").alias("total"))
    held = passages.select("query_id", "id", F.explode(F.array_distinct(T.all_tokens(F.col("text")))).alias("form"))
    asked = weighed.select("query_id", "w", "weight", F.explode(F.array_distinct(T.word_forms(F.col("w")))).alias("form"))
    grounded = asked.join(held, ["query_id", "form"]).select("query_id", "id", "w", "weight").distinct()
    best = grounded.groupBy("query_id", "id").agg(F.sum("weight").alias("g")).groupBy("query_id").agg(F.max("g").alias("g"))
    return total.join(best, "query_id", "left").select("query_id", (F.coalesce("g", F.lit(0.0)) / F.col("total")).alias("coverage"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``term, n, texts`` of ``text``: how often each word stands, and in how many texts.

    A task sends sums of many texts, a bounded number of words at a time.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(rb"[a-z0-9']+").findall
        held, held_texts, read = Counter(), Counter(), 0

        def sums() -> Iterator[pa.RecordBatch]:
            terms = list(held)
            for at in range(0, len(terms), SUMS):
                some = terms[at : at + SUMS]
                counts = [pa.array([of[t] for t in some], pa.int64()) for of in (held, held_texts)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), *counts], ["term", "n", "texts"])

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py() or b""
                found = words(raw)
                held.update(found)
                held_texts.update(set(found))
                read += len(raw)
                if len(held) >= HELD_WORDS or read >= HELD_BYTES:
                    yield from sums()
                    held, held_texts, read = Counter(), Counter(), 0
        yield from sums()

    parts = texts.select(F.lower("text").cast("binary").alias("text")).mapInArrow(run, "term string, n long, texts long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def common_words(counts: DataFrame, documents: int) -> DataFrame:
    """``w`` of ``word_counts``: content words in over a twentieth of the texts (and over 4)."""
    frequent = counts.where(F.col("texts") > max(4, math.floor(documents * 0.05 + 0.5)))
    return frequent.where((F.length("term") >= T.COVERAGE_LENGTH) & ~F.col("term").isin(T.QUESTION_WORDS)).select(F.col("term").alias("w"))


def student_verdict(logit: Column, n_feats: Column, pre_norm: Column, hard: float = 0.05, weak: float = 0.0, norm_floor: float = 0.4, least_features: int = 3) -> tuple[Column, Column]:
    """(confidence, none / weak / strong): none below the hard threshold, or where the encoder saw too little."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    low = (p < hard) | (n_feats < least_features) | (pre_norm < norm_floor)
    return p, F.when(low, "none").when(p + 1e-6 >= weak, "strong").otherwise("weak")


def before_search(encoded: DataFrame, norm_floor: float = 0.4, least_features: int = 3) -> tuple[DataFrame, DataFrame]:
    """(queries to search, queries that are refused without a search)."""
    enough = (F.col("n_feats") >= least_features) & (F.col("pre_norm") >= norm_floor)
    return encoded.where(enough), encoded.where(~enough)


def hidden_probe(hidden: Column, weights: list[float], bias: float) -> Column:
    """A logistic reading of the encoder's hidden units."""
    z = F.aggregate(F.zip_with(hidden, F.array(*map(F.lit, map(float, weights))), lambda h, w: F.coalesce(h * w, F.lit(0.0))), F.lit(float(bias)), lambda a, x: a + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def known_features(features: Column, words: list[int], chars: list[int]) -> Column:
    """``known_word, known_char``: shares of word and character features that the model was trained on."""

    def share(family: str, known: list[int]) -> Column:
        own = F.filter(features, lambda f: f["family"] == family)
        hit = F.filter(own, lambda f: f["bucket"].isin(known) if known else F.lit(False))
        return F.when(F.size(own) > 0, F.size(hit) / F.size(own)).otherwise(0.0)

    return F.struct(share("word", words).alias("known_word"), share("char", chars).alias("known_char"))


@dataclass
class Calibration:
    """Moments, weights and thresholds of an abstention model, and how it did."""

    mean: dict[str, float]
    std: dict[str, float]
    weights: dict[str, float]
    bias: float
    hard: float
    weak: float
    report: dict = field(default_factory=dict)

    def logit(self) -> Column:
        z = F.lit(self.bias)
        for f in self.weights:
            z = z + (F.col(f) - self.mean[f]) / self.std[f] * self.weights[f]
        return z

    def judged(self, signals: DataFrame) -> DataFrame:
        """``signals`` with ``p`` and ``verdict`` (none, weak or strong)."""
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))
        return signals.withColumn("p", p).withColumn("verdict", F.when(F.col("p") < self.hard, "none").when(F.col("p") < self.weak, "weak").otherwise("strong"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, std, weights, bias) on standardised columns."""
    total = weight.sum()
    mean = (x * weight[:, None]).sum(0) / total
    std = np.sqrt(((x - mean) ** 2 * weight[:, None]).sum(0) / total)
    std[std == 0] = 1
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(EPOCHS):
        error = (1 / (1 + np.exp(-(z @ w + b))) - y) * weight
        w = w - RATE * (z.T @ error / total + RIDGE * w)
        b -= RATE * error.sum() / total
    return mean, std, w, b


def area(pos: np.ndarray, neg: np.ndarray) -> float | None:
    """Area under the curve, ties worth a half; nothing without both sides."""
    if not len(pos) or not len(neg):
        return None
    return float((np.searchsorted(np.sort(neg), pos, "left") + np.searchsorted(np.sort(neg), pos, "right")).sum() / (2 * len(pos) * len(neg)))


def floor_quantile(values, q: float) -> float:
    values = np.sort(np.asarray(values, float))
    return float(values[min(len(values) - 1, math.floor(q * len(values)))]) if len(values) else 0.0


def thresholds(pos: np.ndarray, easy: np.ndarray, hard_neg: np.ndarray, weak_rows: np.ndarray) -> tuple[float, float]:
    """(hard, weak) from the tails of positives, easy and hard negatives, and doubtful rows."""
    floor = floor_quantile(pos, 0.05)
    hard_ceiling = floor_quantile(hard_neg, 0.9)
    ceiling = max(floor_quantile(easy, 0.95), hard_ceiling)
    hard = min(floor * 0.5 if ceiling >= floor else ceiling + 0.25 * (floor - ceiling), HARD_AT_MOST)
    doubtful = weak_rows[weak_rows > max(ceiling, 0.05)] if len(weak_rows) else weak_rows
    weak_ceiling = floor_quantile(doubtful, 0.9)
    middle = math.sqrt(weak_ceiling * floor) if hard < weak_ceiling < floor else floor * 0.9
    weak = min(max(middle, hard_ceiling, hard), max(floor_quantile(pos, 0.5), hard))
    return hard, min(WEAK_AT_MOST, max(weak, hard + WEAK_BAND))


def calibrate(rows: DataFrame, features: tuple[str, ...] = FEATURES, seed: int = 0x0CF01D, most: int = 2_000) -> Calibration | None:
    """A model from probe queries, or None where it can't tell them apart.

    ``rows``: ``features``, ``label`` (1 answerable, 0 not, -1 doubtful), ``kind``
    (positive, easy, hard or weak) and ``gibberish``.  Probes are few (``most`` at
    most are read, by a hash of their text): they are fitted on the driver.  Five
    folds, left out in turn, say whether the model is used at all.
    """
    columns = [*features, "label", "kind", "gibberish"]
    picked = rows.orderBy(F.xxhash64("text"), "text").limit(most).select(*columns).toPandas()
    x = picked[list(features)].to_numpy(float)
    label, kind = picked["label"].to_numpy(int), picked["kind"].to_numpy(str)
    weight = np.where(picked["gibberish"].to_numpy(bool), GIBBERISH_WEIGHT, 1.0)
    used = np.flatnonzero(label >= 0)
    if (label == 1).sum() < LEAST_POSITIVES or not (label == 0).any():
        return None
    mean, std, w, b = fit_logistic(x[used], label[used], weight[used])
    score = lambda m, r: 1 / (1 + np.exp(-((x[r] - m[0]) / m[1] @ m[2] + m[3])))
    order = np.array(seeded_sample(used.tolist(), len(used), seed))
    left, seen = np.full(len(x), np.nan), []
    for fold in range(FOLDS):
        test, train = order[fold::FOLDS], np.concatenate([order[f::FOLDS] for f in range(FOLDS) if f != fold])
        if len(test) and {0, 1} <= set(label[train]):
            left[test] = score(fit_logistic(x[train], label[train], weight[train]), test)
            seen += test.tolist()
    seen = np.array(seen, int)
    of = lambda mask: left[seen[mask[seen]]]
    pooled, hard_area = area(of(label == 1), of(label == 0)), area(of(label == 1), of((label == 0) & (kind == "hard")))
    if pooled is None or pooled < LEAST_AUC or (hard_area is not None and hard_area < LEAST_HARD_AUC):
        return None
    p = score((mean, std, w, b), np.arange(len(x)))
    hard, weak = thresholds(p[label == 1], p[(label == 0) & (kind == "easy")], p[(label == 0) & (kind == "hard")], p[label == -1])
    name = lambda v: dict(zip(features, map(float, v)))
    return Calibration(name(mean), name(std), name(w), float(b), hard, weak, {"auc": pooled, "hard_auc": hard_area, "probes": len(x)})
