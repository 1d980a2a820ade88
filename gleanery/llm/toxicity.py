"""Toxicity of restored text: a noisy channel undoes disguises before scoring.

A disguised word (leetspeak, letters spaced apart, stretched letters) is a
lattice of the letters that its characters may stand for.  Viterbi decoding under
a character language model of the corpus picks the likeliest reading, and the
reading is scored by a lexicon learnt from labelled documents.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, shared_table, text_or_empty

#: Labelled rows of each class that training reads, at most: the bounded sample.
MAX_LABELLED = 5_000
#: A feature occurs in so many toxic sample documents at least, and is so strongly on their side (a G statistic).
MIN_SUPPORT, MIN_STRENGTH = 3, 3.0
#: A feature of so many toxic sample documents, hardly ever seen in clean ones, convicts a document alone.
SURE_SUPPORT, SURE_PRECISION = 20, 0.98
#: Letters of word beginnings that are features beside the whole word, each also as
#: "in at least 2" and "in at least 3 words".
PREFIXES, LEVELS = (3, 4, 5, 6, 7), 3
#: Ridge penalty, steps and rate of the logistic fit.
RIDGE, STEPS, RATE = 2e-3, 400, 0.1
THRESHOLD = 0.3
#: Bytes of words, and of decoded forms, that one Python worker remembers.
WORD_BYTES, FORM_BYTES = 96 << 20, 24 << 20

#: What a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "&": "a", "*": "aeiou", "#": "aeiou",
}
#: Channel costs (negative log probabilities) of reading a stretched letter shorter,
#: of a doubled letter that was meant single, and of leaving a disguise as it is.
STRETCH, DOUBLE, PLAIN = 0.2, 3.0, 4.0

STRIP = ".,;:!?\"'()[]{}<>«»“”„‘’¿¡…-_*~`/\\|"
#: Four or more single letters, digits or symbols that may be letters, with white space or separators between.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€(<&#])(?:[\s.\-_*·]{1,3}(?:[^\W_]|[@$!|+€(<&#])){3,}(?![^\W_])")
APART = re.compile(r"[\s.\-_*·]")
#: Symbols repeated at the ends of a word decorate it.
DECORATION = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
#: A letter beside a symbol or digit that may be a letter, a letter three times, letters with separators.
DISGUISED = re.compile(r"[^\W\d_].*[0-9@$|+€(<&*#!]|[0-9@$|+€(<&*#!].*[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*·][^\W\d_]")
_RUNS = re.compile(r"(.)\1*", re.S)
INNER = re.compile(r"[.\-_*·]")
DOUBLED = re.compile(r"([^\W\d_])\1")
#: Signs at the ends of a word that stand for no letter.
EDGES = "".join(c for c in STRIP if c not in LEET)

_CODES = 64


def _alphabet() -> tuple[np.ndarray, dict[str, int]]:
    """Latin-1 bytes to codes: 0 ends a word, letters follow, all else is 63."""
    table = np.full(256, 63, np.int64)
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    for i, c in enumerate(letters[:61], 1):
        table[ord(c)] = i
    for c in " \t\n\r\x0b\x0c":
        table[ord(c)] = 0
    for c in STRIP:
        if ord(c) < 256:
            table[ord(c)] = 0
    return table, {chr(b): int(table[b]) for b in range(256)}


BYTE_CODES, CHAR_CODES = _alphabet()


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: character trigrams of all lower-cased texts; at most 64^3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)

        def count(parts: list[str]) -> None:
            ends = np.cumsum([len(p) for p in parts])
            c = BYTE_CODES[np.frombuffer("".join(parts).encode("latin-1", "replace"), np.uint8)]
            grams = (c[:-2] * _CODES + c[1:-1]) * _CODES + c[2:]
            across = np.concatenate((ends[:-1] - 2, ends[:-1] - 1))  # those that two parts share
            total[:] += np.bincount(np.delete(grams, across), minlength=_CODES**3)

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                for at in range(0, max(1, len(text)), 1 << 20):
                    held.append(" " + text[max(0, at - 2) : at + (1 << 20)].lower() + " ")
                    size += len(held[-1])
                    if size > 1 << 21:
                        count(held)
                        held, size = [], 0
            if held:
                count(held)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["gram", "n"])

    return map_batches(df.select(text_or_empty(text_col).alias("text")), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """-log P(c | a, b) as float32 [a, b, c], interpolated with bigrams and unigrams.

    The table has a fixed size: what reaches the driver doesn't grow with the corpus.
    """
    n3 = np.zeros(_CODES**3)
    rows = counts.toArrow()
    n3[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    n3 = n3.reshape(_CODES, _CODES, _CODES)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + _CODES)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return (-np.log((n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5))).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character: readings and their channel costs."""
    out, i = [], 0
    while i < len(word):
        j = i + 1
        while j < len(word) and word[j] == word[i]:
            j += 1
        char, n = word[i], j - i
        options = []
        for reading in LEET.get(char, "") if char in LEET else char:
            if n == 1:
                options.append((reading, 0.0))
            elif n == 2:
                options += [(reading * 2, 0.0), (reading, DOUBLE if char not in LEET else 1.0)]
            else:
                options += [(reading, STRETCH), (reading * 2, STRETCH)]
        if char in LEET:
            options.append((char * n, PLAIN * n))
        out.append(options)
        i = j
    return out


def viterbi(word: str, model, breaks: bool = False) -> str:
    """The likeliest reading of a word's lattice; ``model`` is nested [a][b][c].

    With ``breaks`` a space may come before every letter: the model chooses where.
    """
    # a reading is a chain of (what came before, last part): words may be long
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, options in enumerate(lattice(word)):
        if breaks:
            split = [(f"{r[0]} {r[1:]}", c) for r, c in options if len(r) == 2 and r[0] == r[1]]
            options = options + split
            options = options + [(" " + r, c) for r, c in options] if i else options
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, chain) in states.items():
            for reading, channel in options:
                x, y, total = a, b, cost + channel
                for char in reading:
                    z = CHAR_CODES.get(char, 63)
                    total += model[x][y][z]
                    x, y = y, z
                if (known := after.get((x, y))) is None or total < known[0]:
                    after[x, y] = (total, (chain, reading))
        states = after

    def text(chain: tuple | None) -> str:
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return "".join(reversed(parts))

    ends = [(cost + model[a][b][0], chain) for (a, b), (cost, chain) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(text(chain) for cost, chain in ends if cost == least)


def one_double(form: str) -> int:
    """Where the only doubled letter of a form of letters is; -1 where there is none, another or a longer run."""
    if not form.isalpha() or not (found := DOUBLED.search(form)):
        return -1
    at, after = found.span()
    return -1 if form[after : after + 1] == form[at] or DOUBLED.search(form, after) else at


def undoubled(word: str, at: int, model) -> str:
    """``viterbi`` of a word of letters whose only run is two at ``at``: after the next letter both readings go on alike."""
    x, y, cost = 0, 0, 0.0
    for char in word[:at]:
        z = CHAR_CODES.get(char, 63)
        cost += model[x][y][z]
        x, y = y, z
    z = CHAR_CODES.get(word[at], 63)
    two, one = cost + model[x][y][z] + model[y][z][z], cost + DOUBLE + model[x][y][z]
    if y != z:
        after = CHAR_CODES.get(word[at + 2], 63) if at + 2 < len(word) else 0
        two, one = two + model[z][z][after], one + model[y][z][after]
    short = word[:at] + word[at + 1 :]
    return short if one < two or one == two and y != z and at + 2 == len(word) else word


def may_count(form: str, known: set[str]) -> bool:
    """Whether some reading of a form of letters has a feature of ``known``; true as well where there are too many readings to try."""
    begun = {""}
    for run in _RUNS.finditer(form):
        char, n = run.group()[0], len(run.group())
        begun = {b + char for b in begun} if n == 1 else {b + reading for b in begun for reading in (char, char * 2)}
        if len(begun) > 64:
            return True
    return any(not known.isdisjoint(word_features(b)) for b in begun)


def may_begin(form: str, starts: set[str]) -> bool:
    """Whether some reading of a form, stripped of signs at its ends or not, begins with three characters of ``starts``.

    Three runs give three characters of every reading; a shorter one, or one whose
    rest is signs, ends with the mark of a whole word.  Signs that a reading may
    begin with are stripped later, so runs of them are looked past as well.
    """
    if len(form) > 5 and form.isalpha() and not DOUBLED.search(form[:4]):
        return form[:3] in starts  # three single letters have one reading
    runs = list(_RUNS.finditer(form))
    for first in range(len(runs)):
        begun = {""}
        for at, run in enumerate(runs[first : first + 3]):
            begun = {b if len(b) > 2 else b + reading for b in begun for reading, _ in lattice(run.group())[0]}
        if any((b + "$")[:3] in starts or (b.rstrip(STRIP) + "$")[:3] in starts for b in begun):
            return True
        if runs[first].group()[0] not in STRIP:
            return False
    return False


def word_features(word: str) -> list[str]:
    """The whole word (marked by its end) and its beginnings."""
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


def text_features(words) -> set[str]:
    """Features of a text's distinct words, with the number of words at their end."""
    counts: dict[str, int] = {}
    for word in words:
        for feature in word_features(word):
            counts[feature] = counts.get(feature, 0) + 1
    return {f"{f}{n}" for f, most in counts.items() for n in range(1, min(most, LEVELS) + 1)}


class Restorer:
    """Words of a text with disguises undone."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()  # single cells of lists are read faster
        self.whole = Memo(lambda form: viterbi(form, self.model), FORM_BYTES)
        self.broken = Memo(lambda form: viterbi(form, self.model, True), FORM_BYTES)

    def decoded(self, form: str, breaks: bool = False) -> str:
        """The likeliest reading."""
        return (self.broken if breaks else self.whole)[form]

    def readings(self, token: str, starts: set[str] | None = None, known: set[str] | None = None) -> list[str]:
        """The plain word of a white-space token, then what it may disguise.

        With ``known`` features and their ``starts`` forms are left undecoded of which
        no reading, however unlikely, can have a known feature.
        """
        if token.isalpha() and not DOUBLED.search(token):
            return [token]  # as below: nothing of it is stripped
        plain = token.strip(STRIP)
        edged = token.strip(EDGES)
        if edged == plain and plain.isalpha() and not DOUBLED.search(plain):
            return [plain]  # its lattice has one path
        core = DECORATION.sub("", token).strip(".,;:?\"'*_~`/\\-")
        core = core.rstrip("!") if core.rstrip("!")[-1:].isalpha() else core
        words = [plain] if plain else []
        if core != plain and core.strip(STRIP).isalpha() and core.strip(STRIP) != plain:
            words.append(core.strip(STRIP))
        for form in dict.fromkeys((core, INNER.sub("", core), edged)):
            if (at := one_double(form)) >= 0 and len(form) > 2:  # decoded sooner than looked into
                word = undoubled(form, at, self.model)
                words += [w for w in (word,) if w not in words]
            elif len(form) > 2 and (DISGUISED.search(form) or DOUBLED.search(form)) and (starts is None or may_begin(form, starts) and (not form.isalpha() or may_count(form, known))):
                word = self.decoded(form)
                # symbols left as they are at the ends are no part of the word
                words += [w for w in dict.fromkeys((word, word.strip(STRIP)) if form != edged else (word.strip(STRIP),)) if w and w not in words]
        return words

    def spaced(self, text: str) -> list[str]:
        """Words whose letters stand apart: a run as one word, and as the words that the model sees in it."""
        out = []
        for match in SPACED.finditer(text):
            letters = APART.sub("", match.group())
            out.append(self.decoded(letters))
            out += self.decoded(letters, True).split()
        return out

    def words(self, text: str) -> set[str]:
        text = text.lower()
        found = {w for token in set(text.split()) for w in self.readings(token)}
        found.update(self.spaced(text))
        return found


class Lexicon(NamedTuple):
    """Weights and intercept of a logistic classifier, and the precision of sure features."""

    weights: dict[str, float]
    intercept: float
    sure: dict[str, float]


def restored(sample: DataFrame, model: np.ndarray) -> DataFrame:
    """``words, toxic`` of ``text, toxic``: each text's distinct words with disguises undone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            found = [sorted(restorer.words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["words", "toxic"])

    return map_batches(sample.select("text", "toxic"), run, "words array<string>, toxic int")


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """``feature, n``: documents (rows of ``words``) that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])
            counts.clear()
            return out

        for batch in batches:
            for words in batch.column(0).to_pylist():
                for feature in text_features(words):
                    if only is None or feature in only:
                        counts[feature] = counts.get(feature, 0) + 1
            if len(counts) > 200_000:
                yield sent()
        yield sent()

    return map_batches(rows.select("words"), run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _sketch(df: DataFrame) -> DataFrame:
    """Adds ``sketch``: equal for copies, and mostly for near copies (the least hash of 5-word shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            least = []
            for text in batch.column(1).to_pylist():
                w = text.lower().split()
                least.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["doc_id", "text", "toxic", "sketch"])

    return map_batches(df, run, "doc_id long, text string, toxic int, sketch long")


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, toxic`` of the labelled rows that may be learnt from; an id with both labels counts as toxic."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled_sample(df: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, toxic``: at most ``limit`` training documents of each class, near copies once.

    Held-out rows (see ``held_out``) are never among them.  The sample goes by a
    hash of the id, so it is the same in every run; its bounded size is what
    allows its ids to be broadcast.
    """
    known = training_labels(labels, id_col)
    by_hash = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit) for y in (0, 1)]
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    chosen = texts.join(F.broadcast(by_hash[0].union(by_hash[1])), "doc_id").select("doc_id", "text", "toxic")
    once = _sketch(chosen).groupBy("sketch", "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    return once.select("text", "toxic")


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def _strength(n: int, m: int, toxic: int, clean: int) -> float:
    """Signed G statistic of a feature in n of ``toxic`` and m of ``clean`` documents."""
    share = (n + m) / (toxic + clean)
    part = lambda k, of: k * math.log(k / (of * share)) if k else 0.0
    g = part(n, toxic) + part(m, clean)
    return g if n * clean > m * toxic else -g


def fit(sizes: np.ndarray, columns: np.ndarray, toxic: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of binary sparse rows (Adam, full batch).

    Row i has the next ``sizes[i]`` of ``columns``.
    """
    n, rows = max(1, len(sizes)), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    w, moment, square = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[columns], len(sizes)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        gradient = np.append(np.bincount(columns, error[rows], features), error.sum())
        gradient[:-1] += RIDGE / n**0.5 * w[:-1]
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(sample: DataFrame, model: np.ndarray, shares: dict[int, int] | None = None) -> Lexicon:
    """A classifier from ``text, toxic``.

    Candidates are features of toxic documents; clean documents are counted for
    these alone, and those on the toxic side feed a logistic fit.  ``shares`` are
    the class sizes of all labelled rows, for the intercept.  All of it is bounded
    by the size of the sample, whose texts are restored once.
    """
    sample = shared_table(restored(sample, model), "restored")
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, -8.0, {})
    counted = lambda rows, only: dict(zip(*(c.to_pylist() for c in rows.transform(_counted, only).toArrow().columns)))
    top = _counted(toxic, None).where(F.col("n") >= MIN_SUPPORT).toArrow()
    n_toxic = dict(zip(*(c.to_pylist() for c in top.columns)))
    n_clean = counted(clean, frozenset(n_toxic))
    strength = {f: _strength(n, n_clean.get(f, 0), n1, n0) for f, n in n_toxic.items()}
    names = sorted((f for f in strength if strength[f] > MIN_STRENGTH), key=lambda f: (-strength[f], f))
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(number[f] for f in text_features(words) if f in number) for words in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["hits", "toxic"])

    rows = map_batches(sample, run, "hits array<int>, toxic int").toArrow().combine_chunks()
    hits = rows.column("hits").combine_chunks()
    weights, intercept = fit(np.diff(hits.offsets.to_numpy()), hits.flatten().to_numpy(), rows.column("toxic").to_numpy().astype(float), len(names))
    if not (shares and shares.get(1) and shares.get(0)):
        shares = {1: n1, 0: n0}
    intercept += math.log(shares[1] / shares[0]) - math.log(n1 / n0)
    clean_weight = shares[0] / n0 * n1 / shares[1]  # clean documents that one of the sample stands for
    precision = {f: n_toxic[f] / (n_toxic[f] + clean_weight * n_clean.get(f, 0) + 1) for f in names if n_toxic[f] >= SURE_SUPPORT}
    sure = {f: p for f, p in precision.items() if p >= SURE_PRECISION or (p >= 0.95 and not n_clean.get(f, 0))}
    return Lexicon({f: float(w) for f, w in zip(names, weights) if w}, intercept, sure)


class Scorer:
    """Scores texts; words already seen are remembered."""

    def __init__(self, lexicon: Lexicon, model: np.ndarray):
        self.lexicon, self.restorer = lexicon, Restorer(model)
        known = self.known = {f[:-1] for f in lexicon.weights}
        starts = {f[:3] for f in known}
        # features by number, and the places of their levels among all weights in order: -1 where there is none
        self.names = sorted(lexicon.weights)
        self.values = [lexicon.weights[f] for f in self.names]
        self.sure = [lexicon.sure.get(f, 0.0) for f in self.names]
        place = {f: i for i, f in enumerate(self.names)}
        self.number = {f: i for i, f in enumerate(sorted(known))}
        self.places = np.array([[place.get(f"{f}{n}", -1) for n in range(1, LEVELS + 1)] for f in self.number], np.int64).reshape(-1, LEVELS)

        def hits(token: str) -> tuple[tuple[str, bytes], ...]:
            # a word without a known beginning of three letters has no known feature but itself
            words = self.restorer.readings(token, starts, known)
            return tuple((w, f) for w in words if (w + "$")[:3] in starts and (f := self.features(w)))

        self.cache = Memo(hits, WORD_BYTES, 260)
        self.same: dict[bytes, bytes] = {}  # words share their features: a known beginning implies its known beginnings

    def features(self, word: str) -> bytes:
        """Numbers of a word's known features."""
        number = self.number
        found = [number[f] for f in word_features(word) if f in number]
        packed = struct.pack(f"={len(found)}i", *found)
        return self.same.setdefault(packed, packed)

    def found(self, words: dict[str, bytes]) -> list[int]:
        """Places of the weights of a text's distinct words, in order."""
        counts = np.bincount(np.frombuffer(b"".join(words.values()), np.int32))
        numbers = np.flatnonzero(counts)
        places = self.places[numbers]
        return np.sort(places[(np.arange(LEVELS) < counts[numbers, None]) & (places >= 0)]).tolist()

    def score(self, text: str) -> float:
        text = text.lower()
        words = dict(chain.from_iterable(map(self.cache.__getitem__, set(text.split()))))
        words.update((w, self.features(w)) for w in self.restorer.spaced(text))
        found = self.found(words)
        z = self.lexicon.intercept + sum(map(self.values.__getitem__, found))
        sure = max(map(self.sure.__getitem__, found), default=0.0)
        return max(sure, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def train(df: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the character language model, both of bounded size."""
    model = language_model(trigram_counts(df))
    sample = shared_table(labelled_sample(df, labels, limit), "labelled")
    shares = {r["toxic"]: r["count"] for r in training_labels(labels).groupBy("toxic").count().collect()}
    return learn(sample, model, shares), model


def toxicity(df: DataFrame, trained: tuple[Lexicon, np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is scored, whole, whatever its length.  A null or empty text has
    the score of a text without any known feature; a null id isn't held out;
    repeated rows keep their rows; an empty table gives none; other columns are not
    read.
    """
    scored = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = map_batches(scored, scoring(trained, 1, ["doc_id", "score"], keep=[0]), "doc_id long, score double")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scoring(trained: tuple[Lexicon, np.ndarray], text_at: int, names: list[str], keep: list[int]) -> Callable:
    """A batch function that appends the score of a text column to the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*trained)
        for batch in batches:
            scores = [scorer.score(text or "") for text in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64())], names)

    return run


def reject_toxic(df: DataFrame, trained: tuple[Lexicon, np.ndarray], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores below the threshold."""
    names = df.columns
    score = "__score"
    while score in names:
        score += "_"
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    run = scoring(trained, names.index(text_col), [*names, score], keep=list(range(len(names))))
    return map_batches(df, run, f"{fields}, {score} double").where(F.col(score) < threshold).select(*[F.col(f"`{n.replace('`', '``')}`") for n in names])
