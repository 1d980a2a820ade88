"""Fuzzy search for short licence notices.

A notice of which at most k characters may be edited is cut into k + 1 pieces; by
the pigeonhole principle one piece is intact, so exact seeds locate every
candidate.  Around each, bounded-error matching of the ``regex`` library
verifies the edits and reports the span.  Words that tell licences apart ("mit",
"2", "nc") have bounds of their own, so that edits can't turn one into another.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, text_or_empty

#: Exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Notice(NamedTuple):
    """A notice, its label, the characters that may be edited, and the words that tell it from other licences."""

    text: str
    label: str
    edits: int
    words: tuple[str, ...] = ()


#: Notices found with up to so many edited characters.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("permission is hereby granted free of charge to any person", "mit", 4),
    Notice("apache license version 2", "apache-2", 2, ("apache", "2")),
    Notice("licensed under the apache license", "apache", 3, ("apache",)),
    Notice("licensed under cc by nc", "cc-by-nc", 2, ("cc", "by", "nc")),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4, ("attribution", "noncommercial")),
    Notice("under the gnu general public license", "gpl", 3, ("gnu", "general")),
    Notice("gnu lesser general public license", "lgpl", 3, ("gnu", "lesser")),
    Notice("mozilla public license version 2", "mpl-2", 3, ("mozilla", "2")),
    Notice("redistribution and use in source and binary forms", "bsd", 4, ("redistribution",)),
    Notice("all rights reserved", "all-rights-reserved", 1, ("rights",)),
)


def word_edits(word: str) -> int:
    """Edits that leave a distinguishing word itself: none in numbers and words of one or two letters."""
    return 0 if len(word) < 3 or word.isdigit() else 1 if len(word) < 8 else 2


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def seeds(text: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece): ``edits + 1`` pieces, of which one survives that many edits."""
    cut = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
    return [(a, text[a:b].encode()) for a, b in zip(cut, cut[1:])]


class LicenseScanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = [(n, seeds(n.text, n.edits), regex.compile(b"(?e)(?:%s){e<=%d}" % (n.text.encode(), n.edits))) for n in notices]
        known = {w for n in notices for w in n.words}
        self.told = {w: regex.compile(b"(?:%s){e<=%d}" % (w.encode(), word_edits(w))) for w in known}

    def tells(self, notice: Notice, words: bytes, start: int, end: int) -> bool:
        """Whether the words of a span, whole ones, have the notice's distinguishing words among them."""
        stop = words.find(b" ", end)
        span = words[words.rfind(b" ", 0, start + 1) + 1 : stop if stop >= 0 else len(words)]
        held = span.split()
        return all(any(self.told[w].fullmatch(h) for h in held) or len(w) > 2 and w.encode() in span for w in notice.words)

    def exact(self, words: bytes) -> list[tuple[int, str]]:
        """(offset, label) of phrases in words joined, begun and ended by one space."""
        found = []
        for phrase, label in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = words.find(phrase, at + 1)
        return found

    def fuzzy(self, words: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of every notice, found around its seeds."""
        found = []
        for notice, pieces, pattern in self.notices:
            windows: list[list[int]] = []
            for offset, piece in pieces:
                at = words.find(piece)
                while at >= 0:
                    windows.append([max(0, at - offset - notice.edits), at - offset + len(notice.text) + notice.edits])
                    at = words.find(piece, at + 1)
            windows.sort()
            merged: list[list[int]] = []
            for w in windows:
                if merged and w[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], w[1])
                else:
                    merged.append(w)
            for a, b in merged:
                while m := pattern.search(words, a, min(b, len(words))):
                    if self.tells(notice, words, m.start(), m.end()):
                        found.append((m.start(), m.end(), notice.label, sum(m.fuzzy_counts)))
                        a = m.end()
                    else:  # another licence: a notice may still begin inside
                        a = m.start() + 1
        return found

    def scan(self, text: bytes) -> dict:
        tokens = text.translate(_LETTERS).split()
        words = b" ".join((b"", *tokens, b""))
        exact, fuzzy = self.exact(words), self.fuzzy(words)
        number = None
        if exact or fuzzy:
            spaces, at = [], words.find(b" ")
            while at >= 0:
                spaces.append(at)
                at = words.find(b" ", at + 1)
            number = lambda place: bisect_right(spaces, place) - 1  # noqa: E731  the word at an offset
        places = sorted(number(at) for at, _ in exact)
        nearest = [1 - e / (b - a) for a, b, _, e in fuzzy if b > a]
        base = sorted({label for _, label in exact})
        return {
            "n_words": len(tokens),
            "n_base": len(places),
            "first_word": places[0] if places else None,
            "last_word": places[-1] if places else None,
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(label for _, _, label, _ in fuzzy)})),
            "score": 1.0 if exact else max(nearest, default=0.0),
            "spans": [{"label": label, "first": number(a), "last": number(max(a, b - 1)), "edits": e} for a, b, label, e in sorted(fuzzy)],
        }


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))
COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": SPANS}


def license_scan(
    df: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: word counts, exact places, labels and fuzzy spans.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII
    characters.  ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come
    from exact phrases; ``labels`` adds those of fuzzy notices, whose word spans
    and edits are in ``spans``.  ``score`` is 1 for an exact phrase, else the share
    of unedited characters of the best notice, else 0.  Null and empty texts have
    no words, no labels and a score of 0; a text of any length is searched whole;
    null ids and repeated rows keep their row, an empty table gives none; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, notices)
        for batch in batches:
            rows = [scanner.scan(text) for text in as_bytes(batch.column(1))]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *COLUMNS])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:bigint,last:bigint,edits:bigint>>"
    )
    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, schema)
