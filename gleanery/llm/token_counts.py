"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry failure links and the number of
pieces popped when a link is followed (Song et al., "Fast WordPiece
Tokenization", 2021).  Reading a word moves forward one character at a time and
adds popped counts, so greedy longest-match lengths come out in time linear in
the word, without building a single piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, text_or_empty

#: Bytes of words and their counts that one Python worker remembers.
CACHE_BYTES = 128 << 20


class WordPieceCounter:
    """Counts greedy longest-match pieces of words.

    ``initial`` pieces may start a word, ``suffix`` pieces may continue one.  A
    word that the vocabulary cannot spell counts as one unknown piece.
    """

    def __init__(self, initial: Iterable[str], suffix: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: inside a word
        final = [False, False]
        for root, pieces in ((0, initial), (1, suffix)):
            for piece in pieces:
                node = root
                for char in piece:
                    node = self.next[node].setdefault(char, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        final.append(False)
                if node > 1:
                    final[node] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for char, node in self.next[parent].items():
                if final[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and char not in self.next[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][char], popped
                queue.append(node)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if the vocabulary cannot spell it."""
        node, pieces = 0, 0
        following, fail, popped = self.next, self.fail, self.popped
        for char in word:
            while (to := following[node].get(char)) is None:
                if fail[node] < 0:
                    return 0
                pieces += popped[node]
                node = fail[node]
            node = to
        while node != 1:  # end of the word: pop what is left
            if fail[node] < 0:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


_workers: dict[str, Memo] = {}


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(word-initial pieces, which begin with the word mark; continuing pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [p for p in pieces if p.startswith("▁")], [p for p in pieces if "▁" not in p]


def _counts(path: str) -> Memo:
    """UTF-8 word -> pieces, an unknown word as -1."""
    if path not in _workers:
        counter = WordPieceCounter(*sentencepiece_vocabulary(path))
        _workers[path] = Memo(lambda word: counter.count("▁" + word.decode()) or -1, CACHE_BYTES, 180, 1)
    return _workers[path]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``; a word that the
    vocabulary cannot spell is one token and counts in ``n_unknown``.  A null or
    empty text has 0 of each; null ids and repeated rows keep their row; an empty
    table gives none.  A text of any length is read whole, in time linear in it.
    Other columns are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary)
        for batch in batches:
            words_n, tokens_n, unknown_n = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                # bytes.split() knows the ASCII white space only, as the words are defined
                found = list(map(counts.__getitem__, text.split()))
                unknown = found.count(-1)
                words_n.append(len(found))
                tokens_n.append(sum(found) + 2 * unknown)
                unknown_n.append(unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_n, pa.int64()), pa.array(tokens_n, pa.int64()), pa.array(unknown_n, pa.int64())],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, n_words long, n_tokens long, n_unknown long")
