"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can
never be merged, whatever surrounds them: between them every encoding cuts.
Words are split there, the fragments are encoded one by one and remembered, and
their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, text_or_empty
from .packing import _byte_characters as byte_characters

#: Bytes that one Python worker holds of words, and of fragments.
WORD_BYTES, FRAGMENT_BYTES = 160 << 20, 48 << 20
#: A line of Latin letters and then marks, which the library would cut into one
#: word and one run of marks, in lower case; or any other line.
LINE = re.compile("^(?:([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]*)([.,;:!?]*)|(.*))$", re.M)
#: Ends a word where words are bytes; UTF-8 never has it.
END = 255
#: Bytes beyond which a fragment is merged with a heap.
LONG_FRAGMENT = 400
#: Runs of one text that are encoded at once.
RUNS = 1 << 16

Entry = tuple[int, str, str]  # ids, the ids and the tokens, both joined by spaces


class ForcedBoundaryBPE:
    """A BPE tokenizer file (``tokenizers`` format) with words marked at their end.

    Normalising and cutting into words are the library's own.  The normaliser must
    work character by character and the word pattern must never cross white space,
    so that texts can be cut at ASCII white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(self.merges):
            self.ranks.setdefault(merge, rank)
        self.characters = byte_characters()
        self.byte_of = {c: b for b, c in self.characters.items()}
        self.inside = self._inside()
        self.native = self._native()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must match as they are written")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted((t.content for t in added.values()), key=len, reverse=True))) + ")") if added else None
        self.special_of = {t.content: (1, str(i), t.content) for i, t in added.items()}
        self.lowers = False
        if self.tokenizer.normalizer and self.tokenizer.pre_tokenizer:
            probe = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str("ABÉßz.,;:!?"))
            self.lowers = [w for w, _ in probe] == ["".join(self.characters[b] for b in w.encode()) for w in ("abéßz", ".,;:!?")]
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        self.fragments = Memo(self._fragment, FRAGMENT_BYTES, 330, 10)
        self.words = Memo(lambda run: self._learn([run])[run], WORD_BYTES, 330, 10)

    def symbols(self, token: str) -> list[str]:
        """Characters (each one byte) of a token, the word-end mark with the last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _inside(self) -> np.ndarray:
        """By left byte, right byte and "the right one ends a word": whether a token has them side by side."""
        inside = np.zeros((256, 256, 2), bool)
        inside[:, END] = True  # the mark belongs to the byte before it
        for token in self.vocabulary:
            for left, right in itertools.pairwise(self.symbols(token)):
                if len(left) == 1 and left in self.byte_of and right[0] in self.byte_of:
                    inside[self.byte_of[left], self.byte_of[right[0]], int(len(right) > 1)] = True
        inside[END] = False
        return inside.reshape(-1)

    def _native(self) -> tuple[Callable[[bytes], list[int]], list[int]] | None:
        """(a byte-pair merger over this vocabulary's own ranks, its ranks' ids), or None.

        The merger joins two parts whenever their bytes are a token.  That is the
        same as following the merge list if every token has one merge and encodes
        to itself: then no other pair of parts with its bytes is ever left apart.
        """
        import tiktoken

        if not self.suffix:
            return None
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, END]): 256 + b for b in range(256) if b != END}
        try:
            ids = [self.vocabulary[self.characters[b]] for b in range(256)]
            ids += [self.vocabulary[self.characters[b] + self.suffix] for b in range(256)]
            for rank, (left, right) in enumerate(self.merges, 512):
                symbols = self.symbols(left + right)
                token = bytes(self.byte_of[s[0]] for s in symbols)
                ids.append(self.vocabulary[left + right])
                if END in token:
                    return None
                ranks[token + (bytes([END]) if len(symbols[-1]) > 1 else b"")] = rank
        except KeyError:
            return None
        if len(ranks) != len(ids) - 1 or not all(self.merge(self.symbols(a + b)) == [self.vocabulary[a + b]] for a, b in self.merges):
            return None
        encoding = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        return encoding._encode_single_piece, ids

    def merge(self, symbols: list[str]) -> list[int]:
        """Ids of one fragment, by merges of the lowest rank first, leftmost first."""
        return [self.vocabulary[s] for s in self._merge_long(symbols) if s in self.vocabulary]

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """Merges kept in a heap, so that a long fragment costs no square of its length."""
        ranks, after, before = self.ranks, [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (rank, a, symbols[a], symbols[b]))
        return [s for s in symbols if s]

    def _fragment(self, fragment: bytes) -> Entry:
        """One fragment, with ``END`` as its last byte where a word ends."""
        if self.native and len(fragment) <= LONG_FRAGMENT:
            merge, of_rank = self.native
            ids = [of_rank[r] for r in merge(fragment)]
        else:
            ends = fragment.endswith(b"\xff")
            ids = self.merge(self.symbols("".join(self.characters[b] for b in (fragment[:-1] if ends else fragment)) + (self.suffix if ends else "")))
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def cut(self, blob: bytes) -> np.ndarray:
        """Where the fragments of words, each closed by ``END``, end."""
        a = np.frombuffer(blob, np.uint8).astype(np.int32)
        code = a[:-1] * 512 + a[1:] * 2
        code[:-1] += a[2:] == END
        return np.append(np.flatnonzero(~self.inside[code]) + 1, len(a))

    def _learn(self, runs: list[bytes]) -> dict[bytes, Entry]:
        """Entries of runs without white space."""
        words: list[bytes] = []
        upto = []  # words of the runs so far
        for letters, marks, other in LINE.findall(b"\n".join(runs).decode()) if self.lowers else [("", "", r.decode()) for r in runs]:
            if not other:
                words += [w.encode() for w in (letters.lower(), marks) if w]
            else:
                other = self.tokenizer.normalizer.normalize_str(other) if self.tokenizer.normalizer else other
                words += [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(other)]
            upto.append(len(words))
        if not words:
            return dict.fromkeys(runs, (0, "", ""))
        blob = b"\xff".join([*words, b""])
        ends = self.cut(blob).tolist()
        found = [self.fragments[blob[a:b]] for a, b in zip([0, *ends], ends)]
        closed = np.flatnonzero(np.frombuffer(blob, np.uint8)[np.array(ends) - 1] == END) + 1  # fragments up to each word's end
        last = np.concatenate(([0], closed))[upto].tolist()
        return {run: found[a] if b == a + 1 else _joined(found[a:b]) for run, a, b in zip(runs, [0, *last], last)}

    def _plain(self, text: str) -> Iterator[Entry]:
        """Entries of a text without added tokens, a bounded number of runs at a time."""
        runs, words = text.encode().split(), self.words
        for at in range(0, len(runs), RUNS):
            part = runs[at : at + RUNS]
            entries = list(map(words.get, part))
            if None in entries:
                known = {r: words.old.get(r) for r, e in zip(part, entries) if e is None}
                known |= self._learn([r for r, e in known.items() if e is None])
                words.remember(known)
                entries = [known[r] if e is None else e for r, e in zip(part, entries)]
            yield _joined(entries)

    def encode(self, text: str) -> Entry:
        """(number of ids, ids joined by spaces, decoded text)."""
        if not self.special or not self.special.search(text):
            return _joined(list(self._plain(text)))
        parts: list[Entry] = []
        for part in self.special.split(text):  # the library cuts at added tokens first
            parts += [self.special_of[part]] if part in self.special_of else self._plain(part)
        return _joined(parts)


def _joined(entries: list[Entry]) -> Entry:
    if not entries:
        return 0, "", ""
    if (0, "", "") in entries:
        entries = [e for e in entries if e[0]] or [(0, "", "")]
    counts, ids, tokens = zip(*entries)
    return sum(counts), " ".join(ids), " ".join(tokens)


_workers: dict[str, ForcedBoundaryBPE] = {}


def bpe_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``full`` also ``ids`` (array of int) and ``decoded``.  Null and empty
    texts have no tokens.  A text of any length is encoded whole, ``RUNS`` runs at
    a time; a fragment of any length is merged in n log n.  Null ids and repeated
    rows keep their row, an empty table gives none, other columns are not read.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _workers:
            _workers[tokenizer] = ForcedBoundaryBPE(tokenizer)
        encoder, digest = _workers[tokenizer], lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids_digest, text_digest, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                count, ids, tokens = encoder.encode(text)
                n.append(count)
                ids_digest.append(digest(ids))
                text_digest.append(digest(tokens))
                if full:
                    all_ids.append([int(i) for i in ids.split()])
                    decoded.append(tokens)
            columns = [pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if full else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return map_batches(rows, run, schema)
