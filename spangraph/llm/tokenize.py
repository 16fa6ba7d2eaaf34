"""Encoding a corpus with a public byte-level tokenizer.

A text is split into pieces by the tokenizer's pattern. A blank that a visible character follows always
begins a piece, so texts are first cut there with a plain split, and each stretch between two such blanks is
encoded once per worker and kept in a bounded memo, since stretches repeat. A piece's bytes are mapped to Latin-1 characters, so that an
Aho-Corasick automaton over text gives the longest token starting at every byte. From the longest match
the encoder steps back to shorter prefixes until the token is compatible with the one before it: a pair of
adjacent tokens is compatible when merging their bytes by rank would never have joined across the border.
Pair results are memoised, so that the work stays linear in the piece, and the ids are exactly those that
repeated merging by rank gives.

Defined results: empty and null texts give an empty list; no special tokens are ever made, their strings
are ordinary text; repeated rows each keep theirs; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_SIZE = 500_000


#: A blank that begins no piece: white space or the end follows.
LOOSE_BLANK = r" (?:\s|\Z)"


class Encoder:
    """Pieces of text to ids, for one vocabulary."""

    def __init__(self, vocabulary: bytes, memo_size: int = MEMO_SIZE) -> None:
        import ahocorasick

        self.memo_size = memo_size
        self.known: dict[str, list[int]] = {}
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.ranks = ranks
        self.words = words = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for rank, token in words.items():
            n = len(token) - 1
            while n > 0 and token[:n] not in ranks:
                n -= 1
            self.shorter[rank] = ranks[token[:n]] if n > 0 else -1
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(words):
            self.halves[rank] = self._halves(rank)

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: the only compatible pair of lower ranks."""
        token = self.words[rank]
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if left < rank and right < rank and self._compatible(left, right, rank):
                return left, right
        return rank, rank

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """No merge of a rank below ``limit`` joins across the border of the two tokens.

        The border is undone merge by merge: the half that was made last is opened first, and what
        lies on the two sides must not make a token that would have been merged earlier.
        """
        ranks, words, halves = self.ranks, self.words, self.halves
        while True:
            joined = ranks.get(words[left] + words[right])
            if joined is not None and joined < limit:
                return False
            left_parts, right_parts = halves[left], halves[right]
            open_left, open_right = left_parts[0] != left, right_parts[0] != right
            if not open_left and not open_right:
                return True
            if open_left and (left > right or not open_right):
                limit, left = min(limit, left), left_parts[1]
            else:
                limit, right = min(limit, right + 1), right_parts[0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.memo_size:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right, 1 << 31)
        return known

    def ids(self, piece: str) -> list[int]:
        out = self.known.get(piece)
        if out is None:
            out = self.encode(piece)
            if len(piece) <= 64:
                if len(self.known) >= self.memo_size:
                    self.known.clear()
                self.known[piece] = out
        return out

    def encode(self, piece: str) -> list[int]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        words, shorter = self.words, self.shorter
        longest = [0] * len(text)
        for end, rank in self.automaton.iter(text):
            longest[end + 1 - len(words[rank])] = rank
        out: list[int] = []
        dead = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            while token != -1:
                end = at + len(words[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token == -1:
                dead[at] = 1
                last = out.pop()
                at -= len(words[last])
                token = shorter[last]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
        return out


class Stretches(dict):
    """A stretch of text, without the blank before it, to the bytes of its ids (32-bit integers)."""

    def __init__(self, encoder: Encoder, pattern: str, blank: str) -> None:
        import regex

        super().__init__()
        self.encoder, self.blank, self.split = encoder, blank, regex.compile(pattern).findall

    def __missing__(self, stretch: str) -> bytes:
        ids = array("i", [i for piece in self.split(self.blank + stretch) for i in self.encoder.ids(piece)]).tobytes()
        if len(stretch) <= 64:
            if len(self) >= self.encoder.memo_size:
                self.clear()
            self[stretch] = ids
        return ids


class Texts:
    """Whole texts to the bytes of their ids."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, memo_size: int = MEMO_SIZE) -> None:
        encoder = Encoder(vocabulary, memo_size)
        self.first, self.next = Stretches(encoder, pattern, ""), Stretches(encoder, pattern, " ")
        self.loose = re.compile(LOOSE_BLANK).search

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        if self.loose(text):
            whole = [parts[0]]
            for part in parts[1:]:
                if part and not self.loose(" " + part[0]):
                    whole.append(part)
                else:
                    whole[-1] += " " + part
            parts = whole
        return self.first[parts[0]] + b"".join(map(self.next.__getitem__, parts[1:]))


@cache
def _texts(vocabulary: bytes, pattern: str, memo_size: int) -> Texts:
    return Texts(vocabulary, pattern, memo_size)


def encode_corpus(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, memo_size: int = MEMO_SIZE
) -> DataFrame:
    """(doc_id, ids): the token ids of each text. ``vocabulary`` is a file of base64 tokens and ranks.

    The vocabulary file (under 1 MB, its size does not depend on the corpus) is broadcast, so that
    executors need no copy of it. One narrow pass over the corpus, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = _texts(shared.value, pattern, memo_size)
        for batch in batches:
            made = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(m) // 4 for m in made], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(made))])
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
