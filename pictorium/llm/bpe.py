"""Byte-level BPE by longest matches and backtracking.

The vocabulary stands in an Aho-Corasick automaton over Latin-1 characters, one
for each byte. One pass over a piece finds every token at every place. The
encoder takes the longest token that may follow the one before it and steps
back to a shorter one where nothing fits; a place that led nowhere is never
tried again, so a piece takes time linear in its length. Whether two tokens may
stand side by side follows from undoing their merges from the latest on, and is
remembered. The result is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pictorium.llm import common

# Entries of a task's memories before they start anew.
WORDS_KEPT = 250_000
PAIRS_KEPT = 500_000

# A blank before another blank: the only texts that may not be cut before each blank.
_BLANKS = regex.compile(r" (?:[\s\x1c-\x1f]|$)")
# The same for Arrow's regular expressions, whose ``\s`` holds no more than five characters.
UNCUTTABLE = r" (?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}


def cuttable(text: str) -> bool:
    """No blank of the text stands before another one or at its end: it may be cut before each blank."""
    return not _BLANKS.search(text)


def cut(text: str) -> tuple[str, list[str]]:
    """The first word of a text and the others, each of which follows a blank.

    No match of the pattern goes on behind a blank that stands before something
    else than a blank, so words are encoded one by one and repeat. A text with
    other blanks is one word.
    """
    if not cuttable(text):
        return text, []
    first, *rest = text.split(" ")
    return first, rest


class Memory(dict):
    """A dictionary that computes what it misses and starts anew when it is full."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Vocabulary:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves = {rank: self._last_merge(token) for token, rank in ranks.items() if len(token) > 1}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # What merging can never reach is no token inside a piece.
            if len(token) == 1 or self.halves[rank] is not None:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits = Memory(self._fits, PAIRS_KEPT)
        self.pieces = Memory(self._piece, WORDS_KEPT)
        self.words = Memory(self._word, WORDS_KEPT)
        self.blank_words = Memory(lambda w: self._word(" " + w), WORDS_KEPT)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """Parts of ``token`` after all merges whose rank is under ``below``."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        parts = self._merged(token, self.ranks[token])
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Do two neighbouring tokens stay apart?

        Both are taken apart at their seam in the reverse order of merging. At
        each state two parts touch there; if their union has a rank under that
        of the merge just undone, merging would have joined them first.
        """
        left, right = pair
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        bound = len(tokens)
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < bound:
                return False
            left_parts, right_parts = halves.get(left), halves.get(right)
            if left_parts is None and right_parts is None:
                return True
            # Of equal ranks merging takes the leftmost, which the union is if it starts before ``right``.
            if right_parts is None or (left_parts is not None and left > right):
                bound, left = left, left_parts[1]
            else:
                bound, right = right + 1, right_parts[0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        at_place: list[list] = [[] for _ in range(len(raw) + 1)]
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            at_place[end - token[0] + 1].append(token)
        fits, last = self.fits, len(raw)
        open_ends = bytearray(b"\x01") * (last + 1)
        ids, steps, place = [], [len(at_place[0]) - 1], 0
        while place < last:
            options, step = at_place[place], steps[-1]
            before = ids[-1] if ids else None
            while step >= 0:
                length, rank = options[step]
                if open_ends[place + length] and (before is None or fits[before, rank]):
                    break
                step -= 1
            if step >= 0:
                steps[-1] = step
                ids.append(rank)
                place += length
                steps.append(len(at_place[place]) - 1)
            else:
                open_ends[place] = 0
                steps.pop()
                place -= len(self.tokens[ids.pop()])
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, rest = cut(text)
        if not rest:
            return self._word(first)
        return self.words[first] + b"".join(map(self.blank_words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        lengths = self.lengths[found]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[found] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[places].tobytes()


_LOADED: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    key = (hash(raw), pattern)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(read_ranks(raw), pattern)
    return _LOADED[key]


def _shipped(df: DataFrame, ranks_path: str):
    """The rank file for every task: a vocabulary is a fixed file of about a megabyte."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row: the ids of the whole text and the bytes that they stand for.

    ``ids`` holds little-endian unsigned 32-bit integers. Every match of
    ``pattern`` is encoded by itself; special tokens are ordinary text. Null and
    empty texts have no ids. Repeated rows are encoded one by one, an empty
    table gives an empty result, and other columns are not looked at. Rows stay
    in their partition.
    """
    raw = _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value, pattern)
        for batch in common.pieces(batches, "text"):
            ids = [vocabulary.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([vocabulary.decode(i) for i in ids], pa.binary()),
            ], schema=_TOKENS)

    texts = common.id_and_text(docs, id_col, text_col)
    return common.map_batches(texts, run, "doc_id long, n_tokens long, ids binary, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of the ids of each row; null ids stay null."""
    raw = _shipped(encoded, ranks_path)
    schema = encoded.drop("decoded").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value, r".+")
        for batch in batches:
            found = [None if i is None else vocabulary.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return common.map_batches(encoded.drop("decoded"), run, schema)
