"""Packing token runs into windows of a fixed length.

Documents become token ids; each is cut after every full window, and what
remains is a run shorter than the window. The histogram of run lengths (at most
one row for each length) goes to the driver. There, combinations of few lengths
that fill a window are enumerated, non-negative least squares finds how often
each is to be used, the counts are rounded down, and the rest of the histogram
is packed greedily, largest length first. The plan is a list of intervals: the
n-th run of a length has its sequence and its place in it. Runs are numbered by
adding the counts of earlier partitions, so no length is numbered in one task.
"""

from __future__ import annotations

from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from pictorium.llm import bpe, common

WINDOW = 2048
END_ID = 1
# Entries of a task's memories before they start anew.
KEPT = 500_000
# Rows of texts that a task gets together.
BATCH_ROWS = 2_000
# Combinations for each length, and steps of the solver.
PARTNERS = 12
STEPS = 400


# How a byte-level tokenizer spells bytes: printable ones as themselves, the others by the characters from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = sorted(set(range(256)) - _PRINTABLE)
_SPELLED = "".join(chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256))


class Words:
    """Ids of texts by a byte-level tokenizer: its model gets each match of its pattern once as long as that is remembered.

    With ``added``, texts that hold the content of an added token are given to
    the tokenizer as a whole, which gives such contents their own ids; else they
    are text like any other.
    """

    def __init__(self, raw: bytes, pattern: str, added: bool = False):
        self.whole = Tokenizer.from_buffer(raw)
        self.contents = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.model = self.whole.model
        self.find = regex.compile(pattern).findall
        self.matches = bpe.Memory(self._match, KEPT)

    def _match(self, match: str) -> bytes:
        spelled = charmap_decode(match.encode(), "strict", _SPELLED)[0]
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(content in text for content in self.contents):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self._ids(text)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of many texts, null ones empty. Different words are cut by the pattern and looked up once, all in one pass."""
        texts = texts.fill_null("")
        found: list[bytes | None] = [None] * len(texts)
        whole = pc.match_substring_regex(texts, bpe.UNCUTTABLE)
        for content in self.contents:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        for i in pc.indices_nonzero(whole).to_pylist():
            found[i] = self.encode(texts[i].as_py())
        plain = pc.indices_nonzero(pc.invert(whole)).to_pylist()
        if not plain:
            return found
        # The first word of a text has no blank before it.
        parts = pc.split_pattern(texts.take(pa.array(plain, pa.int64())) if len(plain) < len(texts) else texts, " ", max_splits=1)
        border = parts.offsets.to_numpy()
        halves = parts.flatten()
        heads = [self._ids(t) for t in halves.take(pa.array(border[:-1])).to_pylist()]
        several = np.diff(border) > 1
        lists = pc.split_pattern(halves.take(pa.array(border[:-1][several] + 1)), " ")
        coded = lists.flatten().dictionary_encode()
        ids, start, size = self._word_ids(coded.dictionary)
        code = coded.indices.to_numpy()
        size = size[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        # A run of places for each word: one step within a word, a jump to the next.
        place = np.repeat(start[code] - ends[:-1], size)
        place += np.arange(len(place))
        values = memoryview(ids[place]).cast("B")
        at = iter((4 * ends[lists.offsets.to_numpy()]).tolist())
        begin = next(at, 0)
        for i, head, more in zip(plain, heads, several.tolist()):
            if more:
                end = next(at)
                found[i] = head + values[begin:end]
                begin = end
            else:
                found[i] = head
        return found

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words that follow a blank each, one after the other; where they start and how many they are."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pieces = self.find(" " + _joined(words))
        ids = list(map(self.matches.__getitem__, pieces))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # Words hold no blank, so that a match that begins with one begins a word.
        begins = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        ends = np.cumsum(length)
        start = (ends - length)[begins]
        return np.frombuffer(b"".join(ids), "<u4"), start, np.diff(start, append=ends[-1])


def _joined(words: pa.Array) -> str:
    """All values with a blank between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), " ")[0].as_py()


_LOADED: dict[int, Words] = {}
_RUNS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("part", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()),
])
RUNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long, ids binary"


def token_runs(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Runs of token ids of every document, ``end_id`` last: full windows and what remains.

    ``pattern`` is the one by which the tokenizer of ``tokenizer_path`` splits
    texts; no id crosses its matches. ``added_tokens`` gives the
    contents of its added tokens their ids, as the tokenizer does unless told otherwise. ``start`` counts the ids before the run, ``doc_tokens`` those of the whole
    document, ``ids_crc32`` is over little-endian unsigned 32-bit ids, which
    ``with_ids`` also returns. ``part, place`` number the runs of each length
    within a partition. A null or empty text is the one id ``end_id``; an empty
    table has no runs; other columns are not looked at.
    """
    with open(tokenizer_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((raw.value, pattern, added_tokens))
        if key not in _LOADED:
            _LOADED[key] = Words(raw.value, pattern, added_tokens)
        part, places = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in common.pieces(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _LOADED[key].encode_all(batch.column("text"))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    held = ids[4 * start:4 * (start + window)]
                    length = len(held) // 4
                    rows.append((doc, start, length, crc32(held), total, part, places[length], held if with_ids else None))
                    places[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)

    return common.map_batches(common.id_and_text(docs, id_col, text_col), run, RUNS)


def combinations(lengths: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Up to four lengths that fill a window as well as the given lengths allow; a row each, zeros for unused places.

    For each length: alone, and with one, two or three others of which all but
    the last are spread over the lengths that fit; the last is the largest that
    still fits.
    """
    lengths = np.sort(lengths)
    found = {(int(n),) for n in lengths}

    def fitting(room: int) -> np.ndarray:
        return lengths[:np.searchsorted(lengths, room, "right")]

    def spread(values: np.ndarray) -> np.ndarray:
        return values[np.unique(np.linspace(0, len(values) - 1, partners).astype(int))] if len(values) > partners else values

    for a in lengths.tolist():
        one = fitting(window - a)
        if not len(one):
            continue
        found.add((a, int(one[-1])))
        for b in spread(one).tolist():
            two = fitting(window - a - b)
            if not len(two):
                continue
            found.add((a, b, int(two[-1])))
            c = int(two[(len(two) - 1) // 2])
            three = fitting(window - a - b - c)
            if len(three):
                found.add((a, b, c, int(three[-1])))
    unique = sorted({tuple(sorted(f, reverse=True)) for f in found})
    return np.array([f + (0,) * (4 - len(f)) for f in unique], np.int64).reshape(-1, 4)


def repeat_counts(histogram: np.ndarray, used: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that their lengths sum to the histogram.

    Accelerated projected gradient steps; a combination touches four bins at
    most. Weights favour combinations that leave nothing of the window open.
    """
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    total = max(target.sum(), 1.0)
    target = target / total

    def forward(x):
        out = np.bincount(used.ravel(), np.repeat(x, 4), size)
        out[0] = 0
        return out

    def backward(r):
        r = r.copy()
        r[0] = 0
        return r[used].sum(1)

    # The largest eigenvalue of the normal matrix bounds the step.
    v = np.ones(len(used))
    for _ in range(20):
        v = backward(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (np.linalg.norm(backward(forward(v))) * 1.05 or 1.0)
    # A small charge for the open part of a window keeps full combinations ahead of others.
    charge = 1e-3 * (1 - used.sum(1) / (size - 1)) * target.max()
    x = y = np.zeros(len(used))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * (backward(forward(y) - target) + charge))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * total


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts that use up ``histogram`` (runs by length, index 0 unused) exactly."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int | None = None) -> int:
        times = min(int(left[n]) // lengths.count(n) for n in set(lengths))
        times = times if most is None else min(times, most)
        if times > 0:
            for n in lengths:
                left[n] -= times
            chosen.append((lengths, times))
        return times

    if left[window]:
        take((window,))
    present = np.flatnonzero(left)
    if len(present):
        used = combinations(present, window)
        counts = np.floor(repeat_counts(left, used)).astype(np.int64)
        # Only combinations that leave little open are worth a fixed count; the rest is packed below.
        full = used.sum(1) >= window - window // 256
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] <= 0:
                break
            if full[i]:
                take(tuple(int(n) for n in used[i] if n), int(counts[i]))
    while len(present := np.flatnonzero(left)):
        lengths, room = [], window
        spare = left.copy()
        while room and len(fit := present[:np.searchsorted(present, room, "right")]):
            fit = fit[spare[fit] > 0]
            if not len(fit):
                break
            n = int(fit[-1])
            lengths.append(n)
            spare[n] -= 1
            room -= n
        take(tuple(lengths))
    return chosen


def intervals(chosen: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the n-th run of a length goes: sorted by length and first number of the interval."""
    next_run: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in chosen:
        offset = 0
        for n in lengths:
            first = next_run.get(n, 0)
            rows.append((n, first, base, offset))
            next_run[n] = first + times
            offset += n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def pack(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``runs`` with ``sequence_id`` and ``offset``; columns ``part, place`` are used up.

    ``runs`` must be a stored table (its numbering must not change when read
    again). Every run has one place; offsets in a sequence leave no gap.
    Sequences shorter than the window are padded by the reader, or not at all
    where their length is a power of two. An empty table stays empty.
    """
    histogram = np.zeros(window + 1, np.int64)
    counts = runs.groupBy("part", "length").agg(F.count("*").alias("n"))
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to the window
        histogram[row["length"]] = row["n"]
    table = runs.sparkSession.sparkContext.broadcast(intervals(plan(histogram, window)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = runs.join(earlier, ["part", "length"]).withColumn("place", F.col("place") + F.col("earlier")).drop("part", "earlier")
    schema = numbered.drop("place").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            place = batch.column("place").to_numpy()
            # Both keys in one sort order: intervals before the run, of the same length.
            start = np.searchsorted(places["length"], length, "left")
            stop = np.searchsorted(places["length"], length, "right")
            at = np.array([a + np.searchsorted(places["first"][a:b], n, "right") - 1 for a, b, n in zip(start, stop, place)], np.int64)
            sequence = places["sequence"][at] + place - places["first"][at]
            kept = [batch.column(n) for n in batch.schema.names if n != "place"]
            names = [n for n in batch.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(places["offset"][at])], [*names, "sequence_id", "offset"])

    return common.map_batches(numbered, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_tokens``: the ids of each sequence of runs that carry ``ids``; a window's worth at most."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(one.alias("runs")).select(
        "sequence_id",
        F.aggregate("runs", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("n_tokens"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: the columns of ``token_runs`` without ``part, place``, with ``sequence_id, offset``."""
    runs = token_runs(docs, tokenizer_path, pattern, window, end_id, with_ids, id_col, text_col, added_tokens)
    return pack(common.store(runs, "token-runs", BATCH_ROWS), window)
