"""Repeated byte windows by a depth-limited radix sort of suffixes.

A byte goes when it lies in a window of ``length`` bytes that starts in two
places. Suffixes are ordered by their first ``length`` bytes only, digit by
digit from the most significant one, and a suffix whose group has no other
member is left out of all later passes. Equal groups at the full depth are the
repeated windows.

The first digit is chosen so that neighbouring suffixes share it: the smallest
gram (by hash) of the window, at its place in the window. Equal windows have
the same smallest gram at the same place, and a run of about a hundred
neighbours has one in common, so the first pass moves one row for each run.
The second digit is the whole stretch of text of a run: runs with an equal one
are repeated as they stand. What is left are runs that share a gram but not
their whole stretch; their windows go through passes over digits of eight bytes
up to the full depth, in a task for each gram. A gram with very many different
stretches is no group: its windows are counted by their digest instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from pictorium.llm import common
from pictorium.llm.shingles import mix

LENGTH = 200
GRAM = 32
DIGIT = 8
# Different stretches around one gram that are sorted in one task, and windows sorted together.
BLOCK = 4096
WINDOWS = 1 << 18
_PLACE_BITS = np.uint64(30)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = 0x9E3779B97F4A7C15

# A run: first window, number of windows, place of the gram from the first window, tag of the document.
_START, _COUNT, _GRAM = 24, 16, 8


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place on, by doubling."""
    found, size, power = _BYTE[data], 1, _POWER
    while size < GRAM:
        found = found[:-size] * np.uint64(power) + found[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return mix(found)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same smallest gram: text number, start in it, windows, gram hash, place of the gram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    if not len(sizes) or sizes.max() < length:
        return nothing
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams = _gram_hashes(data)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    # Of equal grams the leftmost counts.
    least = _sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & mask
    of_text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    whole = np.arange(len(of_text)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)) + offsets[of_text]
    place = least[whole].astype(np.int64)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(of_text, prepend=-1) != 0))
    count = np.diff(first, append=len(whole))
    start = whole[first]
    return of_text[first], start - offsets[of_text[first]], count, grams[place[first]], place[first] - start


def document_key(doc: int | None, text: bytes) -> tuple[int, int]:
    """64 bits for a document, and 8 more that each of its runs carries."""
    digest = xxhash.xxh3_128_intdigest(text, seed=0 if doc is None else (2 * doc + 1) % (1 << 64))
    return (digest >> 64) - (1 << 63), digest & 0xFF


_RUNS = pa.schema([("gram", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            texts = common.utf8(batch.column("text"))
            keys = [document_key(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), texts)]
            of_text, start, count, gram, inside = runs(texts, length)
            if not len(start):
                continue
            stretch = [
                xxhash.xxh3_64_intdigest(texts[t][s:s + n]) - (1 << 63)
                for t, s, n in zip(of_text.tolist(), start.tolist(), (count + length - 1).tolist())
            ]
            doc, tag = (np.array(c, np.int64)[of_text] for c in zip(*keys))
            yield pa.RecordBatch.from_arrays([
                pa.array(gram.view(np.int64)), pa.array(stretch, pa.int64()), pa.array(doc),
                pa.array((start << _START) | (count << _COUNT) | (inside << _GRAM) | tag),
            ], schema=_RUNS)

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in common.pieces(batches, "text"):
        ids, texts = batch.column("doc_id").to_pylist(), common.utf8(batch.column("text"))
        yield pa.RecordBatch.from_arrays([
            pa.array([document_key(d, t)[0] for d, t in zip(ids, texts)], pa.int64()), batch.column("doc_id"),
            pa.array([packer.compress(t) for t in texts], pa.binary()),
        ], ["doc", "doc_id", "body"])


_OPEN = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("body", pa.binary())])


def _stretches(length: int):
    """The text of every open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc, doc_id, body, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "doc_id", "body", "runs"))):
                text = unpack(body)
                tag = document_key(doc_id, text)[1]
                for r in found:
                    if r["place"] & 0xFF == tag:
                        start = r["place"] >> _START
                        rows.append((r["gram"], doc, r["place"], r["n"], r["kinds"], text[start:start + (r["place"] >> _COUNT & 0xFF) + length - 1]))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OPEN)], schema=_OPEN)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OPEN)], schema=_OPEN)

    return run


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of ``data`` have an equal one in their group: indices into ``starts``.

    Most-significant-digit passes over ``DIGIT`` bytes; a group of one ends.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    digit = np.zeros(len(data) + 1, np.uint64)
    for k in range(DIGIT):
        digit = (digit << np.uint64(8)) | padded[k:k + len(digit)]
    alive = np.arange(len(starts))
    depth = 0
    while len(alive):
        if depth == 0:
            order = np.argsort(group, kind="stable")
            change = np.diff(group[order]) != 0
        else:
            held = min(DIGIT, length - depth + DIGIT)
            d = digit[starts[alive] + depth - DIGIT] >> np.uint64(8 * (DIGIT - held))
            order = np.lexsort((d, group))
            change = (np.diff(group[order]) != 0) | (np.diff(d[order]) != 0)
        number = np.concatenate([[0], np.cumsum(change)])
        more = np.bincount(number)[number] > 1
        alive, group = alive[order][more], number[more]
        if depth >= length:
            break
        depth += DIGIT
    return alive


def _sort_open(length: int):
    """Repeated windows of open runs; a partition is sorted by gram."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        gram, doc, place, n, body = (list(c) for c in zip(*rows))
        place = np.array(place, np.int64)
        count, inside = place >> _COUNT & 0xFF, place >> _GRAM & 0xFF
        sizes = count + length - 1
        offset = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        _, number = np.unique(np.array(gram, np.int64), return_inverse=True)
        found = np.sort(radix_groups(np.frombuffer(b"".join(body), np.uint8), offset[row] + step, number[row] * 256 + inside[row] - step, length))
        # Runs whose stretch is repeated are known already; here they only were partners.
        found = found[np.array(n)[row[found]] == 1]
        if not len(found):
            return None
        row, step = row[found], step[found]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(step, prepend=-2) != 1))
        size = np.diff(first, append=len(row))
        row, step = row[first], step[first]
        return pa.RecordBatch.from_arrays([
            pa.array(np.array(doc, np.int64)[row]),
            pa.array((((place[row] >> _START) + step) << _START) | (size << _COUNT) | (place[row] & 0xFF)),
        ], ["doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0
        for batch in batches:
            for one in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "place", "n", "body"))):
                if windows > WINDOWS and held[-1][0] != one[0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, windows = [], 0
                held.append(one)
                windows += one[2] >> _COUNT & 0xFF
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for doc, place, n, body in zip(*(batch.column(c).slice(at, 500).to_pylist() for c in ("doc", "place", "n", "body"))):
                    for i in range(place >> _COUNT & 0xFF):
                        one = blake2b(body[i:i + length], digest_size=16).digest()
                        rows.append((int.from_bytes(one[:8], "little", signed=True), int.from_bytes(one[8:], "little", signed=True), doc, (((place >> _START) + i) << _START) | (1 << _COUNT) | (place & 0xFF), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["high", "low", "doc", "place", "n"])

    return run


_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary()),
])
KEPT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"
)


def _remove(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                for doc_id, body, places in zip(*(batch.column(c).slice(at, 1000).to_pylist() for c in ("doc_id", "body", "places"))):
                    text = unpack(body)
                    places = np.array(places or [], np.int64)
                    if len(places):
                        places = places[places & 0xFF == document_key(doc_id, text)[1]]
                    start = places >> _START
                    depth = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + (places >> _COUNT & 0xFF) + length - 1, minlength=len(text) + 1)
                    gone = np.cumsum(depth[:len(text)]) > 0
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                    rows.append((
                        doc_id, len(text), len(text) - len(kept), len(spans), sha256(kept).hexdigest(),
                        [{"start": a, "stop": b} for a, b in spans], kept if with_bytes else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text",
                   block: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (and ``kept`` bytes) for every row.

    Texts are UTF-8 bytes; null is empty. Every byte in a window of ``length``
    bytes that also starts elsewhere, in the same or another text, is removed;
    windows are judged on the input and never cross texts. ``spans`` are the
    maximal removed stretches in bytes, ends exclusive. Texts shorter than the
    window stay. Repeated rows repeat each other. ``kept`` may cut a character
    in two. An empty table gives an empty result; other columns are not looked at.
    """
    if not 2 * GRAM <= length <= GRAM + 200:
        raise ValueError("the window must hold two grams and 232 bytes at most")
    texts = common.id_and_text(docs, id_col, text_col)
    found = common.map_batches(texts, _find_runs(length), "gram long, stretch long, doc long, place long")
    # Stored, so that the join below is one of two shuffled tables and Spark can split a frequent gram.
    shared = common.store(found.groupBy("gram").count().filter("count > 1").select("gram"), "suffix-grams")
    found = common.store(found.join(shared, "gram"), "suffix-shared")
    kinds = found.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one"))
    kinds = common.store(kinds, "suffix-stretches")
    several = common.store(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-several")
    kinds = common.store(kinds.join(several, "gram", "left").select("gram", "stretch", "n", "one.doc", "one.place", "kinds"), "suffix-kinds")
    whole = common.store(found.join(kinds.filter("n > 1").select("gram", "stretch"), ["gram", "stretch"]).select("doc", "place"), "suffix-whole")

    bodies = common.map_batches(texts, _bodies, "doc long, doc_id long, body binary")
    wanted = kinds.filter("kinds > 1").groupBy("doc").agg(F.collect_list(F.struct("gram", "place", "n", "kinds")).alias("runs"))
    opened = common.store(common.map_batches(
        bodies.join(wanted, "doc"), _stretches(length), "gram long, doc long, place long, n long, kinds long, body binary"
    ), "suffix-open")
    few = opened.filter(F.col("kinds") <= block).repartition(common.partitions(docs), "gram").sortWithinPartitions("gram")
    few = common.map_batches(few.select("gram", "doc", "place", "n", "body"), _sort_open(length), "doc long, place long")
    many = common.map_batches(opened.filter(F.col("kinds") > block), _digests(length), "high long, low long, doc long, place long, n long")
    equal = many.groupBy("high", "low").count().filter("count > 1").select("high", "low")
    many = many.filter("n = 1").join(equal, ["high", "low"]).select("doc", "place")
    sorted_open = common.store(few.union(many), "suffix-sorted")

    places = whole.union(sorted_open).groupBy("doc").agg(F.collect_list("place").alias("places"))
    return common.map_batches(bodies.join(places, "doc", "left").select("doc_id", "body", "places"), _remove(length, with_bytes), KEPT)
