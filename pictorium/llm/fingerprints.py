"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once. The upper bits of a hash choose one of
``BINS`` bins, and a bin keeps its smallest hash. An empty bin takes the value
of a full one: each bin has its own pseudorandom order of all bins, the same for
every text, and takes the first full bin in it (optimal densification), so two
texts agree in a bin with the probability of their Jaccard similarity, however
short they are. Of each value, mixed anew for its bin, only ``BITS`` low-order
bits are stored. Values that differ still agree in those bits once in
``2 ** BITS`` times, which ``likeness`` corrects for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pictorium.llm import common, shingles

BINS, BITS = 1024, 2
WIDTH = BINS * BITS // 8
# Full bins up to which the first one in each order is found from all of them at once.
FEW = 64
_BIN_BITS = BINS.bit_length() - 1
_random = np.random.default_rng(12)
# Bin i looks at bins START[i], START[i] + STEP[i], ... modulo BINS; odd steps reach all of them.
START = _random.integers(0, BINS, BINS)
STEP = _random.integers(0, BINS // 2, BINS) * 2 + 1
_TURN = _random.integers(0, 1 << 63, BINS, dtype=np.uint64)
_BACK = np.array([pow(int(s), -1, BINS) for s in STEP])
# Steps that stay in step: the low bit of each pair of bits.
_LOW = np.uint8(0x55)


def fill(full: np.ndarray) -> np.ndarray:
    """For each bin the full bin that it takes its value from; a full bin keeps its own."""
    source = np.arange(BINS)
    held = np.zeros(BINS, bool)
    held[full] = True
    empty = np.flatnonzero(~held)
    if len(full) <= FEW:
        after = ((full[None, :] - START[empty, None]) * _BACK[empty, None]) % BINS
        source[empty] = full[after.argmin(1)]
        return source
    step = 0
    while len(empty):
        looked = (START[empty] + step * STEP[empty]) % BINS
        found = held[looked]
        source[empty[found]] = looked[found]
        empty = empty[~found]
        step += 1
    return source


def fingerprint(found: np.ndarray) -> bytes:
    """Packed bits of a sorted set of 64-bit shingle hashes; no bytes for the empty set."""
    if not len(found):
        return b""
    bins = (found >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    value = np.empty(BINS, np.uint64)
    value[bins[first]] = found[first]
    low = (shingles.mix(value[fill(bins[first])] ^ _TURN) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).tobytes()


def likeness(one: list[bytes], other: list[bytes]) -> list[float]:
    """Estimated Jaccard similarity of texts, pair by pair, from their fingerprints.

    Two texts without words are alike (1), such a one and any other are not (0).
    """
    found = [float(not a and not b) for a, b in zip(one, other)]
    both = [i for i, (a, b) in enumerate(zip(one, other)) if a and b]
    if both:
        a, b = (np.frombuffer(b"".join(x[i] for i in both), np.uint8).reshape(-1, WIDTH) for x in (one, other))
        differ = a ^ b
        agree = 1 - np.bitwise_count((differ | differ >> 1) & _LOW).sum(1) / BINS
        chance = 2.0**-BITS
        for i, j in zip(both, np.maximum((agree - chance) / (1 - chance), 0.0).tolist()):
            found[i] = j
    return found


def prints(texts: list[bytes]) -> list[bytes]:
    """Fingerprints of texts in UTF-8; A-Z count as lower-case."""
    return [fingerprint(s) for s in shingles.sets([t.lower() for t in texts])]


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints(common.utf8(batch.column("text"))), pa.binary())], schema=_PRINTS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for every row of ``docs``, where it stands: no shuffle.

    Fingerprints have ``WIDTH`` bytes, or none where a text has no words or is
    null. Equal texts, and texts with equal sets of shingles, have equal ones. A
    text of fewer than five words is one shingle. Repeated rows have a row each,
    an empty table gives an empty result, other columns are not looked at.
    """
    return common.map_batches(common.id_and_text(docs, id_col, text_col), _prints, "doc_id long, fingerprint binary")


_EDITED = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("body", pa.binary()),
])
_EDITED_DDL = (
    "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
    "near_next double, body binary"
)
# Kinds of rows that a task gives: results, and the texts at its borders.
DONE, HEAD, TAIL = 0, 1, 2


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of another one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compared(ids: list, texts: list[bytes], own: list[bytes], following: list[bytes], after: list[bytes]) -> pa.RecordBatch:
    """Result rows of texts with their fingerprints, next to the texts that follow them with theirs."""
    whole = [t.decode() for t in texts]
    changed = [edit(t, f.decode()).encode() for t, f in zip(whole, following)]
    edited = prints(changed)
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(ids, pa.int64()), pa.array([len(t) for t in whole], pa.int64()),
        pa.array([sha256(c).hexdigest() for c in changed]), pa.array(own, pa.binary()), pa.array(edited, pa.binary()),
        pa.array(likeness(own, edited)), pa.array(likeness(own, after)), pa.nulls(n, pa.binary()),
    ], schema=_EDITED)


def _border(kind: int, part: int, doc_id: int | None, body: bytes) -> pa.RecordBatch:
    columns = [[kind], [part], [doc_id], *([None] for _ in range(6)), [body]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED)], schema=_EDITED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in common.pieces(batches, "text"):
        bodies = [packer.compress(t) for t in common.utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("copy"), pa.array(bodies, pa.binary())], ["doc_id", "mark", "copy", "body"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bytes]]]:
    """Ids, texts and packed texts, about ``BATCH_BYTES`` of text at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids: list = []
    texts: list[bytes] = []
    bodies: list[bytes] = []
    size = 0
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            for doc, body in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist()):
                ids.append(doc)
                bodies.append(body)
                texts.append(unpack(body))
                size += len(texts[-1])
                if size >= common.BATCH_BYTES:
                    yield ids, texts, bodies
                    ids, texts, bodies, size = [], [], [], 0
    if ids:
        yield ids, texts, bodies


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with the one after it; its first and last text for the neighbours."""
    part = TaskContext.get().partitionId()
    last = None
    for ids, texts, bodies in _unpacked(batches):
        own = prints(texts)
        if last is None:
            yield _border(HEAD, part, ids[0], bodies[0])
        else:
            ids, texts, bodies, own = ([x, *rest] for x, rest in zip(last, (ids, texts, bodies, own)))
        if len(ids) > 1:
            yield _compared(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
        last = ids[-1], texts[-1], bodies[-1], own[-1]
    if last is not None:
        yield _border(TAIL, part, last[0], last[2])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc, body, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "following"))):
            texts = [unpack(body)], [unpack(following)]
            yield _compared([doc], texts[0], prints(texts[0]), texts[1], prints(texts[1]))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row for each row of ``docs``. Rows are ordered
    by descending id, null ids last; the last is followed by the first. Rows with
    equal ids are ordered by the ``xxhash64`` of their texts, equal rows stand in any
    order. In the edited text the last third of the code points, rounded down,
    is replaced by as many from the next text, or all that it has. ``near_next``
    compares the text with the next one. A null text is empty; an empty table
    gives an empty result; a lone row follows itself.

    Texts are shuffled once, by ranges of the order, and neighbours then stand
    in one task; the first and last text of each range are joined afterwards.
    """
    spark = docs.sparkSession
    rows = common.id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), (F.monotonically_increasing_id() % 65536).cast("int").alias("copy"),
    )
    packed = common.map_batches(rows, _pack, "doc_id long, mark long, copy int, body binary")
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").desc(), F.col("copy")]
    # "copy" only lets ranges part equal rows.
    ranged = packed.repartitionByRange(common.partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "body")
    found = common.store(common.map_batches(ranged, _along, _EDITED_DDL), "fingerprints")
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    tails = found.filter(F.col("kind") == TAIL).select("part", "doc_id", "body")
    # One row for each range: the range that follows it.
    whole = Window.orderBy("part")
    ranges = tails.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(whole), F.min("part").over(Window.partitionBy(F.lit(0)))))
    borders = tails.join(ranges, "part").join(heads, "next_part").select("doc_id", "body", "following")
    closed = common.map_batches(borders, _meet, _EDITED_DDL)
    columns = [f.name for f in _EDITED if f.name not in ("kind", "part", "body")]
    return found.filter(F.col("kind") == DONE).select(columns).union(closed.select(columns))
