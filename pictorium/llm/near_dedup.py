"""Near-duplicates: MinHash signatures, a multi-index Hamming join, exact confirmation.

A text is the set of its five-word shingles. Texts with equal sets are one class
from the start. A class has a signature of MinHash values of 16 bits, cut into
chunks. If two signatures differ in fewer than twice as many slots as there are
chunks, then by the pigeonhole principle some chunk differs in at most one, so
both hold the chunk without that slot: with a key for each chunk and each slot
left out, every pair under the distance meets in a bucket. ``keys_for`` takes as
many chunks as the wanted similarity needs. Longer signatures then tell most
pairs apart before the full sets are compared.

A bucket may hold a third of all classes, so it never gives all of its pairs.
First every class is compared with a few hubs of its buckets, one of which is the
member that has most company in its own buckets, which copies of one text have in
common even where they are unlike each other. Components of the links found so leave
pairs open only between different components, and only those are looked at, in
blocks of a bounded size; how many shingles of a set stand in no other open class
bounds its similarity with all of them. A link is confirmed on full sets always.
A pair with exactly the wanted similarity has more than the allowed slots
different with a probability of 1.3e-8 at 0.85, 3.3e-6 at 0.8 and 1e-5 at most elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pictorium.llm import common, shingles
from pictorium.llm.components import stars as smallest

# Slots of a signature beyond those of the keys.
MORE_SLOTS = 208
MISS = 1e-9
# Probability with which a pair of exactly the wanted similarity may differ in more slots than keys allow.
KEY_MISS = 1e-5
LEAST_PERCENT = 50
# Rows of texts that a task gets together.
BATCH_ROWS = 1_000
# Bytes of text whose words a task hashes together; some forty times as many are held for it.
SLICE = 512 << 10
# Texts for which a step takes another task, up to the session's partitions.
TEXTS_A_TASK = 1_000
# Rows of a bucket that are compared with each other in one task.
BLOCK = 2048
_random = np.random.default_rng(7)
_FACTOR = _random.integers(0, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_TURN = _random.integers(0, 1 << 63, 1024, dtype=np.uint64)


@dataclass(frozen=True)
class Keys:
    """How the first slots are cut into chunks; two signatures meet if some chunk differs in one slot at most."""

    chunks: int
    slots: int

    @property
    def size(self) -> int:
        return self.chunks * self.slots

    @property
    def distance(self) -> int:
        """Differing slots up to which two signatures meet for certain."""
        return 2 * self.chunks - 1


def keys_for(percent: int) -> Keys:
    """Few long chunks where they cover the similarity, else as many chunks of three slots as it takes."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is between {LEAST_PERCENT} and 100")
    tried = [Keys(12, 4), *(Keys(n, 3) for n in range(14, 256))]
    return next(k for k in tried if allowed(k.size, percent / 100, KEY_MISS) <= k.distance)


def allowed(slots: int, similarity: float, miss: float = MISS) -> int:
    """Slots in which signatures of texts with the similarity differ at most, but for the probability ``miss``."""
    p, tail, n = 1 - similarity, 1.0, -1
    while tail > miss and n < slots:
        n += 1
        tail = sum(comb(slots, k) * p**k * (1 - p) ** (slots - k) for k in range(n + 1, slots + 1))
    return n


def signatures(found: list[np.ndarray], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: MinHash values of 16 bits for the keys, and more of 8 bits."""
    sizes = np.array([len(s) for s in found])
    starts = np.cumsum(sizes) - sizes
    values = np.concatenate(found)
    least = np.empty((len(found), keys.size + MORE_SLOTS), np.uint64)
    for k in range(least.shape[1]):
        least[:, k] = np.minimum.reduceat((values ^ _TURN[k]) * _FACTOR[k], starts)
    least = shingles.mix(least)
    return least[:, :keys.size].astype(np.uint16), least[:, keys.size:].astype(np.uint8)


_SETS = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("more", pa.binary()),
    ("body", pa.binary()),
])


def _sets(keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in common.pieces(batches, "text", SLICE):
            texts = [t.lower() for t in common.utf8(batch.column("text"))]
            found = shingles.sets(texts)
            full = [i for i, s in enumerate(found) if len(s)]
            sig: list = [None] * len(found)
            more, key, body = list(sig), list(sig), list(sig)
            if full:
                for i, a, b in zip(full, *signatures([found[i] for i in full], keys)):
                    sig[i], more[i] = a.tobytes(), b.tobytes()
                    key[i], body[i] = blake2b(found[i].tobytes(), digest_size=16).digest(), packer.compress(texts[i])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in found], pa.int64()), pa.array(key, pa.binary()),
                pa.array(sig, pa.binary()), pa.array(more, pa.binary()), pa.array(body, pa.binary()),
            ], schema=_SETS)

    return run


def _rows_of(column: pa.Array, dtype) -> np.ndarray:
    """A matrix with a row for each value of a column of equally long bytes."""
    return np.array([np.frombuffer(v, dtype) for v in column.to_pylist()], dtype)


def chunk_keys(sig: np.ndarray, keys: Keys) -> np.ndarray:
    """Keys of each signature: each chunk without each of its slots, with their number in the upper bits."""
    wide = sig.astype(np.int64).reshape(len(sig), keys.chunks, keys.slots)
    found = np.empty((len(sig), keys.chunks, keys.slots), np.int64)
    for drop in range(keys.slots):
        joined = np.zeros((len(sig), keys.chunks), np.int64)
        for s in range(keys.slots):
            if s != drop:
                joined = (joined << 16) | wide[:, :, s]
        found[:, :, drop] = ((np.arange(keys.chunks, dtype=np.int64) * keys.slots + drop) << 48) | joined
    return found.reshape(len(sig), keys.size)


def _keys(keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                found = chunk_keys(_rows_of(part.column("sig"), np.uint16), keys)
                nodes = np.repeat(part.column("node").to_numpy(), keys.size)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(nodes)], ["key", "node"])

    return run


def _close(a: pa.RecordBatch | dict, i: np.ndarray, j: np.ndarray, limits: tuple[int, int], percent: int) -> np.ndarray:
    """Which pairs of rows may have the similarity: by the sizes of their sets and both signature distances.

    ``shared`` bounds what a set can have in common with any other.
    """
    n, shared = a["n"], a["shared"]
    most = np.minimum(np.minimum(shared[i], shared[j]), np.minimum(n[i], n[j]))
    may = np.flatnonzero(100 * most >= percent * (n[i] + n[j] - most))
    apart = (a["sig"][i[may]] != a["sig"][j[may]]).sum(1)
    near = apart <= limits[0]
    may, apart = may[near], apart[near]
    return may[apart + (a["more"][i[may]] != a["more"][j[may]]).sum(1) <= limits[1]]


def _near_hubs(limits: tuple[int, int], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.slice(at, 4000)
                m = len(part)
                n = np.concatenate([part.column("n").to_numpy(), part.column("hub_n").to_numpy()])
                both = {
                    "n": n, "shared": n,
                    "sig": np.concatenate([_rows_of(part.column(c), np.uint16) for c in ("sig", "hub_sig")]),
                    "more": np.concatenate([_rows_of(part.column(c), np.uint8) for c in ("more", "hub_more")]),
                }
                kept = _close(both, np.arange(m), np.arange(m) + m, limits, percent)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(kept)) for c in ("node", "hub")], ["u", "v"])

    return run


def _across(limits: tuple[int, int], percent: int, keys: Keys):
    """Close pairs of different components within the blocks of a sorted partition.

    A pair that shares several buckets is given in the first of them.
    """

    def pairs(rows: dict) -> Iterator[pa.RecordBatch]:
        group, block = rows["group"], rows["block"]
        i, step = np.arange(len(group)), 1
        while len(i):
            i = i[i + step < len(group)]
            i = i[group[i] == group[i + step]]
            j = i + step
            # In a group of two blocks only pairs of one row from each; in a group of one block all pairs.
            wanted = (rows["component"][i] != rows["component"][j]) & (rows["node"][i] != rows["node"][j]) & (
                (rows["a"][i] == rows["b"][i]) | (block[i] != block[j])
            )
            x, y = i[wanted], j[wanted]
            close = _close(rows, x, y, limits, percent)
            x, y = x[close], y[close]
            if len(x):
                same = chunk_keys(rows["sig"][x], keys) == chunk_keys(rows["sig"][y], keys)
                first = same.argmax(1) == rows["key"][x] >> 48
                x, y = x[first], y[first]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(rows["node"][x]), pa.array(rows["node"][y])], ["u", "v"])
            step += 1

    def columns(batch: pa.RecordBatch) -> dict:
        rows = {c: batch.column(c).to_numpy() for c in ("key", "a", "b", "block", "node", "component", "n", "shared")}
        rows["sig"], rows["more"] = _rows_of(batch.column("sig"), np.uint16), _rows_of(batch.column("more"), np.uint8)
        change = (np.diff(rows["key"], prepend=-1) != 0) | (np.diff(rows["a"], prepend=-1) != 0) | (np.diff(rows["b"], prepend=-1) != 0)
        rows["group"] = np.cumsum(change)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for at in range(0, len(batch), 4 * BLOCK):
                rows = columns(batch.slice(at, 4 * BLOCK))
                if held is not None and len(held["key"]):
                    joined = {c: np.concatenate([held[c], rows[c]]) for c in rows if c != "group"}
                    change = (np.diff(joined["key"], prepend=-1) != 0) | (np.diff(joined["a"], prepend=-1) != 0) | (np.diff(joined["b"], prepend=-1) != 0)
                    rows = joined | {"group": np.cumsum(change)}
                # The last group may go on in the next batch.
                last = np.searchsorted(rows["group"], rows["group"][-1])
                yield from pairs({c: v[:last] for c, v in rows.items()})
                held = {c: v[last:] for c, v in rows.items()}
        if held is not None and len(held["key"]):
            yield from pairs(held)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            found = shingles.sets([unpack(b) for b in part.column("body").to_pylist()])
            nodes = np.repeat(part.column("node").to_numpy(), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(nodes)], ["shingle", "node"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                u, v = part.column("u").to_pylist(), part.column("v").to_pylist()
                bodies = list(zip(part.column("body").to_pylist(), part.column("other").to_pylist()))
                distinct = list({b for pair in bodies for b in pair})
                known = dict(zip(distinct, shingles.sets([unpack(b) for b in distinct])))
                linked = []
                for k, (one, two) in enumerate(bodies):
                    a, b = known[one], known[two]
                    common_size = len(a) + len(b) - len(np.union1d(a, b))
                    if 100 * common_size >= percent * (len(a) + len(b) - common_size):
                        linked.append(k)
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in linked], pa.int64()), pa.array([v[k] for k in linked], pa.int64())], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, classes: DataFrame, percent: int, texts: int) -> DataFrame:
    """Pairs ``u, v`` whose full sets have the similarity, among ``texts`` rows."""
    bodies = classes.select("node", "body")
    both = pairs.join(bodies.withColumnRenamed("node", "u"), "u").join(
        bodies.select(F.col("node").alias("v"), F.col("body").alias("other")), "v"
    )
    both = common.narrowed(both.select("u", "v", "body", "other"), texts, TEXTS_A_TASK)
    return common.map_batches(both, _confirm(percent), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", with_marks: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Letters A-Z are lower-cased; words are what stands between blanks (space,
    tab to carriage return). The set of a text holds its distinct five-word
    shingles, or all its words as one where they are fewer. Texts are linked
    when 100 times the intersection reaches ``percent`` times the union;
    ``component_id`` is the smallest id that links reach and ``kept`` marks the
    row that has it. A text without words, or a null one, has an empty set and
    is linked with nothing. Texts of rows with a null id link like all others, so
    two ids may be joined through one; a component without any id is null. Repeated rows are linked
    as equal texts; rows that share an id but not a text are told apart by text.
    An empty table gives an empty result; other columns are not looked at.
    ``percent`` is at least ``LEAST_PERCENT``, from where keys cover the similarity.
    ``with_marks`` adds ``mark``, the ``xxhash64`` of the text.
    """
    slots = keys_for(percent)
    limits = (slots.distance, allowed(slots.size + MORE_SLOTS, percent / 100))
    texts = common.id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, n_shingles long, set_key binary, sig binary, more binary, body binary"
    rows = common.store(common.map_batches(texts, _sets(slots), schema), "near-sets", BATCH_ROWS)
    size = rows.count()

    def stored(df: DataFrame, label: str) -> DataFrame:
        return common.store(common.narrowed(df, size, TEXTS_A_TASK), label)

    full = rows.filter(F.col("set_key").isNotNull())
    # Equal sets have equal signatures; whichever body comes first has the same set. Where no row has an id, a number
    # below all ids stands for the class; it links like any other, and its component is the smallest real id.
    nameless = F.shiftrightunsigned(F.xxhash64("set_key"), 1) - F.lit((1 << 63) - 1) - 1
    classes = full.groupBy("set_key").agg(
        F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "more", "body"))
    ).withColumnRenamed("n_shingles", "n").withColumn("node", F.coalesce("least", nameless)).withColumn("named", F.col("least").isNotNull()).drop("least")
    classes = stored(classes, "near-classes")
    marks = classes.select("node", "n", "sig", "more")
    hub_marks = marks.select(F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in ("n", "sig", "more")))
    keys = common.map_batches(classes.select("node", "sig"), _keys(slots), "key long, node long")
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("size"), F.min("node").alias("hub0"),
        *(F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"hub{k}") for k in (1, 2)),
    ).filter("size > 1")
    buckets = stored(buckets, "near-buckets")
    members = stored(keys.join(buckets, "key"), "near-members")
    # Copies of one text may each be like it and unlike each other. All its keys are theirs too, so it has most company
    # in its buckets: the member with most in each bucket is its last hub. Two members are a pair already.
    wide = members.filter("size > 2").select("key", "node")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    centres = wide.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    wide = wide.join(stored(centres, "near-centres"), "key").select("node", "hub")
    pairs = members.select("node", F.explode(F.array("hub0", "hub1", "hub2")).alias("hub")).union(wide).filter("node <> hub")
    pairs = pairs.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct()
    pairs = common.narrowed(pairs.join(marks, "node").join(hub_marks, "hub"), size, TEXTS_A_TASK)
    links = _confirmed(common.map_batches(pairs, _near_hubs(limits, percent), "u long, v long"), classes, percent, size)
    first = smallest(links)
    # Members of buckets that hold several components, with theirs. A node without a link is one.
    open_members = members.select("key", "size", "node").join(first.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
    open_members = open_members.withColumn("component", F.coalesce("component", "node"))
    mixed = open_members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_members = stored(open_members.join(stored(mixed.select("key"), "near-mixed-keys"), "key"), "near-mixed")
    # Shingles that no other class of these buckets has cannot be common to a pair; a set with too many of them has no links left.
    of_node = open_members.select("node").distinct().join(classes.select("node", "body"), "node")
    of_node = common.narrowed(of_node, size, TEXTS_A_TASK)
    own = common.map_batches(of_node, _shingles, "shingle long, node long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = own.filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    marks = stored(marks.join(own, "node", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"), "near-shared")
    marks = marks.filter(100 * F.col("shared") >= percent * F.col("n"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    open_members = open_members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks)})
    open_members = open_members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "component"
    )
    open_members = open_members.join(marks, "node").repartition(common.partitions(docs), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    open_members = common.narrowed(open_members, size, TEXTS_A_TASK)
    rest = stored(common.map_batches(open_members, _across(limits, percent, slots), "u long, v long").distinct(), "near-open")
    # What the hubs have joined is one link to its component now.
    final = smallest(first.union(_confirmed(rest, classes, percent, size))).select(F.col("u").alias("node"), F.col("v").alias("component"))

    of_set = classes.select("set_key", "node", "named").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # The smallest real id of a component; none where all its rows lack one.
    real = of_set.filter("named").groupBy("component").agg(F.min("node").alias("component_id"))
    of_set = of_set.join(real, "component", "left").select("set_key", "component_id")
    # Empty sets match no class; a key of their own deals them out.
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id", "mark", "n_shingles").cast("string")).cast("binary")
    found = rows.select("doc_id", "mark", "n_shingles", F.coalesce("set_key", alone).alias("set_key")).join(of_set, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept, *(["mark"] if with_marks else []))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that link to a smaller id, all columns as they were.

    Rows are told apart by id and text. Rows with a null id stay.
    """
    found = near_duplicates(docs, percent, id_col, text_col, with_marks=True)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    rows = common.boxed(docs, id=F.col(f"`{id_col}`").cast("long"), mark=F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left_anti").select("row.*")
