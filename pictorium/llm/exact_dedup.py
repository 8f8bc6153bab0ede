"""Exact duplicates through Patricia-trie owners.

Texts are compared byte for byte in compressed radix tries. A task first puts
its own rows in a trie, so that a text with a third of all rows leaves each
task once for every few dozen megabytes. One row for each distinct text of a
task, with the compressed text, then goes to a partition by length and content
hash; there the texts meet in a trie whose terminal nodes hold the owner, the
number of rows and the task groups that met. A trie beyond its memory bound
moves whole subtrees to local spill files and treats each of them as a trie of
its own afterwards. Documents learn their owner by the number of their task
group; no hash decides equality.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common

# Distinct bytes that a task holds in a trie before it hands rows on or spills.
TRIE_BYTES = 48 << 20
LOCAL_ROWS = 200_000
# Rows of texts that a task gets together.
BATCH_ROWS = 1_000
_HEAD = struct.Struct("<QQ?qqI")


class Node:
    """An edge label, the nodes below by first byte, and what a terminal knows."""

    __slots__ = ("label", "below", "end", "file")

    def __init__(self, label: bytes, end=None):
        self.label, self.below, self.end, self.file = label, {}, end, None


def _shared(key: bytes, at: int, label: bytes) -> int:
    """Length of the prefix that ``label`` shares with ``key`` from ``at``."""
    low, high = 0, min(len(key) - at, len(label))
    while low < high:
        mid = (low + high + 1) // 2
        if key[at:at + mid] == label[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie; every terminal holds ``merge`` of the values put there.

    ``limit`` bounds the bytes in memory: beyond it the largest subtree below the
    first branching node goes to a file, and later keys of that subtree follow it.
    """

    def __init__(self, merge, limit: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.merge, self.limit, self.folder, self.held = Node(b""), merge, limit, folder, 0

    def put(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                self._append(node, key, value)
                return
            if at == len(key):
                node.end = value if node.end is None else self.merge(node.end, value)
                break
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = Node(key[at:], value)
                self.held += len(key) - at + 200
                break
            if child.file is None and not key.startswith(child.label, at):
                cut = _shared(key, at, child.label)
                middle = Node(child.label[:cut])
                child.label = child.label[cut:]
                middle.below[child.label[0]] = child
                node.below[key[at]] = middle
                self.held += 200
                child = middle
            at += len(child.label)
            node = child
        if self.folder is not None and self.held > self.limit:
            self._spill()

    def _entries(self, node: Node, prefix: bytes):
        stack = [(node, prefix)]
        while stack:
            at, path = stack.pop()
            if at.end is not None:
                yield path, at.end
            stack.extend((child, path + child.label) for child in at.below.values() if child.file is None)

    def _append(self, node: Node, key: bytes, value) -> None:
        doc, row, count, groups = value
        node.file.write(_HEAD.pack(len(key), count, doc is not None, doc or 0, row, len(groups)))
        node.file.write(key + b"".join(g.to_bytes(8, "little") for g in groups))

    def _spill(self) -> None:
        top, prefix = self.root, b""
        while len(top.below) == 1 and top.end is None:
            (top,) = top.below.values()
            if top.file is not None:
                return
            prefix += top.label
        weighed = [(sum(len(n) for n, _ in self._entries(c, c.label)), first) for first, c in top.below.items() if c.file is None]
        if len(weighed) + (top.end is not None) < 2 and not any(c.file for c in top.below.values()):
            return
        if not weighed:
            return
        _, first = max(weighed)
        old = top.below[first]
        new = Node(b"")
        new.file = tempfile.NamedTemporaryFile(dir=self.folder, delete=False)
        for key, value in self._entries(old, prefix + old.label):
            self._append(new, key, value)
        top.below[first] = new
        stack, size = [self.root], 0
        while stack:
            node = stack.pop()
            size += len(node.label) + 200
            stack.extend(node.below.values())
        self.held = size

    def entries(self) -> Iterator[tuple[bytes, object]]:
        """All keys with their values; spilled subtrees follow, one after the other."""
        yield from self._entries(self.root, b"")
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.file is None:
                stack.extend(node.below.values())
                continue
            name = node.file.name
            node.file.close()
            below = PatriciaTrie(self.merge, self.limit, self.folder)
            with open(name, "rb") as spilled:
                while head := spilled.read(_HEAD.size):
                    length, count, known, doc, row, groups = _HEAD.unpack(head)
                    key, raw = spilled.read(length), spilled.read(8 * groups)
                    ids = [int.from_bytes(raw[i:i + 8], "little") for i in range(0, len(raw), 8)]
                    below.put(key, (doc if known else None, row, count, ids))
            os.unlink(name)
            yield from below.entries()


def _rank(doc: int | None, largest: bool) -> tuple:
    """Order of owners: the smallest rank owns. A null id owns only when no other id is there."""
    return (doc is None, 0 if doc is None else -doc if largest else doc)


def _merger(largest: bool):
    def merge(a, b):
        first = a if (*_rank(a[0], largest), a[1]) <= (*_rank(b[0], largest), b[1]) else b
        # In place: a list that is copied for every member would cost the square of the group.
        a[3].extend(b[3])
        return first[0], first[1], a[2] + b[2], a[3]

    return merge


LOCAL = (
    "row_id long, doc_id long, text_sha256 string, group_id long, owner_doc long, owner_row long, n_rows long, "
    "length long, content_hash long, body binary"
)
_LOCAL = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("group_id", pa.int64()),
    ("owner_doc", pa.int64()), ("owner_row", pa.int64()), ("n_rows", pa.int64()), ("length", pa.int64()),
    ("content_hash", pa.int64()), ("body", pa.binary()),
])

_OWNERS = pa.schema([("group_id", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_HEADS = ("group_id", "owner_doc", "owner_row", "n_rows", "body")


def _local_groups(largest: bool, limit: int):
    """Rows of a task with the number of their group; the first row of a group carries its text."""
    merge = _merger(largest)

    def emit(trie: PatriciaTrie, docs: dict[int, int | None]):
        packer = zstandard.ZstdCompressor(level=1)
        out = []
        for key, (doc, row, count, members) in trie.entries():
            digest, sha, group = xxhash.xxh64_intdigest(key), sha256(key).hexdigest(), members[0]
            head = (doc, row, count, len(key), digest - (1 << 64) if digest >> 63 else digest, packer.compress(key))
            for member in members:
                out.append((member, docs[member], sha, group, *(head if member == group else (None,) * 6)))
                if len(out) == 4096:
                    yield _rows(out, _LOCAL)
                    out = []
        if out:
            yield _rows(out, _LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        trie, docs = PatriciaTrie(merge), {}
        for batch in common.pieces(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.utf8(batch.column("text"))):
                trie.put(text.lower(), (doc, row, 1, [row]))  # bytes.lower() changes A-Z only
                docs[row] = doc
                row += 1
            if trie.held > limit or len(docs) > LOCAL_ROWS:
                yield from emit(trie, docs)
                trie, docs = PatriciaTrie(merge), {}
        yield from emit(trie, docs)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _owners(largest: bool, limit: int):
    """The texts of a partition in one trie; a row for each task group that met there."""
    merge = _merger(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        with tempfile.TemporaryDirectory() as folder:
            trie = PatriciaTrie(merge, limit, folder)
            for batch in batches:
                for group, doc, row, count, body in zip(*(batch.column(c).to_pylist() for c in _HEADS)):
                    trie.put(unpack(body), (doc, row, count, [group]))
            out = []
            for _, (doc, row, count, groups) in trie.entries():
                out.extend((group, doc, row, count) for group in groups)
                if len(out) >= 4096:
                    yield _rows(out, _OWNERS)
                    out = []
            if out:
                yield _rows(out, _OWNERS)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
           trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty,
    so null and empty texts form one group. The row with the largest (or
    smallest) id stays; a null id stays only where its group has no other. Of
    repeated rows with that id exactly one is kept. ``text_sha256`` is that of
    the lower-cased text in UTF-8. An empty table gives an empty result; other
    columns are not looked at.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest = keep == "largest"
    texts = common.id_and_text(docs, id_col, text_col)
    rows = common.store(common.map_batches(texts, _local_groups(largest, trie_bytes), LOCAL), "exact-rows", BATCH_ROWS)
    heads = rows.filter(F.col("body").isNotNull())
    heads = heads.repartition(common.partitions(docs), "length", "content_hash").select(*_HEADS)
    found = common.map_batches(heads, _owners(largest, trie_bytes), "group_id long, keep_id long, keep_row long, group_size long")
    members = rows.select("row_id", "doc_id", "text_sha256", "group_id")
    return members.join(found, "group_id").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows are told apart by id and text: of repeated rows with the same id and
    text one stays, whichever its other columns are.
    """
    kept = owners(docs, id_col, text_col, keep).filter("kept")
    stay = kept.select(*(c.alias(n) for n, c in _row_key(F.col("doc_id"), F.col("text_sha256")).items()))
    rows = common.boxed(docs, **_row_key(F.col(f"`{id_col}`").cast("long"), text_digest(text_col)))
    # Plain equality: whole rows are shuffled and sorted once, for the join and for what repeats.
    return rows.join(stay, stay.columns, "left_semi").dropDuplicates(stay.columns).select("row.*")


def _row_key(doc_id: Column, sha: Column) -> dict[str, Column]:
    """Columns that are never null and tell rows apart by id, null or not, and text."""
    return {"id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull(), "sha": sha}


def text_digest(text_col: str):
    """SHA-256 of the text after lower-casing A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), upper, upper.lower()).cast("binary"), 256)
