"""WARC archives: one gzip member for each record, revisit records, a splittable reader.

Writing: a task packs its records into gzip members and one file; equal payloads
after the first are revisit records. Payloads cross the network once, already
compressed, and only to meet what their row has to refer to.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its
range, takes a place for a member only if the header of a WARC record decodes
there and the members that follow reach the end of the range unbroken, and owns
the records that start inside. The last of them may end in a later range.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.llm import common
from pictorium.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
# Without a capture time in the table every record has this date.
DATE = datetime(1970, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(sha1(payload).digest()).decode()


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _record(kind: str, page: int | None, url: str | None, payload: bytes, sha: str, size: int, refers: int | None, row: int) -> bytes:
    """A record with its headers; ids are named URIs made from the page id and the row."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{row}')}>",
        f"WARC-Date: {DATE:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: text/html",
        f"X-Payload-Length: {size}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        clean = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            head.append(f"X-Refers-To-Page-ID: {refers}")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


_MADE = pa.schema([
    ("row_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("size", pa.int64()), ("sha", pa.string()),
    ("member", pa.binary()),
])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every payload as a response record in a gzip member of its own."""
    row = TaskContext.get().partitionId() << 33
    for batch in common.pieces(batches, "text"):
        rows = []
        for page, url, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), common.utf8(batch.column("text"))):
            sha = digest(payload)
            rows.append((row, page, url, len(payload), sha, _gzip(_record("response", page, url, payload, sha, len(payload), None, row))))
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MADE)], schema=_MADE)


def _writer(folder: str):
    """Members of a partition into one file, put in place when it is whole: a repeated task writes the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        trial = f"{base}/.trial-{context.partitionId()}-{context.taskAttemptId()}"
        records = size = 0
        out = store.open_output_stream(trial)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row_id", "page_id", "url", "size", "sha", "refers_row", "refers_to", "member")]
            for row, page, url, length, sha, refers_row, refers, member in zip(*columns):
                if refers_row is not None:
                    member = _gzip(_record("revisit", page, url, b"", sha, length, refers, row))
                out.write(member)
                records += 1
                size += len(member)
        out.close()
        if records:
            store.move(trial, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))
        else:
            store.delete_file(trial)

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages`` below ``folder`` (a URI that every executor reaches).

    Returns ``path, bytes, records``: a row for each archive. Of payloads of at least ``min_bytes``
    that are equal (by SHA-1 and length) the row with the smallest id is the
    response, the others are revisits without payload that refer to it; of
    repeated rows with that id one is. Smaller payloads are always responses. A
    null payload is empty, a null id is larger than all others and stays out of
    the headers, an empty table writes no archive. Other columns are not looked at.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    texts = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{payload_col}`").cast("string").alias("text"),
    )
    made = common.store(common.map_batches(texts, _members, "row_id long, page_id long, url string, size long, sha string, member binary"), "warc-members")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_id")
    first = made.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = made.select("row_id", "sha", "size").join(first.select("sha", "size", "first"), ["sha", "size"])
    again = again.filter(F.col("row_id") != F.col("first.row_id")).select(
        "row_id", F.col("first.row_id").alias("refers_row"), F.col("first.page_id").alias("refers_to")
    )
    marked = made.join(again, "row_id", "left").repartition(common.partitions(pages), "row_id")
    written = common.map_batches(marked, _writer(folder), "path string, bytes long, records long")
    return common.store(written, "warc-files")


class _Source:
    """Bytes of a file from a place on, read block by block."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``place``; fewer only at the end of the file."""
        if not (self.start <= place and place + length <= self.start + len(self.data)):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(length, READ_BYTES))
        return self.data[place - self.start:place - self.start + length]


def _member(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The content of the member at ``place`` and where it ends; None where no whole member stands."""
    unpacker, parts, at = zlib.decompressobj(31), [], place
    try:
        while not unpacker.eof:
            block = source.at(at, 64 << 10)
            if not block:
                return None
            parts.append(unpacker.decompress(block))
            at += len(block)
            if len(parts) == 1 and not parts[0].startswith(VERSION):
                return None
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpacker.unused_data)


def _starts(source: _Source, place: int) -> bool:
    """Does the header of a WARC record decode at ``place``?"""
    try:
        return zlib.decompressobj(31).decompress(source.at(place, 4096), 64).startswith(VERSION)
    except zlib.error:
        return False


def _first(source: _Source, start: int, stop: int) -> int | None:
    """The first true member that starts in a range: from it on, members follow each other up to the end of the range."""
    place = start
    while place < stop:
        block = source.at(place, READ_BYTES)
        found = block.find(MAGIC)
        if found < 0:
            if len(block) < READ_BYTES:
                return None
            place += len(block) - len(MAGIC) + 1
            continue
        place += found
        if place >= stop:
            return None
        if _starts(source, place):
            if place == 0:
                return place
            at = place
            while at < stop and at < source.size and (member := _member(source, at)):
                at = member[1]
            if at >= stop or at == source.size:
                return place
        place += 1
    return None


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[:int(fields.get("content-length") or 0)]


_READ = pa.schema([("path", pa.string()), ("place", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, size, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "stop"))):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    source = _Source(file, size)
                    place = _first(source, start, stop)
                    while place is not None and place < min(stop, size):
                        member = _member(source, place)
                        if member is None:
                            raise ValueError(f"{path}: no whole record at byte {place}")
                        fields, payload = parse(member[0])
                        sha = digest(payload)
                        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", f"sha1:{sha}") != f"sha1:{sha}":
                            raise ValueError(f"{path}: payload of the record at byte {place} has another digest")
                        rows.append((path, place, list(fields.items()), payload))
                        held += len(payload)
                        place = member[1]
                        if held > common.BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    return run


def read_archives(spark: SparkSession, files: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of gzip archives: ``path, place, headers, payload``.

    ``files`` has ``path`` (as the file system of the URI ``root`` names it) and
    ``bytes``. Every range of ``range_bytes`` is read by whichever task gets it;
    a record belongs to the range in which it starts. A damaged record, or a
    response whose payload has another digest than its header says, raises. No
    files, no records.
    """
    cut = files.select(
        "path", F.col("bytes").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))).alias("start"),
    )
    cut = cut.withColumn("stop", F.col("start") + range_bytes).repartition(common.partitions(files), "path", "start")
    return common.map_batches(cut, _reader(root), "path string, place long, headers map<string,string>, payload binary")


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes`` of the archives (``.warc.gz``) below a URI."""
    store, base = fs.FileSystem.from_uri(root)
    found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")]
    return spark.createDataFrame(found, "path string, bytes long")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared folder, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def page_records(records: DataFrame) -> DataFrame:
    """What the records of ``write_archives`` say: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    head = lambda name: F.try_element_at("headers", F.lit(name))
    return records.select(
        head("x-page-id").cast("long").alias("page_id"), head("x-payload-length").cast("long").alias("payload_bytes"),
        F.regexp_replace(head("warc-payload-digest"), "^sha1:", "").alias("payload_digest"), head("warc-type").alias("record_type"),
        head("x-refers-to-page-id").cast("long").alias("refers_to"),
    )
