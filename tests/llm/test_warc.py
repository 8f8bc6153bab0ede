import base64
import gzip
import hashlib
import zlib

import pytest

from pictorium.llm import warc

from .samples import noise


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture()
def pages(spark):
    # One payload is itself an archive stored without compression, so that it holds gzip magic and a record header.
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 0).decode("latin-1")
    rows = [
        (3, "http://a/ b", "same"), (1, None, "same"), (2, "http://c", "same"), (2, "http://c", "same"), (4, "http://d", None), (5, "", ""),
        (None, "http://e", "same"), (None, "http://f", "alone"), (6, "http://g", inner * 50), (7, "http://h\r\nX: 1", noise(1, 30_000)),
    ] + [(100 + i, f"http://x/{i}", noise(i, 200)) for i in range(200)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, size int")


def written(spark, pages, min_bytes=0):
    folder = warc.archive_folder(spark)
    return warc.write_archives(pages, folder, min_bytes), folder


@pytest.mark.parametrize("min_bytes", [0, 3, 10**6])
@pytest.mark.parametrize("range_bytes", [700, 1 << 24])
def test_records_come_back_once(spark, pages, min_bytes, range_bytes):
    files, folder = written(spark, pages, min_bytes)
    found = warc.page_records(warc.read_archives(spark, files, folder, range_bytes)).collect()
    expected, first = [], {}
    rows = pages.collect()
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        size = len((r.html or "").encode())
        kind, refers = "response", None
        if size >= min_bytes and r.html in (None, "") and "" in first:
            kind, refers = "revisit", first[""]
        elif size >= min_bytes and (r.html or "") in first:
            kind, refers = "revisit", first[r.html]
        first.setdefault(r.html or "", r.page_id)
        expected.append((r.page_id, size, digest(r.html), kind, refers))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_payloads_and_other_readers(spark, pages):
    files, folder = written(spark, pages)
    records = warc.read_archives(spark, files, folder).collect()
    texts = {r.page_id: r.html or "" for r in pages.collect()}
    for r in records:
        if r.headers["warc-type"] == "response" and "x-page-id" in r.headers:
            assert bytes(r.payload).decode() == texts[int(r.headers["x-page-id"])]
    listed = warc.list_archives(spark, folder)
    assert listed.count() == files.count()
    for row in files.collect():
        with gzip.open(row.path) as file:
            assert file.read(7) == warc.VERSION


def test_damage_raises(spark, pages):
    files, folder = written(spark, pages)
    first = files.orderBy("path").first()
    with open(first.path, "r+b") as file:
        file.seek(first.bytes - 20)
        file.write(b"\0" * 12)
    with pytest.raises(Exception, match="no whole record|digest"):
        warc.read_archives(spark, files, folder).collect()


def test_empty_table(spark, pages):
    files, folder = written(spark, pages.limit(0))
    assert files.collect() == []
    assert warc.read_archives(spark, files, folder).collect() == []


def test_members_are_plain_gzip():
    raw = warc._gzip(b"text")
    assert zlib.decompress(raw, 31) == b"text" and raw.startswith(warc.MAGIC)
