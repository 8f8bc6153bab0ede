"""Readers, writers and streams: round trips, splits, restarts."""

import contextlib
import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pictorium.functions import jsoncuts
from pictorium.functions import names as N
from pictorium.operators import catalog as C
from pictorium.operators import querylog as Q
from pictorium.plans import QUERIES, registry
from pictorium.sources import descriptions, embeddings, folders, media, searchlog
from pictorium.session import spread
from pictorium.sources import library as L
from pictorium.streaming import ingest, monitor


def photo(i, keywords, **extra):
    return {
        "filename": f"p{i}.jpg", "description": f"text {i}\nsecond \"line\"\n    {{\n not a photo", "full_path": f"/photos/p{i}.jpg",
        "keywords": keywords,
        "metadata": {"line_number": i + 1, "file_extension": ".jpg", "description_length": 5, "word_count": 2},
        **extra,
    }


def document(photos):
    return {
        "metadata": {"total_photos": len(photos), "source_file": "d.txt", "source_directory": "/photos", "conversion_info": "x"},
        "photos": photos,
    }


FLAGGED = {
    "has_characters": True, "characters": [{"type": "man", "count": 1}], "has_dogs": False, "dogs": [],
    "has_cars": False, "cars": [],
}


def test_library_document_with_all_keyword_forms(spark, tmp_path):
    face = {"has_faces": True, "face_count": 1, "has_known_faces": True,
            "known_faces": [{"match_confidence": 0.8, "reference_image": "r.jpg", "distance": 0.4}]}
    photos = [
        photo(0, ["man", "dog"]), photo(1, FLAGGED, face_recognition=face),
        photo(2, {}, uploaded_at="2024-05-06T07:08:09.123456"), photo(3, []),
    ]
    path = str(tmp_path / "descriptions.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document(photos), f, indent=2, ensure_ascii=False)
    rows = L.read_library(spark, path).orderBy("photo_id").collect()
    assert rows == L.read_library_document(spark, path).orderBy("photo_id").collect()
    assert [r["photo_id"] for r in rows] == [0, 1, 2, 3]
    assert [r["description"] for r in rows] == [p["description"] for p in photos]
    assert rows[0]["tags"] == ["man", "dog"] and rows[0]["flags"] is None
    assert rows[1]["flags"]["has_characters"] is True and rows[1]["tags"] is None
    assert rows[1]["face"]["known_faces"][0]["reference_image"] == "r.jpg"
    assert rows[2]["uploaded_at"] == dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert L.read_library_header(spark, path).first()["total_photos"] == 4
    lines = str(tmp_path / "lines")
    L.write_library(L.read_library(spark, path).orderBy("photo_id"), lines)
    again = L.read_library_lines(spark, lines).orderBy("photo_id").collect()
    assert [(r["filename"], r["tags"], r["uploaded_at"], r["face"]) for r in again] == [
        (r["filename"], r["tags"], r["uploaded_at"], r["face"]) for r in rows
    ]


@pytest.mark.parametrize("layout", [{"indent": 2}, {"indent": 4}, {}, {"separators": (",", ":")}])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_every_layout_is_read_by_many_tasks(spark, tmp_path, layout, line_end):
    odd = photo(3, ["a}b", "]"], full_path="\\\\", note={"photos": [{"filename": "no photo"}]})
    photos = [photo(0, ["man"]), photo(1, FLAGGED), photo(2, {}), odd] + [photo(i, []) for i in range(4, 40)]
    path = tmp_path / "descriptions.json"
    text = json.dumps({"others": [{"filename": "x"}, {}]} | document(photos) | {"photos2": [{"filename": "y"}]}, **layout)
    path.write_bytes(text.replace("\n", line_end).encode())
    with small_splits(spark, 900):
        assert spark.read.text(str(path), lineSep=L.PIECE_END).rdd.getNumPartitions() > 5
        rows = L.read_library(spark, str(path)).orderBy("photo_id").collect()
    assert [(r["photo_id"], r["filename"]) for r in rows] == [(i, f"p{i}.jpg") for i in range(40)]
    assert rows == L.read_library_document(spark, str(path)).orderBy("photo_id").collect()
    assert rows[3]["tags"] == ["a}b", "]"] and rows[3]["full_path"] == "\\\\" and rows[2]["flags"]["has_dogs"] is None


@contextlib.contextmanager
def small_splits(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_documents_of_different_layouts_keep_their_order(spark, tmp_path):
    for k, layout in enumerate([{"indent": 2}, {}, {"indent": 1}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(document([photo(10 * k + i, ["man"]) for i in range(k + 2)]), **layout))
    (tmp_path / "3.json").write_text(json.dumps(document([])))
    (tmp_path / "4.json").write_text('{"photos": [{"filename": "last.jpg", "uploaded_at": 5, "keywords": "none"}]}')
    with small_splits(spark, 300):
        rows = L.read_library(spark, str(tmp_path)).orderBy("photo_id").collect()
    assert [r["filename"] for r in rows] == [f"p{i}.jpg" for i in (0, 1, 10, 11, 12, 20, 21, 22, 23)] + ["last.jpg"]
    assert [r["photo_id"] for r in rows] == list(range(10)) and rows[-1]["tags"] is None and rows[-1]["flags"] is None


def test_objects_are_cut_alike_at_any_border():
    chosen = random.Random(3)
    text = lambda: "".join(chosen.choice('{}[]"\\,: aé\n') for _ in range(chosen.randint(0, 12)))
    opening = jsoncuts.list_opening("photos")
    for _ in range(60):
        photos = [{text(): text(), "x": [{}, {text(): [text()]}], "photos": [{"a": text()}]} for _ in range(chosen.randint(0, 6))]
        data = json.dumps({"m": {text(): [1, {"photos": [{}]}]}, text(): [{}], "photos": photos, "z": [{"b": 1}]}, indent=chosen.choice([None, 1]), ensure_ascii=chosen.random() < 0.5)
        pieces = [b"}" * (k > 0) + p for k, p in enumerate(data.encode().split(b"}"))]
        splits = []
        while pieces:
            n = chosen.randint(1, 4)
            splits.append(pieces[:n])
            pieces = pieces[n:]
        state, depth, found, effects = False, 0, [], []
        for split in splits:
            effects.append(jsoncuts.Effect(opening))
            for piece in split:
                effects[-1].add(piece)
        listed = False
        for split, effect in zip(splits, effects):
            cutter = jsoncuts.Cutter(opening, state, depth, listed)
            for piece in split:
                for number, whole, cut in cutter.cut(piece):
                    found.append([cut]) if number >= 0 else found[-1].append(cut)
            for number, whole, cut in cutter.rest():
                found.append([cut]) if number >= 0 else found[-1].append(cut)
            opened = [x for x in effect.lists[state] if x[0] + depth == jsoncuts.LIST]
            if opened:
                listed = opened[-1][1] + depth >= jsoncuts.LIST
            elif effect.least[state] + depth <= jsoncuts.DOCUMENT:
                listed = False
            state, depth = effect.inside[state], depth + effect.depth[state]
        assert [json.loads(b"".join(f)) for f in found] == photos


def test_written_document_is_one_document(spark, tmp_path):
    path = str(tmp_path / "library")
    rows = [(i * 7, f"p{i}.jpg", f'text "{i}"\n}} {{', f"/photos/p{i}.jpg", ["man"] if i % 2 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "photo_id long, filename string, description string, full_path string, tags array<string>")
    assert L.write_document(df.limit(3), path, "old.txt") == 3
    old = L.current_parts(spark, path)
    assert L.write_document(df.repartition(6), path, "new.txt", "/photos", "é") == 50
    parts = L.current_parts(spark, path)
    assert not set(parts) & set(old) and L.read_library(spark, old[0]).count() == 3
    whole = json.loads("".join(open(p, encoding="utf-8").read() for p in parts))
    assert whole["metadata"] == {"total_photos": 50, "source_file": "new.txt", "source_directory": "/photos", "conversion_info": "é"}
    assert [p["filename"] for p in whole["photos"]] == [f"p{i}.jpg" for i in range(50)] and whole["photos"][1]["keywords"] == ["man"]
    with small_splits(spark, 500):
        read = L.read_library(spark, path).orderBy("photo_id").collect()
    assert [(r["photo_id"], r["filename"], r["description"]) for r in read] == [(i, *r[1:3]) for i, r in enumerate(rows)]
    assert tuple(L.read_library_header(spark, path).first()) == (50, "new.txt", "/photos", "é")
    # Parts of several files are one document too, and an empty library is one without photos.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        L.write_document(df, path, "many.txt")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(L.current_parts(spark, path)) > 2 and [r["filename"] for r in L.read_library(spark, path).orderBy("photo_id").collect()] == [r[1] for r in rows]
    assert L.write_document(df.limit(0), path) == 0 and L.read_library(spark, path).collect() == []
    assert L.read_library_header(spark, path).first()["total_photos"] == 0


ENTRIES = """junk before the first entry
a.jpg - Description: one
two lines
b c.HEIC  -  Description:   spaced
c.png - Description:
d.jpeg - Description: see x/y.jpg - Description: not an entry
/e.jpg - Description: neither, it has a slash
f.jpg - Description: last
"""


ENTRIES_FOUND = [
    (1, "a.jpg", "one\ntwo lines"), (2, "b c.HEIC", "spaced"), (4, "d.jpeg", "see x/y.jpg - Description: not an entry\n/e.jpg - Description: neither, it has a slash"),
    (5, "f.jpg", "last"),
]


def test_descriptions_in_one_and_in_many_splits(spark, tmp_path):
    path = tmp_path / "d.txt"
    body = ENTRIES + "".join(f"g{i}.jpg - Description: text {i}\nmore {'x' * (i % 90)}\n" for i in range(200))
    path.write_text(body, encoding="utf-8")
    want = ENTRIES_FOUND + [(6 + i, f"g{i}.jpg", f"text {i}\nmore {'x' * (i % 90)}".strip()) for i in range(200)]

    def parse():
        rows = descriptions.parse_descriptions(spark, str(path)).orderBy("line_number").collect()
        return [(r["line_number"], r["filename"], r["description"]) for r in rows]

    assert parse() == want
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert parse() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text, found", [
    ("/photos/a.jpg - Description: one\nb.jpg\n - Description: two\nc.jpg - Description: three",
     [(1, "a.jpg", "one"), (2, "b.jpg", "two"), (3, "c.jpg", "three")]),
    ("intro x.png-\n\nDescription:one\r\ny.png - Description: two", [(1, "intro x.png", "one"), (2, "y.png", "two")]),
    ("no entry here\nDescription: none", []),
    ("a.jpg - Description: one\nb.jpg - ", [(1, "a.jpg", "one\nb.jpg -")]),
    ("a.jpg - Description: one\nb.jpg - Description:", [(1, "a.jpg", "one")]),
    ("a.jpg - Description: one Description:", [(1, "a.jpg", "one Description:")]),
    ("x/a.jpg - ", []),
    ("q/a.jpg - Description: one\nz/b.jpg - Description: two\n.jpg - Description: 3\nc.d.jpg-Description:4",
     [(1, "a.jpg", "one\nz/b.jpg - Description: two\n.jpg - Description: 3"), (2, "c.d.jpg", "4")]),
    ("", []),
])
def test_openings_within_a_line_and_over_lines(spark, tmp_path, text, found):
    path = tmp_path / "d.txt"
    path.write_bytes(text.encode())
    rows = descriptions.parse_descriptions(spark, str(path)).orderBy("line_number").collect()
    assert [(r["line_number"], r["filename"], r["description"]) for r in rows] == found


def test_long_descriptions_take_linear_time(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("".join(f"g{i}.jpg - Description: {'word ' * 20_000}x{i}\n" for i in range(20)))
    count = lambda: descriptions.parse_descriptions(spark, str(path)).filter(F.length("description") > 100_000).count()
    assert count() == 20
    start = time.perf_counter()
    assert count() == 20 and time.perf_counter() - start < 20


def test_files_are_numbered_by_themselves(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"a{i}.jpg - Description: {k} {i}\n" for i in range(k + 1)))
    rows = descriptions.parse_descriptions(spark, str(tmp_path)).collect()
    assert sorted((r["line_number"], r["description"]) for r in rows) == sorted((i + 1, f"{k} {i}") for k in range(3) for i in range(k + 1))


def test_one_row_group_reaches_many_tasks(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select("id", F.repeat(F.lit("text "), 200).alias("text")).coalesce(1).write.parquet(path)
    rows = lambda df: [n for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(rows(spark.read.parquet(path))) == 1 and len(rows(spread(spark.read.parquet(path)))) == spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # A table beyond the bound stays where it is.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        assert len(rows(spread(spark.read.parquet(path)))) < spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_descriptions_come_back(spark, tmp_path):
    rows = [("a.jpg", "line one\nline two"), ("b.PNG", "été")]
    df = spark.createDataFrame(rows, "filename string, description string")
    path = str(tmp_path / "out")
    descriptions.write_descriptions(df, path)
    descriptions.write_descriptions(df, path)
    got = descriptions.parse_descriptions(spark, path).select("filename", "description").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows * 2)


def test_media_scan(spark, tmp_path):
    for name in ("a.JPG", ".hidden.jpg", "_x.png", "sub/b.mov", "sub/c.txt", "_trash/d.jpg"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"12345")
    listed = C.list_media(media.scan_files(spark, str(tmp_path)))
    got = {(r["name"], r["extension"], r["size"]) for r in listed.collect()}
    assert got == {("a.JPG", ".jpg", 5), ("b.mov", ".mov", 5)}
    assert {r["name"] for r in C.list_media(media.scan_files(spark, str(tmp_path)), images_only=True).collect()} == {"a.JPG"}
    info = C.file_info(media.scan_files(spark, str(tmp_path))).filter("is_video").first()
    assert info["name"] == "b.mov" and info["path"] == str(tmp_path / "sub/b.mov")


def test_vectors_and_wrong_sizes(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "n", [0.6, 0.8])], "photo_id long, model_name string, embedding array<float>")
    path = str(tmp_path / "v")
    meta = {r["model_name"]: r for r in embeddings.write_embeddings(df, path).collect()}
    assert meta["n"]["normalized"] and meta["m"]["embedding_dim"] == 2
    assert embeddings.read_embeddings(spark, path, "m").count() == 1
    try:
        embeddings.read_embeddings(spark, path, dim=3).select("embedding").collect()
        raise AssertionError("accepted a vector of another size")
    except Exception as e:
        assert "vector of another size" in str(e)


def test_search_log_keeps_order_and_filters(spark, tmp_path, queries):
    path = str(tmp_path / "log")
    summary = spark.createDataFrame([(0, 2, 0.51234, 0.5)], "query_id int, results_count int, top_score double, top_3_avg double")
    phrases = spark.createDataFrame([(0, 2, "dog"), (0, 1, "red hair")], "query_id int, phrase_no int, phrase string")
    for hour in (3, 1, 2):
        at = F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp_ntz")
        entries = Q.log_entries(summary, queries("red hair dog"), phrases, at, {"has_dogs": True, "has_cars": None})
        searchlog.append_search_log(entries, path)
    rows = searchlog.read_search_log(spark, path).orderBy("seq").collect()
    assert [(r["seq"], r["timestamp"].hour) for r in rows] == [(1, 1), (2, 2), (3, 3)]
    assert rows[0]["expanded_query"] == "Multi-phrase: ['red hair', 'dog']"
    assert rows[0]["top_score"] == 0.5123
    assert rows[0]["filters"] == {"has_dogs": True, "has_cars": None}


def test_ingest_appends_each_upload_once(spark, tmp_path):
    incoming, lib, vec, state = (str(tmp_path / n) for n in ("in", "lib", "vec", "state"))
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    first = [(1, "a b.JPG", 10, "red dog.", at), (2, "note.txt", 10, "no image", at), (3, "big.png", 60 * 1024 * 1024, "x", at)]
    second = [(1, "a b.JPG", 10, "again", at), (4, "c.heic", 10, "blue cat", at), (4, "c2.heic", 10, "later", at + dt.timedelta(1))]
    for rows in (first, second):
        spark.createDataFrame(rows, ingest.UPLOAD_SCHEMA).write.mode("append").parquet(incoming)
        ingest.ingest_stream(spark, incoming, lib, vec, state).awaitTermination()
    stored = {r["photo_id"]: r for r in spark.read.parquet(lib).collect()}
    assert sorted(stored) == [1, 4] and spark.read.parquet(lib).count() == 2
    assert stored[1]["filename"] == "upload_20240102_030405_a_b.jpg" and stored[1]["description"] == "red dog."
    assert stored[4]["description"] == "blue cat"
    assert sorted(r["photo_id"] for r in spark.read.parquet(vec).collect()) == [1, 4]


def test_ingest_looks_up_what_its_filters_know(spark, tmp_path, monkeypatch):
    # Filters of 64 bits are full at once, so nearly every id is looked up; the outcome is the same.
    monkeypatch.setattr(ingest, "BUCKETS", 4)
    outcomes = []
    for bits in (64, 1 << 16):
        incoming, lib, vec, state = (str(tmp_path / f"{n}{bits}") for n in ("in", "lib", "vec", "state"))
        at = dt.datetime(2024, 1, 2)
        for run in range(3):
            rows = [(i if i % 50 else None, f"p{i}.jpg", 10, f"run {run}", at + dt.timedelta(run)) for i in range(40 * run, 40 * run + 80)]
            spark.createDataFrame(rows, ingest.UPLOAD_SCHEMA).repartition(2).write.mode("append").parquet(incoming)
            ingest.ingest_stream(spark, incoming, lib, vec, state, files_per_batch=1, filter_bits=bits).awaitTermination()
        stored = spark.read.parquet(lib)
        ids = [r["photo_id"] for r in stored.filter("photo_id is not null").collect()]
        assert sorted(ids) == [i for i in range(160) if i % 50] and stored.filter("photo_id is null").count() == 6
        outcomes.append(sorted((r["photo_id"], r["description"]) for r in stored.filter("photo_id is not null").collect()))
    assert outcomes[0] == outcomes[1] and dict(outcomes[0])[79] == "run 0" and dict(outcomes[0])[81] == "run 1"


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    seen = ingest.SeenIds(spark, str(tmp_path / "ids"), 1 << 12)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "photo_id long")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(seen.fresh(rows(1, 2, 3), 0)) == [1, 2, 3]
    for _ in range(2):
        seen.add(rows(1, 2, 3), 0)
        assert ids(seen.fresh(rows(3, 4), 1)) == [4] and ids(seen.fresh(rows(1, 2, 3), 0)) == [1, 2, 3]
    seen.add(rows(4), 1)
    seen.add(rows(), 2)
    assert ids(seen.fresh(rows(1, 4, 5), 3)) == [5] and ids(seen.fresh(rows(), 3)) == []


def test_an_unreadable_library_raises(spark, tmp_path):
    incoming, lib, vec, state = (str(tmp_path / n) for n in ("in", "lib", "vec", "state"))
    row = (1, "a.jpg", 10, "x", dt.datetime(2024, 1, 2))
    spark.createDataFrame([row], ingest.UPLOAD_SCHEMA).write.mode("append").parquet(incoming)
    ingest.ingest_stream(spark, incoming, lib, vec, state).awaitTermination()
    for file in (tmp_path / "lib-ids" / "filters").rglob("part-*.parquet"):
        file.write_bytes(b"broken")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    spark.createDataFrame([row], ingest.UPLOAD_SCHEMA).write.mode("append").parquet(incoming)
    with pytest.raises(Exception):
        ingest.ingest_stream(spark, incoming, lib, vec, state).awaitTermination()
    assert spark.read.parquet(lib).count() == 1


def test_monitor_equals_the_batch_report(spark, tmp_path):
    incoming, path, state = (str(tmp_path / n) for n in ("in", "snap", "state"))
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), f"q{i % 3}" if i < 40 else "late", "x" if i % 2 else None, (i % 7) / 10) for i in range(60)]
    log = spark.createDataFrame(rows, monitor.LOG_SCHEMA)
    # Two runs from one checkpoint, with merges in between.
    for part in (log.filter("seq < 40"), log.filter("seq >= 40")):
        part.repartition(3).write.mode("append").parquet(incoming)
        monitor.query_log_monitor(spark, incoming, path, state, files_per_batch=1, merge_every=2).awaitTermination()
    got = monitor.report(monitor.latest_snapshot(spark, path)).drop("first_seq").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in Q.problematic_queries(log).collect())
    # Later batches write what they change, not the whole state.
    assert [r[0] for r in spark.read.parquet(f"{path}/changes/version=5").select("query").collect()] == ["late"]
    with pytest.raises(ValueError):
        monitor.latest_snapshot(spark, str(tmp_path / "nothing"))


def test_windowed_monitor_restarts_and_drops_late_rows(spark, tmp_path):
    incoming, path, state = (str(tmp_path / n) for n in ("in", "windows", "state"))
    day = dt.datetime(2024, 1, 1)

    def feed(*hours):
        rows = [(int(10 * h), day + dt.timedelta(hours=h), "q", None, h / 100) for h in hours]
        spark.createDataFrame(rows, monitor.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        monitor.windowed_monitor(spark, incoming, path, state, "1 hour", "2 hours", merge_every=2).awaitTermination()
        found = monitor.latest_snapshot(spark, path, monitor.WINDOW_KEYS).collect()
        return {r["start"].hour: (r["searches"], round(r["avg_top_score"], 4)) for r in found}

    assert feed(0.1, 1.1, 10.1) == {0: (1, 0.001), 1: (1, 0.011), 10: (1, 0.101)}
    # Within the lateness a row changes its window; beyond it, also after a restart, it does not.
    assert feed(9.5, 10.5, 1.2) == {0: (1, 0.001), 1: (1, 0.011), 9: (1, 0.095), 10: (2, 0.103)}
    assert feed(20.0)[20] == (1, 0.2)
    assert feed(10.7, 19.0) == {0: (1, 0.001), 1: (1, 0.011), 9: (1, 0.095), 10: (2, 0.103), 19: (1, 0.19), 20: (1, 0.2)}


def test_watched_folder_restarts_and_sweeps(spark, tmp_path):
    root, listing, state = (str(tmp_path / n) for n in ("media", "listing", "state"))

    def put(name, data):
        file = tmp_path / "media" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)

    def known():
        return {r["path"].removeprefix(root + "/"): r["size"] for r in media.stored_listing(spark, listing).collect()}

    assert known() == {}
    put("a.jpg", b"1"), put("sub/b.mov", b"22")
    media.watch_files(spark, root, listing, state, 1).awaitTermination()
    assert known() == {"a.jpg": 1, "sub/b.mov": 2}
    put("c.png", b"333")
    media.watch_files(spark, root, listing, state, 1).awaitTermination()
    assert known() == {"a.jpg": 1, "sub/b.mov": 2, "c.png": 3}
    (tmp_path / "media/a.jpg").unlink()
    put("sub/b.mov", b"4444")
    first = media.sweep(spark, root, listing)
    changes = {r["path"].removeprefix(root + "/"): (r["change"], r["size"]) for r in spark.read.parquet(f"{listing}/sweeps/version={first}").collect()}
    assert changes == {"a.jpg": ("gone", 1), "sub/b.mov": ("changed", 4)} and known() == {"sub/b.mov": 4, "c.png": 3}
    # A later arrival counts after the sweep, a second sweep finds nothing.
    put("a.jpg", b"55555"), put("_trash/d.jpg", b"6")
    media.watch_files(spark, root, listing, state, 1).awaitTermination()
    assert media.sweep(spark, root, listing) == first + 1 and spark.read.parquet(f"{listing}/sweeps/version={first + 1}").count() <= 1
    assert known() == {"a.jpg": 5, "sub/b.mov": 4, "c.png": 3}
    plan = media.scan_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    root, listing, state = (str(tmp_path / n) for n in ("media", "listing", "state"))
    for n in range(60):
        (tmp_path / f"media/album={n}").mkdir(parents=True)
        (tmp_path / f"media/album={n}/a.jpg").write_bytes(b"1" * (n + 1))
    before = spark.conf.get(media._LISTING_TASKS)
    stream = media.watch_files(spark, root, listing, state, 50)
    stream.awaitTermination()
    assert {r["size"] for r in media.stored_listing(spark, listing).collect()} == set(range(1, 61))
    tracker, bound = spark.sparkContext.statusTracker(), 2 * spark.sparkContext.defaultParallelism
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= bound
    assert spark.conf.get(media._LISTING_TASKS) == before


def test_watched_folder_is_merged_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "MERGE_EVERY", 2)
    root, listing = (str(tmp_path / n) for n in ("media", "listing"))
    put = lambda name, data: (tmp_path / "media" / name).write_bytes(data)
    known = lambda: {r["path"].removeprefix(root + "/"): r["size"] for r in media.stored_listing(spark, listing).collect()}
    folders_read = lambda: {f.split(listing)[1].rsplit("/", 1)[0] for f in media.stored_listing(spark, listing).inputFiles()}
    (tmp_path / "media").mkdir()
    for n in range(5):
        put(f"{n}.jpg", b"1" * (n + 1))
    media.watch_files(spark, root, listing, str(tmp_path / "state"), 1).awaitTermination()
    assert known() == {f"{n}.jpg": n + 1 for n in range(5)}
    # The base of four versions and the one after it are read; of older bases one is left.
    assert folders_read() == {"/base/version=3", "/arrivals/version=4"}
    assert sorted(p.name for p in (tmp_path / "listing/base").iterdir()) == ["version=1", "version=3"]
    (tmp_path / "media/0.jpg").unlink()
    put("3.jpg", b"1" * 9)
    media.sweep(spark, root, listing)
    put("5.jpg", b"1" * 6), put("6.jpg", b"1" * 7)
    media.watch_files(spark, root, listing, str(tmp_path / "state"), 1).awaitTermination()
    # Sweeps stand over a base that is made later.
    assert folders_read() == {"/base/version=5", "/arrivals/version=6", "/sweeps/version=0"}
    assert known() == {"1.jpg": 2, "2.jpg": 3, "3.jpg": 9, "4.jpg": 5, "5.jpg": 6, "6.jpg": 7}
    # What came before a micro-batch is known also where later bases are there.
    earlier = {r["path"].removeprefix(root + "/"): r["size"] for r in media.stored_listing(spark, listing, 5).collect()}
    assert len(earlier) == 4 and earlier["3.jpg"] == 9
    # A stream that begins anew writes its versions anew, without the bases of the one before.
    (tmp_path / "media/0.jpg").write_bytes(b"22")
    for name in ("sweeps", "arrivals"):
        folders.remove(spark, f"{listing}/{name}")
    media.watch_files(spark, root, listing, str(tmp_path / "state-2"), 100).awaitTermination()
    assert known() == {"0.jpg": 2, "1.jpg": 2, "2.jpg": 3, "3.jpg": 9, "4.jpg": 5, "5.jpg": 6, "6.jpg": 7}
    assert folders_read() == {"/arrivals/version=0"}


def test_arriving_files_are_scanned_in_few_tasks(spark, tmp_path):
    root, listing, state = (str(tmp_path / n) for n in ("media", "listing", "state"))
    (tmp_path / "media").mkdir()
    bound = 2 * spark.sparkContext.defaultParallelism
    for n in range(2 * bound):
        (tmp_path / f"media/{n}.jpg").write_bytes(b"1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        stream = media.watch_files(spark, root, listing, state)
        stream.awaitTermination()
        assert media.stored_listing(spark, listing).count() == 2 * bound
        assert media.scan_files(spark, root).rdd.getNumPartitions() <= bound
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= bound
    assert len(list((tmp_path / "listing/arrivals/version=0").glob("*.parquet"))) == 1


def test_texts_are_written_as_by_the_writer(spark, tmp_path):
    rows = [(1, 7, "a"), (1, 7, "b\nc"), (1, 8, None), (2, 7, ""), (-2, 7, "größe"), (None, None, "x"), (1, 7, "a"), (1, 7, "\r")]
    texts = spark.createDataFrame(rows, "album long, id long, text string").repartition(3)

    def found(path):
        files = [f for f in path.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
        return sorted((str(f.parent.relative_to(path)), f.name[:10], f.suffix, f.read_bytes()) for f in files)

    texts.write.partitionBy("album", "id").text(str(tmp_path / "spark"))
    folders.append_texts(texts, f"file://{tmp_path}/own", ("album", "id"), "text")
    assert found(tmp_path / "own") == found(tmp_path / "spark")
    # No part of a file is left, and a second call adds files.
    assert not list((tmp_path / "own").rglob(".*"))
    folders.append_texts(texts, str(tmp_path / "own"), ("album", "id"), "text")
    assert found(tmp_path / "own") == sorted(2 * found(tmp_path / "spark"))
    folders.append_texts(texts.filter("id > 100"), str(tmp_path / "empty"), ("album", "id"), "text")
    assert (tmp_path / "empty").is_dir() and not found(tmp_path / "empty")


def test_windowed_quality_drops_late_rows(spark, tmp_path):
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    out = str(tmp_path / "out")
    day = dt.datetime(2024, 1, 1)

    def feed(*hours):
        rows = [(h, day + dt.timedelta(hours=h), "q", None, 0.5) for h in hours]
        spark.createDataFrame(rows, monitor.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(monitor.LOG_SCHEMA).parquet(incoming)
        monitor.windowed_quality(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()

    feed(0, 1, 10)
    feed(2, 20)
    feed(30)
    got = {r["start"].hour: r["searches"] for r in spark.read.parquet(out).collect() if r["start"].day == 1}
    assert got[0] == 1 and got[1] == 1 and got[10] == 1 and 2 not in got


# ---------------------------------------------------------------- registered queries


def test_every_query_has_a_check_of_its_name():
    assert set(registry.CHECKS) <= set(QUERIES)
    assert len(QUERIES) >= 85


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "rank", "photo_id", "similarity"} <= set(rows[0].asDict())


def test_names_share_one_rule(spark):
    rows = spark.createDataFrame([("IMG_1.HEIC",)], "name string")
    assert rows.select(N.thumbnail_name(F.col("name"))).first()[0] == "IMG_1_HEIC.jpg"


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path, library):
    from pictorium.operators import vectors as V
    from pictorium.sources import tables

    lib = library(*[f"text {i}" for i in range(50)])
    tables.save_bucketed(lib, "t_library", 4, str(tmp_path / "l"))
    tables.save_bucketed(V.embed_text(lib).withColumn("model_name", F.lit("m")), "t_vectors", 4, str(tmp_path / "v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = V.attach_embeddings(tables.read_table(spark, "t_library"), tables.read_table(spark, "t_vectors"), "m")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert met.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE t_library")
        spark.sql("DROP TABLE t_vectors")


def test_no_registered_query_pairs_everything(spark, sf_dir):
    """Plans of the searches hold no cross join, and keyword search moves no rows."""
    for name in ("keyword_search", "keyword_search_indexed", "hybrid_search", "cosine_topk", "listing_order", "term_match"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        if name == "keyword_search":
            assert "hashpartitioning" not in plan and plan.count("regexp_extract_all") == 1
        if name == "hybrid_search":
            assert "WindowGroupLimit" in plan
