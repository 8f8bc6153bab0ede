"""Library documents: one JSON object with a header and the list of photos."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pictorium import schemas
from pictorium.functions import jsoncuts
from pictorium.operators.ordering import file_place, numbered, numbered_by_file
from pictorium.session import ship_package

PHOTOS = jsoncuts.list_opening("photos")
# Documents are read in pieces between places of this character, wherever it stands.
PIECE_END = "}"
# Bytes of a document that a task looks at together.
CHUNK_BYTES = 4 << 20
# Names the parts of a written document that belong together.
CURRENT = "_current"


def _typed(photo: Column, photo_id: Column) -> list[Column]:
    """Columns of a photo given as VARIANT; a field of another type, or a missing one, is null.

    ``keywords`` drifts: a list of tags, an object of flags, or an empty object.
    """
    get = lambda name, kind: F.try_variant_get(photo, f"$.{name}", kind)
    return [
        photo_id.cast("long").alias("photo_id"),
        *(get(c, "string").alias(c) for c in ("filename", "description", "full_path")),
        get("keywords", "array<string>").alias("tags"),
        get("keywords", schemas.FLAGS).alias("flags"),
        get("metadata", schemas.METADATA).alias("metadata"),
        get("uploaded_at", "string").try_cast("timestamp_ntz").alias("uploaded_at"),
        get("face_recognition", schemas.FACE).alias("face"),
    ]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """Pieces of one split together, with the other columns of its rows.

    The character between two pieces goes to the later one: before all but the
    first piece of a file one stands for certain.
    """
    split = None
    for batch in batches:
        others = [c for c in batch.schema.names if c != "value"]
        held, size = [], 0
        for value, *now in zip(batch.column("value").to_pylist(), *(batch.column(c).to_pylist() for c in others)):
            if held and (now != split or size > CHUNK_BYTES):
                yield tuple(split), b"".join(held)
                held, size = [], 0
            held.append(value if now != split and now[2] == 0 else PIECE_END.encode() + value)
            size += len(value) + 1
            split = now
        if held:
            yield tuple(split), b"".join(held)


_LISTS = pa.list_(pa.struct([("depth", pa.int64()), ("least", pa.int64())]))
_EFFECTS = pa.schema([
    ("document", pa.string()), ("path", pa.string()), ("block", pa.int64()), ("flips", pa.bool_()), ("rise", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())),
    ("lists", pa.list_(_LISTS)),
])
_EFFECTS_DDL = "document string, path string, block long, flips boolean, rise array<long>, least array<long>, lists array<array<struct<depth:long,least:long>>>"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(split: tuple, e: jsoncuts.Effect) -> pa.RecordBatch:
        lists = [[{"depth": d, "least": x} for d, x in way] for way in e.lists]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*split, e.inside[0], e.depth, e.least, lists), _EFFECTS)], schema=_EFFECTS)

    split, effect = None, None
    for now, data in _chunks(batches):
        if now != split:
            if effect is not None:
                yield row(split, effect)
            split, effect = now, jsoncuts.Effect(PHOTOS)
        effect.add(data)
    if effect is not None:
        yield row(split, effect)


_CUT = pa.schema([("document", pa.string()), ("path", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()), ("photo", pa.binary())])
_CUT_DDL = "document string, path string, block long, number long, whole boolean, photo binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(split: tuple, found: list[tuple]) -> pa.RecordBatch:
        columns = [[v] * len(found) for v in split[:3]] + [list(c) for c in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    split, cutter = None, None
    for now, data in _chunks(batches):
        if now != split:
            if cutter is not None and (found := list(cutter.rest())):
                yield rows(split, found)
            split, cutter = now, jsoncuts.Cutter(PHOTOS, *now[3:])
        if found := list(cutter.cut(data)):
            yield rows(split, found)
    if cutter is not None and (found := list(cutter.rest())):
        yield rows(split, found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``document, path, block, value``: every file is a document, or the parts of a written one are."""
    parts = current_parts(spark, path)
    raw = spark.read.text(parts or path, lineSep=PIECE_END)
    file = F.col("_metadata.file_path")
    document = F.lit(path) if parts else file
    return raw.select(document.alias("document"), file.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _starts(effects: DataFrame) -> DataFrame:
    """State at the start of each split, from what all earlier ones of the document do: one row for each split."""
    split = ("document", "path", "block")
    document = W.partitionBy("document").orderBy("path", "block")
    earlier = document.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(earlier), F.lit(0)) % 2
    effects = effects.withColumn("inside", inside)
    at = lambda c: F.get(c, F.col("inside"))
    depth = F.coalesce(F.sum(at("rise")).over(earlier), F.lit(0))
    effects = effects.select(*split, "inside", depth.alias("depth"), at("least").alias("least"), at("lists").alias("lists"))
    # The list stays open beyond a split, or it ends there, or nothing happens to it.
    opened = F.filter("lists", lambda x: x["depth"] + F.col("depth") == jsoncuts.LIST)
    last = F.try_element_at(opened, F.lit(-1))
    listed = F.when(last.isNotNull(), last["least"] + F.col("depth") >= jsoncuts.LIST).when(F.col("least") + F.col("depth") <= jsoncuts.DOCUMENT, F.lit(False))
    return effects.select(
        *split, (F.col("inside") == 1).alias("inside"), "depth", F.coalesce(F.last(listed, ignorenulls=True).over(earlier), F.lit(False)).alias("listed")
    )


def _photos(spark: SparkSession, path: str) -> DataFrame:
    """``place, photo``: JSON text of every photo with its number over all documents."""
    ship_package(spark)
    pieces = _pieces(spark, path)
    split = ["document", "path", "block"]
    # A row for each split of the scan, which the driver lists anyway.
    starts = _starts(pieces.mapInArrow(_effects, _EFFECTS_DDL))
    known = pieces.join(F.broadcast(starts), split).select(*split, "inside", "depth", "listed", "value")
    cut = known.mapInArrow(_cut, _CUT_DDL)
    # Again a row for each split: how many photos open there, and what its borders cut apart.
    piece = F.when(~F.col("whole"), F.col("photo"))
    borders = cut.groupBy(*split).agg(
        F.count_if(F.col("number") >= 0).alias("n"), F.max(F.when(F.col("number") < 0, piece)).alias("head"), F.max(F.when(F.col("number") >= 0, piece)).alias("tail")
    )
    in_order = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    first = borders.select(*split, F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("first"))
    whole = cut.filter("whole").join(F.broadcast(first), split).select((F.col("first") + F.col("number")).alias("place"), F.col("photo").cast("string").alias("photo"))
    parts = F.filter(F.array(
        F.struct((F.col("first") - 1).alias("place"), F.col("head").alias("photo")), F.struct((F.col("first") + F.col("n") - 1).alias("place"), F.col("tail").alias("photo"))
    ), lambda x: x["photo"].isNotNull())
    parts = borders.join(F.broadcast(first), split).select("path", "block", F.explode(parts).alias("x"))
    parts = parts.groupBy("x.place").agg(F.array_sort(F.collect_list(F.struct("path", "block", "x.photo"))).alias("parts"))
    photo = F.aggregate("parts", F.lit("").cast("binary"), lambda text, part: F.concat(text, part["photo"]))
    return whole.union(parts.select("place", photo.cast("string").alias("photo")))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Photos of documents in any JSON layout, with array order as ``photo_id`` from 0, over the files in order.

    A document is read in splits, however it is laid out: each split gives what
    it does to the state of a JSON reader, the states at all borders follow from
    those, and every split then cuts its own photos. ``photos`` may stand
    anywhere in the document, which may have other lists of objects. A photo
    that is no valid JSON has null in all columns; files without photos have no rows. A
    folder written by ``write_document`` is one document.
    """
    return _photos(spark, path).select(*_typed(F.try_parse_json("photo"), F.col("place")))


def read_library_document(spark: SparkSession, path: str) -> DataFrame:
    """Photos of a document in any JSON layout; a file is one task, array order is ``photo_id``."""
    documents = spark.read.option("singleVariantColumn", "document").option("multiLine", True).json(path)
    photos = documents.lateralJoin(spark.tvf.variant_explode(F.try_variant_get(F.col("document").outer(), "$.photos", "variant")))
    return photos.select(*_typed(F.col("value"), F.col("pos")))


def read_library_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of each document; that of a written one stands in its first part."""
    parts = current_parts(spark, path)
    if parts:
        first = spark.read.text(parts[0]).select("value", *file_place()).orderBy("_block", "_line").limit(2).select("value")
        header = first.filter(F.startswith("value", F.lit(HEADER)))
        text = F.substr("value", F.lit(len(HEADER) + 1))
        return header.select(F.from_json(F.left(text, F.length(text) - 1), schemas.DOCUMENT_HEADER).alias("metadata")).select("metadata.*")
    schema = f"metadata struct<{_fields(schemas.DOCUMENT_HEADER)}>"
    return spark.read.schema(schema).json(path, multiLine=True).select("metadata.*")


def _fields(ddl: str) -> str:
    """DDL of a struct's fields from DDL of columns."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def photo_json(library: DataFrame) -> Column:
    """A photo as one JSON object; flags take the place of tags once they exist."""
    columns = library.columns
    keywords = F.lit("{}")
    if "tags" in columns:
        keywords = F.coalesce(F.to_json("tags"), keywords)
    if "flags" in columns:
        keywords = F.coalesce(F.to_json("flags"), keywords)
    plain = [c for c in ("filename", "description", "full_path") if c in columns]
    extra = [F.col(c).alias(n) for c, n in (("metadata", "metadata"), ("face", "face_recognition")) if c in columns]
    if "uploaded_at" in columns:
        extra.append(F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("uploaded_at"))
    rest = F.to_json(F.struct(*plain, *extra))
    return F.concat(F.left(rest, F.length(rest) - 1), F.lit(',"keywords":'), keywords, F.lit("}"))


def write_library(library: DataFrame, path: str) -> None:
    """Photos as JSON lines below a new path; an existing path is never overwritten."""
    library.select(photo_json(library).alias("value")).write.mode("errorifexists").text(path)


HEADER = '  "metadata": '
OPENING, ENDING = '  "photos": [', "  ]"


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _read_small(spark: SparkSession, path: str) -> str | None:
    files, place = _file(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current_parts(spark: SparkSession, path: str) -> list[str] | None:
    """Parts of the document in the folder, in order; None for any other path."""
    if any(c in path for c in "*?[{"):
        return None
    named = _read_small(spark, f"{path.rstrip('/')}/{CURRENT}")
    return [f"{path.rstrip('/')}/{p}" for p in json.loads(named)["parts"]] if named else None


def write_document(library: DataFrame, path: str, source_file: str = "", source_directory: str = "", conversion_info: str = "") -> int:
    """Photos by ``photo_id`` as one JSON document with its header, in parts below a folder; returns the number of photos.

    The photos are counted first. The tasks write the parts of a new version,
    which put together in order are the document: the header stands before the
    first photo, a comma before every other one, the closing brackets after the
    last. Only then ``_current`` is replaced, by one rename, and names the parts; until
    then readers see the version before, and a failed write leaves it. Earlier
    versions stay as backups. ``photo_id`` must not repeat.
    """
    spark = library.sparkSession
    total = library.count()
    header = {"total_photos": total, "source_file": source_file, "source_directory": source_directory, "conversion_info": conversion_info}
    rows = numbered(library.select("photo_id", photo_json(library).alias("json")), [("photo_id", True)], name="line")
    lines = rows.select("line", F.concat(F.lit("    "), "json", F.when(F.col("line") < total, ",").otherwise("")).alias("value"))
    frame = [(-3, "{"), (-2, f"{HEADER}{json.dumps(header, ensure_ascii=False)},"), (-1, OPENING), (total + 1, ENDING), (total + 2, "}")]
    lines = lines.union(spark.createDataFrame(frame, "line long, value string"))
    version = f"version={uuid.uuid4().hex}"
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("errorifexists").text(f"{path.rstrip('/')}/{version}")
    files, place = _file(spark, f"{path.rstrip('/')}/{version}")
    names = sorted(s.getPath().getName() for s in files.listStatus(place))
    _switch(spark, path, {"version": version, "total_photos": total, "parts": [f"{version}/{n}" for n in names if n.startswith("part-")]})
    return total


def _switch(spark: SparkSession, path: str, manifest: dict) -> None:
    """Replace the manifest of a folder by one rename."""
    jvm = spark.sparkContext._jvm
    files, new = _file(spark, f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}")
    stream = files.create(new, False)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{CURRENT}"), options)


def read_library_lines(spark: SparkSession, path: str) -> DataFrame:
    """Photos from JSON lines, numbered in file order; empty lines are none."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    placed = numbered_by_file(lines.select(F.try_parse_json("value").alias("photo"), *file_place()), "_place")
    return placed.select(*_typed(F.col("photo"), F.col("_place")))
