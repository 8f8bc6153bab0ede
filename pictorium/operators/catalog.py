"""Catalogue operators: file listings, records, filters, pages, counts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions import names as N
from pictorium.functions import text as T
from pictorium.operators.ordering import Order, numbered, page

FLAGS = ("has_characters", "has_dogs", "has_cars")
DEFAULT_PAGE = 500  # fixed value: rows of a page
RECENT_UPLOADS = 50  # fixed value: uploads listed by default

# ---------------------------------------------------------------- listings


def with_names(paths: DataFrame) -> DataFrame:
    """Listing with ``name`` and ``extension``."""
    named = paths.withColumn("name", N.base_name(F.col("path")))
    return named.withColumn("extension", N.file_extension(F.col("name")))


def list_media(paths: DataFrame, images_only: bool = False) -> DataFrame:
    """Media files whose own name is not hidden."""
    wanted = N.IMAGE_SUFFIXES if images_only else N.IMAGE_SUFFIXES + N.VIDEO_SUFFIXES
    return with_names(paths).filter(N.is_listed(F.col("name")) & F.col("extension").isin(*wanted))


def file_info(paths: DataFrame) -> DataFrame:
    """``path, name, size, modified, extension, is_image, is_video`` of every file."""
    return with_names(paths).select(
        "path", "name", "size", "modified", "extension",
        N.is_image(F.col("extension")).alias("is_image"),
        N.is_video(F.col("extension")).alias("is_video"),
    )


def select_files(
    paths: DataFrame, method: str = "filesystem", max_files: int | None = None, seed: int = 0,
    images_only: bool = False, key: str = "path",
) -> DataFrame:
    """Media files in the order of ``method``, cut to ``max_files``.

    ``filesystem``, ``random`` (reproducible by ``seed``), ``newest``, ``oldest``,
    ``name_asc``, ``name_desc``. ``key`` is discovery order and breaks ties.
    """
    files = list_media(paths, images_only)
    lowered = F.lower("name")
    orders: dict[str, tuple[Column, bool]] = {
        "filesystem": (F.col(key), True),
        "random": (F.md5(F.concat(F.col("path"), F.lit(f"#{seed}"))), True),
        "newest": (F.col("modified"), False),
        "oldest": (F.col("modified"), True),
        "name_asc": (lowered, True),
        "name_desc": (lowered, False),
    }
    if method not in orders:
        raise ValueError(f"unknown selection method: {method}")
    value, ascending = orders[method]
    order: Order = [("_order", ascending), (key, True)]
    return page(files.withColumn("_order", value), order, limit=max_files).drop("_order")


def admit_uploads(paths: DataFrame) -> DataFrame:
    """Listing with ``rejection``: NULL when admitted, else the reason."""
    return with_names(paths).withColumn("rejection", N.upload_rejection(F.col("extension"), F.col("size")))


def in_albums(paths: DataFrame, root: str = "/photos") -> DataFrame:
    """Images below the root with their ``album`` and the path inside it.

    A file counts when its own name is not hidden, whatever its folders are called.
    """
    below = paths.filter(F.startswith("path", F.lit(root + "/")))
    named = with_names(below).withColumn("album", N.album_of(F.col("path"), F.lit(root)))
    shown = ~F.col("name").startswith(".") & F.col("extension").isin(*N.UPLOAD_SUFFIXES)
    inside = F.substr("path", F.length(F.lit(root)) + F.length("album") + 3)
    return named.filter(shown & (F.col("album") != "")).withColumn("rel_path", inside)


def album_counts(paths: DataFrame, root: str = "/photos") -> DataFrame:
    """``album, photo_count`` of the albums whose name is not hidden."""
    albums = in_albums(paths, root).filter(N.is_listed(F.col("album")))
    return albums.groupBy("album").agg(F.count("*").alias("photo_count")).orderBy("album")


def album_page(
    paths: DataFrame, album: str, limit: int = DEFAULT_PAGE, offset: int = 0, root: str = "/photos",
    key: str = "path",
) -> tuple[DataFrame, DataFrame]:
    """One page of an album by file name, and the one-row total."""
    files = in_albums(paths, root).filter(F.col("album") == album)
    shown = page(files, [("name", True), (key, True)], limit, offset)
    named = shown.select(key, F.col("name").alias("filename"), "album", "rel_path")
    return named, files.agg(F.count("*").alias("total"))


def missing_thumbnails(photos: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Photos whose thumbnail does not exist yet, with the name it must get."""
    planned = photos.withColumn("thumb_name", N.thumbnail_name(F.col("name")))
    return planned.join(thumbnails.select("thumb_name").distinct(), "thumb_name", "left_anti")


def thumbnail_summary(photos: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row ``existing, skipped, to_create``."""
    planned = photos.select(N.thumbnail_name(F.col("name")).alias("thumb_name"))
    known = thumbnails.select("thumb_name").distinct().withColumn("known", F.lit(True))
    met = planned.join(known, "thumb_name", "left").select(
        F.when(F.col("known"), "skipped").otherwise("to_create").alias("kind")
    )
    kinds = met.unionByName(thumbnails.select(F.lit("existing").alias("kind")))
    return kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("existing", "skipped", "to_create")])


def name_collisions(paths: DataFrame) -> DataFrame:
    """``thumb_name, n`` where several files ask for one thumbnail."""
    named = with_names(paths).select(N.thumbnail_name(F.col("name")).alias("thumb_name"))
    return named.groupBy("thumb_name").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def assign_unique_names(
    files: DataFrame, taken: DataFrame | None = None, key: str = "path", range_rows: int | None = None, directories: bool = False
) -> DataFrame:
    """``files`` with ``target``: a name that no other file and no ``taken`` name has.

    Files with one ``name`` are served in ``key`` order. The first keeps the
    name; later ones get ``stem_1``, ``stem_2`` and so on, passing over names
    that are taken or that other files carry. Numbers come from free slots, so
    one name shared by most files is handled in many tasks. The name of a
    directory has no suffix: its number stands at the end, whatever dots it has.
    """
    whole = lambda _: F.lit("")
    suffix_of = whole if directories else N.suffix
    stem_of = (lambda name: name) if directories else N.stem
    numbered_name = r"(?s)^(.*)_([1-9][0-9]{0,17})()$" if directories else r"(?s)^(.*)_([1-9][0-9]{0,17})(\.[^.]+)?$"
    options = {} if range_rows is None else {"range_rows": range_rows}
    ordered = numbered(files, [(key, True)], ("name",), "_copy", **options)
    sizes = ordered.groupBy("name").agg(F.max("_copy").alias("_copies"))

    own = files.select("name").distinct()
    fixed = own if taken is None else own.unionByName(taken.select("name")).distinct()
    clash = F.regexp_extract("name", numbered_name, 2)
    base = F.regexp_extract("name", numbered_name, 1)
    used = (
        fixed.withColumns({"suffix": suffix_of(F.col("name")), "_slot": clash, "_base": base})
        .filter(F.col("_slot") != "")
        .select(F.concat("_base", "suffix").alias("name"), F.col("_slot").cast("long").alias("_slot"))
    )
    if taken is None:
        first = own.withColumn("_first", F.lit(1))
    else:
        not_free = taken.select("name").distinct().withColumn("_first", F.lit(0))
        first = own.join(not_free, "name", "left").fillna(1, ["_first"])
    need = sizes.join(first, "name").filter(F.col("_copies") > F.col("_first")).select("name")
    gaps = numbered(used.join(need, "name"), [("_slot", True)], ("name",), "_rank", **options)

    # Copy m takes the m-th free slot. With s - r free slots before the r-th used slot s, the
    # slot of copy m is its place among the copies and the used slots sorted together.
    copies = ordered.join(first, "name").withColumn("_m", F.col("_copy") - F.col("_first"))
    kept = copies.filter(F.col("_m") <= 0).withColumn("target", F.col("name"))
    mixed = copies.filter(F.col("_m") > 0).withColumns({"_used": F.lit(0), "_slot": F.col("_m")}).unionByName(
        gaps.select("name", (F.col("_slot") - F.col("_rank")).alias("_m"), F.lit(1).alias("_used"), "_slot"),
        allowMissingColumns=True,
    )
    placed = numbered(mixed, [("_m", True), ("_used", True), ("_slot", True)], ("name",), "_target", **options)
    stem, suffix = stem_of(F.col("name")), suffix_of(F.col("name"))
    later = placed.filter(F.col("_used") == 0).withColumn(
        "target", F.concat(stem, F.lit("_"), F.col("_target").cast("string"), suffix)
    )
    columns = [*files.columns, "target"]
    return kept.select(*columns).unionByName(later.select(*columns))


# ---------------------------------------------------------------- records


def photo_records(described: DataFrame, directory: str) -> DataFrame:
    """Library records from ``line_number, filename, description``."""
    return described.select(
        "filename",
        "description",
        F.concat_ws("/", F.lit(directory.rstrip("/")), F.col("filename")).alias("full_path"),
        T.tag_keywords(F.col("description")).alias("tags"),
        F.struct(
            F.col("line_number").cast("int").alias("line_number"),
            N.file_extension(N.base_name(F.col("filename"))).alias("file_extension"),
            T.description_length(F.col("description")).alias("description_length"),
            T.word_count(F.col("description")).alias("word_count"),
        ).alias("metadata"),
    )


def flag_filter(
    library: DataFrame,
    has_characters: bool | None = None,
    has_dogs: bool | None = None,
    has_cars: bool | None = None,
) -> DataFrame:
    """Three-valued filters: None does not filter, a missing flag counts as false."""
    for name, wanted in zip(FLAGS, (has_characters, has_dogs, has_cars)):
        if wanted is not None:
            library = library.filter(F.coalesce(F.col(name), F.lit(False)) == wanted)
    return library


def list_photos(
    library: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, **flags: bool | None
) -> tuple[DataFrame, DataFrame]:
    """One page in library order, and the one-row total before paging."""
    kept = flag_filter(library, **flags)
    return page(kept, [("photo_id", True)], limit, offset), kept.agg(F.count("*").alias("total"))


def recent_uploads(library: DataFrame, limit: int = RECENT_UPLOADS) -> tuple[DataFrame, DataFrame]:
    """The newest uploads, and one row ``total, count``."""
    uploads = library.filter(F.col("uploaded_at").isNotNull())
    newest = page(uploads, [("uploaded_at", False), ("photo_id", True)], limit)
    totals = uploads.agg(F.count("*").alias("total"), F.least(F.lit(limit), F.count("*")).alias("count"))
    return newest.select("photo_id", "filename", "description", "uploaded_at"), totals


def get_by_filename(library: DataFrame, names: DataFrame) -> DataFrame:
    """The first record of each asked name."""
    asked = names.select("filename").distinct()
    record = F.struct(*[F.col(c) for c in library.columns if c not in ("photo_id", "filename")])
    first = library.join(asked, "filename", "left_semi").groupBy("filename").agg(
        F.min("photo_id").alias("photo_id"), F.min_by(record, "photo_id").alias("_record")
    )
    return first.select("photo_id", "filename", "_record.*")


def select_range(library: DataFrame, start_from: int = 0, max_photos: int | None = None) -> DataFrame:
    """Photos with a description from an index on; the cut counts only those."""
    rest = library.filter((F.col("photo_id") >= start_from) & (F.col("description") != ""))
    return page(rest, [("photo_id", True)], max_photos)


def unprocessed(library: DataFrame, column: str, force: bool = False, max_photos: int | None = None) -> DataFrame:
    """Photos that lack an annotation, or all of them when forced."""
    rest = library if force else library.filter(F.col(column).isNull())
    return page(rest, [("photo_id", True)], max_photos)


def regenerate_queue(library: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Photos whose description must be written again: ``photo_id, filename, full_path, description``.

    ``existing`` (``full_path``) drops photos whose file is gone.
    """
    queue = library.filter(F.col("description").isNotNull() & T.is_incomplete(F.col("description")))
    if existing is not None:
        queue = queue.join(existing.select("full_path").distinct(), "full_path", "left_semi")
    return queue.select("photo_id", "filename", "full_path", "description")


# ---------------------------------------------------------------- counts


def collection_stats(library: DataFrame) -> DataFrame:
    """One row ``total_photos, with_characters, with_dogs, with_cars`` in one pass."""
    flagged = {f: F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f.replace("has_", "with_")) for f in FLAGS}
    return library.agg(F.count("*").alias("total_photos"), *flagged.values())


def conversion_stats(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos for each extension, and one row ``avg_tags, avg_length``."""
    by_type = records.groupBy(F.col("metadata.file_extension").alias("file_extension")).agg(F.count("*").alias("n"))
    averages = records.agg(
        F.round(F.avg(F.size("tags")), 6).alias("avg_tags"),
        F.round(F.avg("metadata.description_length"), 6).alias("avg_length"),
    )
    return by_type.orderBy("file_extension"), averages


def run_summary(steps: DataFrame) -> DataFrame:
    """One row of counters from ``status`` and ``duration``: ok is any status that is not ``error``."""
    return steps.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") != "error").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.round(F.sum("duration"), 4).alias("duration"),
        F.round(F.avg("duration"), 6).alias("avg_duration"),
    )


# ---------------------------------------------------------------- changes


def delete_photos(library: DataFrame, vectors: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the named photos; every record with the name goes."""
    gone = names.select("filename").distinct()
    ids = library.join(gone, "filename", "left_semi").select("photo_id")
    kept = library.join(gone, "filename", "left_anti").select(*library.columns)
    return kept, vectors.join(ids, "photo_id", "left_anti").select(*vectors.columns)


def append_photos(table: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added once: an id that is already there is left alone, missing columns become NULL."""
    fresh = new.join(table.select("photo_id"), "photo_id", "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def merge_descriptions(library: DataFrame, new: DataFrame) -> DataFrame:
    """Library with new descriptions where they are not empty; metadata follows where it exists.

    ``new``: ``photo_id, new_description``. Adds ``updated``.
    """
    met = library.join(new.select("photo_id", "new_description"), "photo_id", "left")
    updated = F.coalesce(F.col("new_description") != "", F.lit(False))
    merged = met.withColumn("updated", updated)
    changes = {"description": F.when(F.col("updated"), F.col("new_description")).otherwise(F.col("description"))}
    if "metadata" in library.columns:
        refreshed = F.col("metadata").withField(
            "description_length", T.description_length(F.col("new_description"))
        ).withField("word_count", T.word_count(F.col("new_description")))
        changes["metadata"] = F.when(F.col("updated") & F.col("metadata").isNotNull(), refreshed).otherwise(
            F.col("metadata")
        )
    return merged.withColumns(changes).drop("new_description")


def merge_flags(library: DataFrame, flags: DataFrame) -> DataFrame:
    """Library with the flags of the processed photos written over its own."""
    named = {f: f"_new_{f}" for f in FLAGS}
    renamed = flags.select("photo_id", *[F.col(f).alias(n) for f, n in named.items()], F.lit(True).alias("_processed"))
    met = library.join(renamed, "photo_id", "left")
    chosen = {f: F.when(F.col("_processed"), F.col(n)).otherwise(F.col(f)) for f, n in named.items()}
    return met.withColumns(chosen).drop("_processed", *named.values())


def merge_faces(library: DataFrame, faces: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Library with ``face`` set for analysed photos; photos whose file is gone keep what they had.

    ``faces``: ``photo_id, face``. ``existing``: ``full_path``.
    """
    new = faces.select("photo_id", F.col("face").alias("_face"))
    if existing is not None:
        present = library.join(existing.select("full_path").distinct(), "full_path", "left_semi").select("photo_id")
        new = new.join(present, "photo_id", "left_semi")
    old = F.col("face") if "face" in library.columns else F.lit(None)
    return library.join(new, "photo_id", "left").withColumn("face", F.coalesce("_face", old)).drop("_face")
