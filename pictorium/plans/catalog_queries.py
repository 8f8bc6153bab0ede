"""Registered queries: sources, scalar functions, selection, pages, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions import names as N
from pictorium.functions import ranking as R
from pictorium.functions import text as T
from pictorium.operators import catalog as C
from pictorium.operators import hybrid as H
from pictorium.operators import vectors as V
from pictorium.operators.ordering import numbered
from pictorium.plans import sqlbits as S
from pictorium.plans.registry import Inputs, query
from pictorium.session import scratch_path, stored
from pictorium.sources import descriptions, embeddings, folders, library, media, searchlog


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def record_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "filename", "description", "full_path",
        F.array_join("tags", ",").alias("tags"),
        F.col("metadata.file_extension").alias("file_extension"),
        F.col("metadata.description_length").alias("description_length"),
        F.col("metadata.word_count").alias("word_count"),
    )


def records(inputs: Inputs) -> DataFrame:
    """Full records of the library, numbered by id."""
    lib = inputs.library
    described = lib.select("photo_id", (F.col("photo_id") + 1).alias("line_number"), "filename", "description")
    return lib.select("photo_id", "full_path").join(
        C.photo_records(described, "/photos").drop("full_path")
        .withColumn("photo_id", F.col("metadata.line_number").cast("long") - 1),
        "photo_id",
    )


_TAGS = f"array_to_string(list_filter([{S.quoted(T.TAGS)}], lambda t: contains(lower(description), t)), ',')"
_RECORD = f"""filename, description, full_path, {_TAGS} AS tags, {S.ext('filename')} AS file_extension,
    CAST(length(description) AS INT) AS description_length,
    CAST(len({S.blank_words('description')}) AS INT) AS word_count"""


# ---------------------------------------------------------------- sources and sinks


@query("read_library", f"""
    SELECT row_number() OVER (ORDER BY photo_id) - 1 AS photo_id, {_RECORD} FROM library
""", ("library",))
def _(inputs):
    path = scratch_path(inputs.spark, "document")
    library.write_document(records(inputs), path, "descriptions.txt", "/photos")
    return record_columns(library.read_library(inputs.spark, path), "photo_id")


@query("write_document", f"""
    SELECT count(*) AS total_photos, 'descriptions.txt' AS source_file, count(*) AS n_photos, sum(CAST(strlen(description) AS BIGINT))::BIGINT AS bytes FROM library
""", ("library",))
def _(inputs):
    path = scratch_path(inputs.spark, "document")
    # A version is there already, and is replaced.
    library.write_document(records(inputs).filter("photo_id % 2 = 0"), path, "old.txt")
    library.write_document(records(inputs), path, "descriptions.txt", "/photos")
    photos = library.read_library(inputs.spark, path).agg(F.count("*").alias("n_photos"), F.sum(F.octet_length("description").cast("long")).alias("bytes"))
    return library.read_library_header(inputs.spark, path).select("total_photos", "source_file").join(photos, F.lit(True))


@query("write_library", f"SELECT {_RECORD} FROM library", ("library",))
def _(inputs):
    path = scratch_path(inputs.spark, "lines")
    library.write_library(records(inputs), path)
    return record_columns(library.read_library_lines(inputs.spark, path))


_VECTOR_ROWS = """
    SELECT photo_id, model_name, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim_no,
           round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
    FROM vectors"""


@query("read_embeddings", _VECTOR_ROWS, ("vectors",))
def _(inputs):
    path = scratch_path(inputs.spark, "vectors")
    embeddings.write_embeddings(inputs.vectors, path)
    back = embeddings.read_embeddings(inputs.spark, path, "driver-64", 64)
    return back.select("photo_id", "model_name", F.posexplode("embedding").alias("dim_no", "v")).select(
        "photo_id", "model_name", "dim_no", F.round(F.col("v").cast("double"), 6).alias("value")
    )


_EMBEDDING_METADATA = """
    SELECT model_name, count(*) AS num_embeddings, CAST(max(len(embedding)) AS INT) AS embedding_dim,
           bool_and(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-3) AS normalized
    FROM vectors GROUP BY model_name"""


@query("write_embeddings", _EMBEDDING_METADATA, ("vectors",))
def _(inputs):
    return embeddings.write_embeddings(inputs.vectors, scratch_path(inputs.spark, "vectors"))


@query("watch_files", """
    SELECT photo_id, photo_id % 10 AS album, strlen(description) + 1 AS size FROM library WHERE photo_id % 10 <> 7
""", ("library",))
def _(inputs):
    """A folder with a file for each photo: arrivals in two runs of a stream, then an album goes and a sweep finds that."""
    spark = inputs.spark
    root, listing, state = (scratch_path(spark, n) for n in ("media", "listing", "state"))
    photos = inputs.library.select("photo_id", F.pmod("photo_id", F.lit(10)).alias("album"), "description")
    for arriving in ("album < 5 OR album = 7", "album >= 5 AND album <> 7"):
        folders.append_texts(photos.filter(arriving), root, ("album", "photo_id"), "description")
        media.watch_files(spark, root, listing, state, 2_000).awaitTermination()
    folders.remove(spark, f"{root}/album=7")
    media.sweep(spark, root, listing)
    known = media.stored_listing(spark, listing).filter(F.col("path").endswith(".txt"))
    number = lambda name: F.regexp_extract("path", f"{name}=(\\d+)", 1).cast("long").alias(name)
    return known.select(number("photo_id"), number("album"), "size")


@query("embedding_metadata", _EMBEDDING_METADATA, ("vectors",))
def _(inputs):
    return V.embedding_metadata(inputs.vectors)


@query("list_media", f"""
    SELECT path_id, path, {S.base('path')} AS name, {S.ext(S.base('path'))} AS extension, size
    FROM paths
    WHERE NOT starts_with({S.base('path')}, '.') AND NOT starts_with({S.base('path')}, '_')
      AND {S.ext(S.base('path'))} IN ({S.quoted(N.IMAGE_SUFFIXES + N.VIDEO_SUFFIXES)})
""", ("paths",))
def _(inputs):
    return C.list_media(inputs.paths).select("path_id", "path", "name", "extension", "size")


@query("parse_descriptions", f"SELECT filename, {S.strip('description')} AS description FROM library", ("library",))
def _(inputs):
    path = scratch_path(inputs.spark, "descriptions")
    descriptions.write_descriptions(inputs.library, path)
    return descriptions.parse_descriptions(inputs.spark, path).select("filename", "description")


@query("write_descriptions", "SELECT concat(filename, ' - Description: ', description) AS value FROM library",
       ("library",))
def _(inputs):
    return descriptions.format_descriptions(inputs.library)


_LOG = f"""SELECT row_number() OVER (ORDER BY logged_at, seq) AS seq, {S.stamp('logged_at')} AS timestamp,
    query, expanded_query, results_count, round(top_score, 4) AS top_score, round(top_3_avg, 6) AS top_3_avg
    FROM searchlog"""


def log_rows(inputs: Inputs) -> DataFrame:
    return inputs.searchlog.select(
        F.col("logged_at").alias("timestamp"), "query", "expanded_query", "results_count",
        F.round("top_score", 4).alias("top_score"), F.round("top_3_avg", 6).alias("top_3_avg"),
        F.create_map().cast("map<string,boolean>").alias("filters"),
    )


@query("append_search_log", f"""
    SELECT query, count(*) AS n, round(sum(round(top_score, 4)), 2) AS score_sum,
           count(expanded_query) AS expanded
    FROM searchlog GROUP BY query
""", ("searchlog",))
def _(inputs):
    path = scratch_path(inputs.spark, "searchlog")
    searchlog.append_search_log(log_rows(inputs), path)
    back = searchlog.read_search_log(inputs.spark, path)
    return back.groupBy("query").agg(
        F.count("*").alias("n"), F.round(F.sum("top_score"), 2).alias("score_sum"),
        F.count("expanded_query").alias("expanded"),
    )


@query("read_search_log", _LOG, ("searchlog",))
def _(inputs):
    path = scratch_path(inputs.spark, "searchlog")
    searchlog.append_search_log(log_rows(inputs), path)
    return searchlog.read_search_log(inputs.spark, path).drop("filters").withColumn("timestamp", stamp("timestamp"))


# ---------------------------------------------------------------- scalar functions


@query("file_extension", f"SELECT path_id, {S.ext(S.base('path'))} AS extension FROM paths", ("paths",))
def _(inputs):
    return C.with_names(inputs.paths).select("path_id", "extension")


@query("media_type", f"""
    SELECT path_id, CASE WHEN {S.ext(S.base('path'))} IN ({S.quoted(N.IMAGE_SUFFIXES)}) THEN 'image'
                         WHEN {S.ext(S.base('path'))} IN ({S.quoted(N.VIDEO_SUFFIXES)}) THEN 'video'
                         ELSE 'other' END AS media_type FROM paths
""", ("paths",))
def _(inputs):
    return C.with_names(inputs.paths).select("path_id", N.media_type(F.col("extension")).alias("media_type"))


@query("file_info", f"""
    SELECT path, {S.base('path')} AS name, size, {S.stamp('modified')} AS modified,
           {S.ext(S.base('path'))} AS extension,
           {S.ext(S.base('path'))} IN ({S.quoted(N.IMAGE_SUFFIXES)}) AS is_image,
           {S.ext(S.base('path'))} IN ({S.quoted(N.VIDEO_SUFFIXES)}) AS is_video
    FROM paths
""", ("paths",))
def _(inputs):
    return C.file_info(inputs.paths).withColumn("modified", stamp("modified"))


@query("text_metadata", f"""
    SELECT photo_id, CAST(length(description) AS INT) AS description_length,
           CAST(len({S.blank_words('description')}) AS INT) AS word_count FROM library
""", ("library",))
def _(inputs):
    return inputs.library.select(
        "photo_id",
        T.description_length(F.col("description")).alias("description_length"),
        T.word_count(F.col("description")).alias("word_count"),
    )


@query("photo_record", f"""
    SELECT photo_id, filename, concat('/photos/', filename) AS full_path, {_TAGS} AS tags,
           CAST(photo_id + 1 AS INT) AS line_number, {S.ext('filename')} AS file_extension,
           CAST(length(description) AS INT) AS description_length,
           CAST(len({S.blank_words('description')}) AS INT) AS word_count
    FROM library
""", ("library",))
def _(inputs):
    described = inputs.library.select((F.col("photo_id") + 1).alias("line_number"), "filename", "description")
    built = C.photo_records(described, "/photos")
    return built.select(
        (F.col("metadata.line_number").cast("long") - 1).alias("photo_id"),
        "filename", "full_path", F.array_join("tags", ",").alias("tags"), "metadata.*",
    )


@query("tag_keywords", f"SELECT photo_id, {_TAGS} AS tags FROM library", ("library",))
def _(inputs):
    return inputs.library.select(
        "photo_id", F.array_join(T.tag_keywords(F.col("description")), ",").alias("tags")
    )


_THUMB = f"concat({S.stem('name')}, '_', ltrim({S.suffix('name')}, '.'), '.jpg')"


@query("derived_thumb_name", f"""
    SELECT path_id, {_THUMB} AS thumb_name FROM (SELECT path_id, {S.base('path')} AS name FROM paths)
""", ("paths",))
def _(inputs):
    return C.with_names(inputs.paths).select("path_id", N.thumbnail_name(F.col("name")).alias("thumb_name"))


@query("safe_upload_name", f"""
    SELECT path_id, concat('upload_', strftime(modified, '%Y%m%d_%H%M%S'), '_',
           regexp_replace({S.stem('name')}, '[^a-zA-Z0-9_-]', '_', 'g'), {S.ext('name')}) AS upload_name
    FROM (SELECT path_id, modified, {S.base('path')} AS name FROM paths) WHERE modified IS NOT NULL
""", ("paths",))
def _(inputs):
    named = C.with_names(inputs.paths).filter(F.col("modified").isNotNull())
    return named.select("path_id", N.upload_name(F.col("name"), F.col("modified")).alias("upload_name"))


@query("valid_name", f"""
    SELECT path_id, NOT (contains(path, '..') OR contains(path, '/') OR contains(path, '\\')) AS path_valid,
           NOT (contains(name, '..') OR contains(name, '/') OR contains(name, '\\') OR name = '.') AS name_valid,
           NOT contains(path, '..') AND starts_with(path, '/photos/') AS inside_root
    FROM (SELECT path_id, path, {S.base('path')} AS name FROM paths)
""", ("paths",))
def _(inputs):
    return C.with_names(inputs.paths).select(
        "path_id",
        N.is_valid_name(F.col("path")).alias("path_valid"),
        N.is_valid_name(F.col("name")).alias("name_valid"),
        N.is_valid_album(F.col("path"), "/photos").alias("inside_root"),
    )


@query("is_incomplete", f"SELECT photo_id, {S.incomplete('description')} AS incomplete FROM library", ("library",))
def _(inputs):
    return inputs.library.select("photo_id", T.is_incomplete(F.col("description")).alias("incomplete"))


# ---------------------------------------------------------------- query texts


def text_queries(inputs: Inputs) -> DataFrame:
    """The benchmark texts as a table of queries."""
    return inputs.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turn_queries(inputs: Inputs) -> DataFrame:
    """Conversation turns as a table of queries."""
    return inputs.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"),
    )


@query("query_words", f"""
    SELECT item_id AS query_id,
           CASE WHEN len({S.blank_words('text')}) > 1 THEN lower(text) END AS full_phrase,
           array_to_string(list_filter({S.blank_words('lower(text)')}, lambda w: length(w) >= 3), ' ') AS words
    FROM benchmark
""")
def _(inputs):
    found = H.query_words(text_queries(inputs))
    return found.select("query_id", "full_phrase", F.array_join("words", " ").alias("words"))


_RULES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(R.EXPANSIONS))


@query("expand_query", f"""
    SELECT photo_id AS query_id, query,
           CASE WHEN expansion IS NULL THEN query ELSE concat(query, ' ', expansion) END AS expanded
    FROM (SELECT photo_id, description AS query,
                 (SELECT expansion FROM (VALUES {_RULES}) r(priority, key, expansion)
                  WHERE contains({S.strip('lower(description)')}, key)
                  ORDER BY {S.strip('lower(description)')} <> key, priority LIMIT 1) AS expansion
          FROM library)
""", ("library",))
def _(inputs):
    asked = inputs.library.select(F.col("photo_id").alias("query_id"), F.col("description").alias("query"))
    return H.expand_queries(asked)


@query("phrase_weights", f"""
    SELECT query_id, phrase_no, token_count,
           round(raw / sum(raw) OVER (PARTITION BY query_id), 6) AS weight
    FROM (SELECT conv_id AS query_id, turn AS phrase_no, token_count,
                 CASE WHEN token_count >= 3 THEN 0.6::DOUBLE WHEN token_count = 2 THEN 0.3::DOUBLE
                      ELSE 0.2::DOUBLE END AS raw
          FROM (SELECT conv_id, turn, CAST(len({S.blank_words('text')}) AS INT) AS token_count FROM conversations))
""")
def _(inputs):
    phrases = inputs.conversations.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("phrase_no"),
        F.size(T.blank_split(F.col("text"))).alias("token_count"),
    )
    return H.phrase_weights(phrases).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- selection


@query("flag_filter", """
    SELECT photo_id, filename FROM library
    WHERE coalesce(has_characters, false) = true AND coalesce(has_cars, false) = false
""", ("library",))
def _(inputs):
    return C.flag_filter(inputs.library, has_characters=True, has_cars=False).select("photo_id", "filename")


@query("get_by_filename", """
    SELECT library.photo_id, library.filename, library.description
    FROM library
    JOIN (SELECT l.filename, min(l.photo_id) AS photo_id
          FROM library l JOIN (SELECT DISTINCT concat('src', CAST(user_id % 20 AS STRING), '_',
                                      CAST(event_id AS STRING), '.jpg') AS filename FROM events) n
            ON n.filename = l.filename
          GROUP BY l.filename) f ON f.filename = library.filename AND f.photo_id = library.photo_id
""", ("library",))
def _(inputs):
    asked = inputs.events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit("_"),
                 F.col("event_id").cast("string"), F.lit(".jpg")).alias("filename")
    )
    return C.get_by_filename(inputs.library, asked).select("photo_id", "filename", "description")


@query("admit_upload", f"""
    SELECT path_id, CASE WHEN {S.ext(S.base('path'))} NOT IN ({S.quoted(N.UPLOAD_SUFFIXES)}) THEN 'unsupported_type'
                         WHEN size > 52428800 THEN 'too_large' END AS rejection
    FROM paths
""", ("paths",))
def _(inputs):
    return C.admit_uploads(inputs.paths).select("path_id", "rejection")


@query("select_range", """
    SELECT photo_id, filename FROM library WHERE photo_id >= 50 AND description <> '' ORDER BY photo_id LIMIT 100
""", ("library",))
def _(inputs):
    return C.select_range(inputs.library, start_from=50, max_photos=100).select("photo_id", "filename")


@query("list_photos", """
    SELECT photo_id, filename, description FROM library WHERE coalesce(has_dogs, false) = false
    ORDER BY photo_id LIMIT 50 OFFSET 25
""", ("library",))
def _(inputs):
    shown, _ = C.list_photos(inputs.library, limit=50, offset=25, has_dogs=False)
    return shown.select("photo_id", "filename", "description")


@query("list_photos_total", "SELECT count(*) AS total FROM library WHERE coalesce(has_dogs, false) = false", ("library",))
def _(inputs):
    return C.list_photos(inputs.library, has_dogs=False)[1]


_ALBUM_FILES = f"""
    SELECT path_id, path, {S.base('path')} AS filename, split_part(substr(path, 9), '/', 1) AS album,
           substr(path, 10 + length(split_part(substr(path, 9), '/', 1))) AS rel_path
    FROM paths
    WHERE NOT starts_with({S.base('path')}, '.') AND {S.ext(S.base('path'))} IN ({S.quoted(N.UPLOAD_SUFFIXES)})"""


@query("album_counts", f"""
    SELECT album, count(*) AS photo_count FROM ({_ALBUM_FILES})
    WHERE NOT starts_with(album, '.') AND NOT starts_with(album, '_') GROUP BY album
""", ("paths",))
def _(inputs):
    return C.album_counts(inputs.paths)


@query("album_page", f"""
    SELECT path_id, filename, album, rel_path FROM ({_ALBUM_FILES}) WHERE album = 'src3'
    ORDER BY filename, path_id LIMIT 10 OFFSET 3
""", ("paths",))
def _(inputs):
    return C.album_page(inputs.paths, "src3", limit=10, offset=3, key="path_id")[0]


@query("recent_uploads", f"""
    SELECT photo_id, filename, {S.stamp('uploaded_at')} AS uploaded_at FROM library
    WHERE uploaded_at IS NOT NULL ORDER BY library.uploaded_at DESC, photo_id LIMIT 50
""", ("library",))
def _(inputs):
    newest, _ = C.recent_uploads(inputs.library)
    return newest.select("photo_id", "filename", stamp("uploaded_at"))


_MEDIA = f"""
    SELECT path_id, path, {S.base('path')} AS name, modified FROM paths
    WHERE NOT starts_with({S.base('path')}, '.') AND NOT starts_with({S.base('path')}, '_')
      AND {S.ext(S.base('path'))} IN ({S.quoted(N.IMAGE_SUFFIXES)})"""

_SELECTIONS = {
    "newest": "modified DESC NULLS LAST, path_id",
    "oldest": "modified ASC NULLS LAST, path_id",
    "name_asc": "lower(name) ASC, path_id",
    "name_desc": "lower(name) DESC, path_id",
    "random": "md5(concat(path, '#7')), path_id",
    "filesystem": "path_id",
}


@query("select_files", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS method, path_id, name FROM ({_MEDIA}) ORDER BY {o} LIMIT 40)"
    for m, o in _SELECTIONS.items()
), ("paths",))
def _(inputs):
    # The listing is joined once, by all cores: six joins below a union would each be left with one or two tasks.
    paths = stored(inputs.paths, "paths")
    parts = [
        C.select_files(paths, m, max_files=40, seed=7, images_only=True, key="path_id")
        .select(F.lit(m).alias("method"), "path_id", "name")
        for m in _SELECTIONS
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query("listing_order", f"""
    SELECT path_id, name, row_number() OVER (ORDER BY lower(name) DESC, path_id) AS place FROM ({_MEDIA})
""", ("paths",))
def _(inputs):
    files = C.list_media(inputs.paths, images_only=True).withColumn("lowered", F.lower("name"))
    return numbered(files, [("lowered", False), ("path_id", True)], name="place").select("path_id", "name", "place")


# ---------------------------------------------------------------- counts


@query("collection_stats", """
    SELECT count(*) AS total_photos, count(*) FILTER (WHERE coalesce(has_characters, false)) AS with_characters,
           count(*) FILTER (WHERE coalesce(has_dogs, false)) AS with_dogs,
           count(*) FILTER (WHERE coalesce(has_cars, false)) AS with_cars FROM library
""", ("library",))
def _(inputs):
    return C.collection_stats(inputs.library)


@query("conversion_stats", f"""
    SELECT {S.ext('filename')} AS file_extension, count(*) AS n FROM library GROUP BY 1
""", ("library",))
def _(inputs):
    return C.conversion_stats(records(inputs))[0]


@query("conversion_averages", f"""
    SELECT round(avg(len(list_filter([{S.quoted(T.TAGS)}], lambda t: contains(lower(description), t)))), 6) AS avg_tags,
           round(avg(length(description)), 6) AS avg_length FROM library
""", ("library",))
def _(inputs):
    return C.conversion_stats(records(inputs))[1]


@query("run_summary", """
    SELECT count(*) AS processed, count(*) FILTER (WHERE event_type <> 'error') AS successful,
           count(*) FILTER (WHERE event_type = 'error') AS failed,
           round(sum(value), 4) AS duration, round(avg(value), 6) AS avg_duration FROM events
""")
def _(inputs):
    steps = inputs.events.select(
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration")
    )
    return C.run_summary(steps)


# ---------------------------------------------------------------- changes


_PATH_NAMES = f"SELECT path_id, path, {S.base('path')} AS name FROM paths"
_KNOWN_THUMBS = f"SELECT concat(f.n, '_jpg.jpg') AS thumb_name FROM (SELECT DISTINCT {S.stem(S.base('path'))} AS n FROM paths WHERE modified IS NOT NULL) f"


def _thumbnails(inputs: Inputs) -> DataFrame:
    """Derived files that exist: the JPEG form of every dated file."""
    named = C.with_names(inputs.paths).filter(F.col("modified").isNotNull())
    return named.select(F.concat(N.stem(F.col("name")), F.lit("_jpg.jpg")).alias("thumb_name")).distinct()


@query("missing_thumbnails", f"""
    SELECT path_id, {_THUMB} AS thumb_name FROM ({_PATH_NAMES})
    WHERE {_THUMB} NOT IN (SELECT thumb_name FROM ({_KNOWN_THUMBS}))
""", ("paths",))
def _(inputs):
    return C.missing_thumbnails(C.with_names(inputs.paths), _thumbnails(inputs)).select("path_id", "thumb_name")


@query("thumbnail_summary", f"""
    SELECT (SELECT count(*) FROM ({_KNOWN_THUMBS})) AS existing,
           count(*) FILTER (WHERE {_THUMB} IN (SELECT thumb_name FROM ({_KNOWN_THUMBS}))) AS skipped,
           count(*) FILTER (WHERE {_THUMB} NOT IN (SELECT thumb_name FROM ({_KNOWN_THUMBS}))) AS to_create
    FROM ({_PATH_NAMES})
""", ("paths",))
def _(inputs):
    return C.thumbnail_summary(C.with_names(inputs.paths), _thumbnails(inputs))


@query("name_collisions", f"""
    SELECT {_THUMB} AS thumb_name, count(*) AS n FROM ({_PATH_NAMES}) GROUP BY 1 HAVING count(*) > 1
""", ("paths",))
def _(inputs):
    return C.name_collisions(inputs.paths)


_GONE = "SELECT filename FROM library WHERE has_dogs"


@query("delete_photos", f"""
    SELECT 'library' AS kept, photo_id FROM library WHERE filename NOT IN ({_GONE})
    UNION ALL
    SELECT 'vectors', photo_id FROM vectors
    WHERE photo_id NOT IN (SELECT photo_id FROM library WHERE filename IN ({_GONE}))
""", ("library", "vectors"))
def _(inputs):
    gone = inputs.library.filter("has_dogs").select("filename")
    kept, vectors = C.delete_photos(inputs.library, inputs.vectors, gone)
    return kept.select(F.lit("library").alias("kept"), "photo_id").unionByName(
        vectors.select(F.lit("vectors").alias("kept"), "photo_id")
    )


@query("append_photo", """
    SELECT photo_id, filename, description, has_dogs FROM library
    UNION ALL
    SELECT 1000000000 + conv_id * 1000 + turn,
           concat('upload_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING), '.jpg'), text, NULL
    FROM conversations
""", ("library",))
def _(inputs):
    number = F.concat_ws("_", F.lit("upload"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    new = inputs.conversations.select(
        (F.lit(1000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("photo_id"),
        F.concat(number, F.lit(".jpg")).alias("filename"),
        F.col("text").alias("description"),
    )
    twice = new.unionByName(inputs.library.select("photo_id", "filename", "description"))
    return C.append_photos(inputs.library, twice).select("photo_id", "filename", "description", "has_dogs")


@query("merge_flags", """
    SELECT l.photo_id,
           CASE WHEN c.conv_id IS NOT NULL THEN c.n > 3 ELSE l.has_characters END AS has_characters,
           CASE WHEN c.conv_id IS NOT NULL THEN c.n % 2 = 0 ELSE l.has_dogs END AS has_dogs,
           CASE WHEN c.conv_id IS NOT NULL THEN CAST(NULL AS BOOLEAN) ELSE l.has_cars END AS has_cars
    FROM library l LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c
      ON c.conv_id = l.photo_id
""", ("library",))
def _(inputs):
    turns = inputs.conversations.groupBy(F.col("conv_id").alias("photo_id")).agg(F.count("*").alias("n"))
    flags = turns.select(
        "photo_id", (F.col("n") > 3).alias("has_characters"), (F.col("n") % 2 == 0).alias("has_dogs"),
        F.lit(None).cast("boolean").alias("has_cars"),
    )
    return C.merge_flags(inputs.library, flags).select("photo_id", *C.FLAGS)


# Names of the files that exist, copies in path order; a target is free when no file has it.
_UNIQUE = f"""
    WITH copies AS (
        SELECT path_id, {S.base('path')} AS name,
               row_number() OVER (PARTITION BY {S.base('path')} ORDER BY path_id) - 1 AS m
        FROM paths),
    own AS (SELECT DISTINCT name FROM copies),
    sizes AS (SELECT name, max(m) AS most FROM copies GROUP BY name),
    slots AS (
        SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS m
        FROM (SELECT s.name, unnest(range(1, s.most + 1 + (SELECT count(*) FROM own))) AS n FROM sizes s WHERE s.most > 0)
        WHERE concat({S.stem('name')}, '_', CAST(n AS STRING), {S.suffix('name')}) NOT IN (SELECT name FROM own))
    SELECT c.path_id, c.name, CASE WHEN c.m = 0 THEN c.name
           ELSE concat({S.stem('c.name')}, '_', CAST(s.n AS STRING), {S.suffix('c.name')}) END AS target
    FROM copies c LEFT JOIN slots s ON s.name = c.name AND s.m = c.m
"""


@query("assign_unique_names", _UNIQUE, ("paths",))
def _(inputs):
    named = C.with_names(inputs.paths).select("path_id", "name")
    return C.assign_unique_names(named, key="path_id").select("path_id", "name", "target")


_FOLDER = "split_part(path, '/', 3)"


@query("assign_unique_directories", f"""
    WITH copies AS (SELECT path_id, {_FOLDER} AS name, row_number() OVER (PARTITION BY {_FOLDER} ORDER BY path_id) - 1 AS c FROM paths),
    taken AS (SELECT DISTINCT name FROM copies WHERE contains(name, '.') UNION SELECT DISTINCT concat(name, '_2') FROM copies),
    fixed AS (SELECT name FROM copies UNION SELECT name FROM taken),
    places AS (SELECT path_id, name, c + CASE WHEN name IN (SELECT name FROM taken) THEN 1 ELSE 0 END AS m FROM copies),
    sizes AS (SELECT name, max(m) AS most FROM places GROUP BY name),
    slots AS (
        SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS m
        FROM (SELECT s.name, unnest(range(1, s.most + 1 + (SELECT count(*) FROM fixed))) AS n FROM sizes s WHERE s.most > 0)
        WHERE concat(name, '_', CAST(n AS STRING)) NOT IN (SELECT name FROM fixed))
    SELECT p.path_id, p.name, CASE WHEN p.m = 0 THEN p.name ELSE concat(p.name, '_', CAST(s.n AS STRING)) END AS target
    FROM places p LEFT JOIN slots s ON s.name = p.name AND s.m = p.m
""", ("paths",))
def _(inputs):
    """Each file asks for a new folder named after its own; folders with dots, and some numbered ones, are there already."""
    wanted = inputs.paths.select("path_id", F.split_part("path", F.lit("/"), F.lit(3)).alias("name"))
    names = wanted.select("name").distinct()
    taken = names.filter(F.contains("name", F.lit("."))).union(names.select(F.concat("name", F.lit("_2"))))
    return C.assign_unique_names(wanted, taken, "path_id", directories=True).select("path_id", "name", "target")


@query("regenerate_queue", f"""
    SELECT photo_id, filename FROM library WHERE description IS NOT NULL AND {S.incomplete('description')}
""", ("library",))
def _(inputs):
    return C.regenerate_queue(inputs.library).select("photo_id", "filename")
