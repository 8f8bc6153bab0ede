"""Registered queries: faces, search log, model answers, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions import names as N
from pictorium.operators import catalog as C
from pictorium.operators import faces as FA
from pictorium.operators import modelout as M
from pictorium.operators import querylog as Q
from pictorium.operators import vectors as V
from pictorium.plans import sqlbits as S
from pictorium.plans.catalog_queries import records
from pictorium.plans.registry import Inputs, query
from pictorium.plans.search_queries import hashed
from pictorium.session import scratch_path
from pictorium.streaming import ingest, monitor

THRESHOLD = 0.75

# ---------------------------------------------------------------- faces

_NEAREST = f"""
    nearest AS (
        SELECT photo_id, face_no, ref_id, ref_name, distance, 1 - distance / 2 AS match_confidence,
               distance < {THRESHOLD} AS matched
        FROM (SELECT f.photo_id, f.face_no, r.ref_id, r.ref_name,
                     1 - list_dot_product(f.embedding::DOUBLE[], r.embedding::DOUBLE[])
                         / sqrt(list_dot_product(f.embedding::DOUBLE[], f.embedding::DOUBLE[])
                                * list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS distance
              FROM faces f, face_refs r)
        QUALIFY row_number() OVER (PARTITION BY photo_id, face_no ORDER BY distance, ref_id) = 1)"""

_NEAREST_ROWS = f"""WITH {_NEAREST}
    SELECT photo_id, face_no, ref_id, ref_name, round(distance, 6) AS distance,
           round(match_confidence, 6) AS match_confidence, matched FROM nearest"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _face_table(inputs: Inputs) -> DataFrame:
    return FA.match_faces(inputs.library, inputs.faces, inputs.face_refs, THRESHOLD)


@query("nearest_reference", _NEAREST_ROWS, ("faces", "face_refs"))
def _(inputs):
    return _rounded(V.nearest_reference(inputs.faces, inputs.face_refs, THRESHOLD), "distance", "match_confidence")


@query("nearest_reference_blocked", _NEAREST_ROWS, ("faces", "face_refs"))
def _(inputs):
    found = V.nearest_reference(inputs.faces, inputs.face_refs, THRESHOLD, max_broadcast=0)
    return _rounded(found, "distance", "match_confidence")


_ROLLED = f"""{_NEAREST},
    rolled AS (
        SELECT l.photo_id, filename, count(n.photo_id) > 0 AS has_faces, count(n.photo_id) AS face_count,
               coalesce(bool_or(n.matched), false) AS has_known_faces,
               count(*) FILTER (WHERE n.matched) AS known_faces_count,
               coalesce(string_agg(n.ref_name, ',' ORDER BY n.face_no) FILTER (WHERE n.matched), '') AS known_faces
        FROM library l LEFT JOIN nearest n ON n.photo_id = l.photo_id GROUP BY l.photo_id, filename)"""

_FACE_VIEWS = ("library", "faces", "face_refs")


@query("photo_faces", f"""
    WITH {_ROLLED} SELECT photo_id, has_faces, face_count, has_known_faces, known_faces FROM rolled
""", _FACE_VIEWS)
def _(inputs):
    names = F.array_join(F.transform("face.known_faces", lambda k: k["reference_image"]), ",")
    return _face_table(inputs).select(
        "photo_id", "face.has_faces", "face.face_count", "face.has_known_faces", names.alias("known_faces")
    )


@query("face_stats", f"""
    WITH {_ROLLED} SELECT count(*) AS with_face_data, count(*) FILTER (WHERE has_faces) AS with_faces,
           count(*) FILTER (WHERE has_known_faces) AS with_known_faces FROM rolled
""", _FACE_VIEWS)
def _(inputs):
    return FA.face_stats(_face_table(inputs))


@query("known_face_search", f"""
    WITH {_ROLLED} SELECT photo_id, filename, face_count, known_faces_count,
           (SELECT string_agg(printf('Match: %.1f%% confidence (ref: %s)', n.match_confidence * 100, n.ref_name), ' | '
                              ORDER BY n.face_no)
            FROM nearest n WHERE n.photo_id = rolled.photo_id AND n.matched) AS labels
    FROM rolled WHERE has_known_faces
""", _FACE_VIEWS)
def _(inputs):
    found = FA.known_face_search(inputs.library, _face_table(inputs))
    return found.select(
        "photo_id", "filename", "face_count", F.col("known_faces_count").cast("long").alias("known_faces_count"),
        F.array_join("labels", " | ").alias("labels"),
    )


@query("known_face_ranking", f"""
    WITH {_ROLLED} SELECT photo_id, filename, row_number() OVER (ORDER BY photo_id) AS rank, 1.0::DOUBLE AS similarity
    FROM rolled WHERE has_known_faces
""", _FACE_VIEWS)
def _(inputs):
    return FA.known_face_ranking(inputs.library, _face_table(inputs)).select(
        "photo_id", "filename", "rank", "similarity"
    )


@query("merge_faces", f"""
    WITH {_ROLLED} SELECT l.photo_id, CASE WHEN uploaded_at IS NULL THEN face_count END AS face_count,
           CASE WHEN uploaded_at IS NULL THEN has_known_faces END AS has_known_faces
    FROM rolled JOIN library l USING (photo_id)
""", _FACE_VIEWS)
def _(inputs):
    existing = inputs.library.filter("uploaded_at IS NULL").select("full_path")
    merged = C.merge_faces(inputs.library, _face_table(inputs), existing)
    return merged.select("photo_id", "face.face_count", "face.has_known_faces")


@query("unprocessed", """
    SELECT photo_id, filename FROM library WHERE photo_id NOT IN (SELECT photo_id FROM faces)
    ORDER BY photo_id LIMIT 200
""", ("library", "faces"))
def _(inputs):
    seen = inputs.faces.groupBy("photo_id").agg(F.count("*").alias("face"))
    annotated = inputs.library.join(seen, "photo_id", "left")
    return C.unprocessed(annotated, "face", max_photos=200).select("photo_id", "filename")


# ---------------------------------------------------------------- search log

_PROBLEMS = """
    SELECT query, count(*) AS count, round(avg(top_score), 4) AS avg_top_score,
           arg_min(expanded_query IS NOT NULL, seq) AS has_expansion
    FROM searchlog GROUP BY query HAVING count(*) >= 2 AND avg(top_score) < 0.1"""


@query("problematic_queries", _PROBLEMS, ("searchlog",))
def _(inputs):
    return Q.problematic_queries(inputs.searchlog, score_threshold=0.1)


@query("recent_searches", f"""
    SELECT seq, query, round(top_score, 6) AS top_score FROM searchlog ORDER BY seq DESC LIMIT 100
""", ("searchlog",))
def _(inputs):
    return _rounded(Q.recent_searches(inputs.searchlog), "top_score").select("seq", "query", "top_score")


# ---------------------------------------------------------------- model answers

_FLAG_COLUMNS = ("has_characters", "has_dogs", "has_cars")


def _flag_rows(df: DataFrame) -> DataFrame:
    def listed(name: str):
        text = F.transform(f"flags.{name}", lambda e: F.concat_ws(":", e["type"], e["count"].cast("string")))
        return F.array_join(text, ",").alias(name)

    return df.select(
        "photo_id", "outcome", *[f"flags.{c}" for c in _FLAG_COLUMNS], *[listed(c) for c in ("characters", "dogs", "cars")]
    )


def _flag_select(text: str, empty: str) -> str:
    """Flags of a JSON text in the check engine; ``empty`` tells which rows have empty flags."""
    flags = ", ".join(
        f"CASE WHEN {empty} THEN false ELSE CAST(json_extract({text}, '$.{c}') AS BOOLEAN) END AS {c}"
        for c in _FLAG_COLUMNS
    )
    lists = ", ".join(
        f"""CASE WHEN {empty} THEN '' ELSE array_to_string(list_transform(
            CAST(json_extract({text}, '$.{c}') AS JSON[]),
            lambda e: concat(json_extract_string(e, '$.type'), ':', json_extract_string(e, '$.count'))), ',') END AS {c}"""
        for c in ("characters", "dogs", "cars")
    )
    return f"{flags}, {lists}"


_SPAN = """spans AS (
    SELECT photo_id, response,
           CASE WHEN contains(response, '{') AND contains(response, '}')
                THEN substr(response, instr(response, '{'),
                            length(response) - instr(reverse(response), '}') + 2 - instr(response, '{')) END AS span
    FROM responses)"""
_BROKEN = "(span IS NOT NULL AND NOT json_valid(span))"


@query("extract_json", f"""
    WITH {_SPAN},
    read AS (SELECT photo_id, CASE WHEN span IS NULL THEN 'no_json' WHEN json_valid(span) THEN 'parsed' ELSE 'broken' END
             AS outcome, CASE WHEN json_valid(span) THEN span END AS ok FROM spans)
    SELECT photo_id, outcome, {_flag_select('ok', "outcome = 'no_json'")} FROM read
""", ("responses",))
def _(inputs):
    return _flag_rows(M.extract_json(inputs.responses))


@query("repair_json", f"""
    WITH {_SPAN},
    cut AS (SELECT photo_id, span, substr(response, instr(response, '{{')) AS p FROM spans),
    mended AS (
        SELECT photo_id, span, CASE
            WHEN contains(p, '"has_cars": false') AND NOT ends_with(rtrim(p), '}}') THEN
                rtrim(p) || CASE WHEN contains(p, '"cars":') THEN '}}' ELSE ',"cars": []}}' END
            WHEN contains(p, '"has_dogs": true') AND contains(p, '"dogs": [') THEN
                CASE WHEN NOT contains(p, '"has_cars":') THEN
                    rtrim(p) || CASE WHEN ends_with(rtrim(p), ']') THEN '' ELSE ']' END || ',"has_cars": false,"cars": []}}'
                     WHEN ends_with(rtrim(p), '}}') THEN p ELSE rtrim(p) || '}}' END
            ELSE p END AS m
        FROM cut),
    chosen AS (
        SELECT photo_id,
               CASE WHEN span IS NULL THEN 'no_json' WHEN json_valid(span) THEN 'parsed'
                    WHEN json_valid(m) THEN 'repaired' ELSE 'unreadable' END AS outcome,
               CASE WHEN json_valid(span) THEN span WHEN span IS NOT NULL AND json_valid(m) THEN m END AS ok
        FROM mended)
    SELECT photo_id, outcome, {_flag_select('ok', "ok IS NULL")} FROM chosen
""", ("responses",))
def _(inputs):
    return _flag_rows(M.repair_json(inputs.responses))


_BEST = f"""
    best AS (
        SELECT photo_id, text AS best, complete
        FROM (SELECT photo_id, candidate_idx, {S.strip('text')} AS text, NOT {S.incomplete('text')} AS complete
              FROM candidates)
        QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY complete DESC,
                                   CASE WHEN complete THEN candidate_idx END, length(text) DESC, candidate_idx) = 1)"""


@query("best_candidate", f"WITH {_BEST} SELECT * FROM best", ("candidates",))
def _(inputs):
    return M.best_candidate(inputs.candidates)


@query("continue_candidate", f"""
    WITH {_BEST} SELECT photo_id, CASE WHEN NOT complete AND best <> '' AND length({S.strip('description')}) > length(best)
                        THEN {S.strip('description')} ELSE best END AS description
    FROM best LEFT JOIN library USING (photo_id)
""", ("candidates", "library"))
def _(inputs):
    continuations = inputs.library.select("photo_id", F.col("description").alias("continuation"))
    return M.continue_candidate(M.best_candidate(inputs.candidates), continuations)


_NEW_TEXT = "CASE WHEN coalesce(best, '') <> '' THEN best ELSE description END"


@query("merge_descriptions", f"""
    WITH {_BEST} SELECT photo_id, {_NEW_TEXT} AS description,
           CAST(length({_NEW_TEXT}) AS INT) AS description_length,
           CAST(len({S.blank_words(_NEW_TEXT)}) AS INT) AS word_count,
           coalesce(best, '') <> '' AS updated
    FROM library LEFT JOIN best USING (photo_id)
""", ("candidates", "library"))
def _(inputs):
    new = M.best_candidate(inputs.candidates).select("photo_id", F.col("best").alias("new_description"))
    merged = C.merge_descriptions(records(inputs), new)
    return merged.select(
        "photo_id", "description", F.col("metadata.description_length").alias("description_length"),
        F.col("metadata.word_count").alias("word_count"), "updated",
    )


def _measure():
    """A stand-in model: the number of characters; it refuses texts that do not end a sentence."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["description"].str.strip().str.endswith((".", "!", "?")).all():
            raise ValueError("open text")
        return pd.DataFrame({"n_chars": rows["description"].str.len()})

    return model


@query("run_model", f"""
    SELECT photo_id, CASE WHEN ok THEN length(description) END AS n_chars,
           CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
    FROM (SELECT photo_id, description, NOT {S.incomplete('description')} AS ok FROM library)
""", ("library",))
def _(inputs):
    texts = inputs.library.select("photo_id", "description")
    return M.run_model(texts, _measure, "n_chars bigint", keep=("photo_id",)).select("photo_id", "n_chars", "status")


def _any_word(words: tuple[str, ...]) -> str:
    return f"len(list_intersect(w, [{S.quoted(words)}])) > 0"


@query("rule_flags", rf"""
    SELECT photo_id, {_any_word(M.HUMAN_WORDS)} AS has_characters, {_any_word(M.DOG_WORDS)} AS has_dogs,
           {_any_word(M.CAR_WORDS)} AS has_cars
    FROM (SELECT photo_id, list_transform(regexp_extract_all(description, '{S.WORD_CLASS}'), lambda x: lower(x)) AS w
          FROM library)
""", ("library",))
def _(inputs):
    return M.rule_flags(inputs.library)


# ---------------------------------------------------------------- streams


def _uploads(inputs: Inputs) -> DataFrame:
    """Listed files with their texts, as arriving uploads."""
    named = C.with_names(inputs.paths).select(
        F.col("path_id").alias("photo_id"), "name", "size", F.col("modified").alias("uploaded_at")
    )
    texts = inputs.documents.select(F.col("doc_id").alias("photo_id"), F.col("text").alias("description"))
    return named.join(texts, "photo_id").select("photo_id", "name", "size", "description", "uploaded_at")


_ADMITTED = f"""
    admitted AS (
        SELECT path_id AS photo_id, text AS description,
               concat('upload_', strftime(modified, '%Y%m%d_%H%M%S'), '_',
                      regexp_replace({S.stem('name')}, '[^a-zA-Z0-9_-]', '_', 'g'), {S.ext('name')}) AS filename,
               {S.ext('name')} AS file_extension
        FROM (SELECT path_id, modified, size, {S.base('path')} AS name FROM paths) JOIN documents ON doc_id = path_id
        WHERE {S.ext('name')} IN ({S.quoted(N.UPLOAD_SUFFIXES)}) AND size <= 52428800)"""


@query("ingest_stream", f"""
    WITH {_ADMITTED}, {hashed('e', 'photo_id', 'description', 'admitted')}
    SELECT photo_id, filename, file_extension, CAST(length(description) AS INT) AS description_length,
           CAST(len(embedding) AS INT) AS dim, round(list_sum(embedding), 6) AS embedding_sum
    FROM admitted JOIN e USING (photo_id)
""", ("paths",))
def _(inputs):
    spark = inputs.spark
    incoming, lib, vec, state = (scratch_path(spark, n) for n in ("incoming", "library", "vectors", "state"))
    _uploads(inputs).write.parquet(incoming)
    ingest.ingest_stream(spark, incoming, lib, vec, state).awaitTermination()
    stored = spark.read.parquet(lib).join(spark.read.parquet(vec).select("photo_id", "embedding"), "photo_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return stored.select(
        "photo_id", "filename", "file_extension", "description_length",
        F.size("embedding").alias("dim"), F.round(total, 6).alias("embedding_sum"),
    )


@query("query_log_monitor", _PROBLEMS, ("searchlog",))
def _(inputs):
    spark = inputs.spark
    incoming, snapshots, state = (scratch_path(spark, n) for n in ("incoming", "snapshots", "state"))
    log = inputs.searchlog.select("seq", "logged_at", "query", "expanded_query", "top_score")
    log.repartition(4, "seq").write.parquet(incoming)
    monitor.query_log_monitor(spark, incoming, snapshots, state, files_per_batch=2).awaitTermination()
    stats = monitor.latest_snapshot(spark, snapshots)
    return monitor.report(stats, score_threshold=0.1).drop("first_seq")


@query("windowed_monitor", f"""
    SELECT {S.stamp("time_bucket(INTERVAL 1 day, logged_at)")} AS start, query, count(*) AS searches,
           round(avg(top_score), 6) AS avg_top_score
    FROM searchlog GROUP BY 1, 2
""", ("searchlog",))
def _(inputs):
    spark = inputs.spark
    incoming, state, checkpoint = (scratch_path(spark, n) for n in ("incoming", "windows", "state"))
    log = inputs.searchlog.select("seq", "logged_at", "query", "expanded_query", "top_score")
    # Two runs from one checkpoint. Files come in any order of time, and the log spans less than the lateness.
    for half in (0, 1):
        log.filter(F.pmod("seq", F.lit(2)) == half).repartition(2, "seq").write.mode("append").parquet(incoming)
        monitor.windowed_monitor(spark, incoming, state, checkpoint, "1 day", "1000 days", 1, merge_every=3).awaitTermination()
    found = monitor.latest_snapshot(spark, state, monitor.WINDOW_KEYS)
    return found.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "query", "searches",
        F.round("avg_top_score", 6).alias("avg_top_score"),
    )


@query("windowed_quality", f"""
    SELECT {S.stamp("time_bucket(INTERVAL 1 day, logged_at)")} AS start, query, count(*) AS searches,
           round(avg(top_score), 6) AS avg_top_score
    FROM searchlog GROUP BY 1, 2
""", ("searchlog",))
def _(inputs):
    found = monitor.windowed_quality(inputs.searchlog, "1 day")
    return found.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "query", "searches",
        F.round("avg_top_score", 6).alias("avg_top_score"),
    )
