"""Input views over the given tables, in one SQL text that Spark and the check engine both run.

Names in braces are the given tables. The views have the shapes that the
operators take: a photo library, a file listing, a search log, stored and
re-encoded vectors, faces and references, description tries, model answers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pictorium.session import spread

GIVEN = ("documents", "labels", "embeddings", "events", "conversations", "benchmark")

_SUFFIX = "CASE d.lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.HEIC' WHEN 'de' THEN '.png' ELSE '.webp' END"
_ALBUM = "CASE d.source WHEN 'src18' THEN '.src18' WHEN 'src19' THEN '_src19' ELSE d.source END"

VIEWS: dict[str, str] = {
    "library": f"""
        SELECT d.doc_id AS photo_id,
               concat(d.source, '_', CAST(d.doc_id AS STRING), {_SUFFIX}) AS filename,
               d.text AS description,
               concat('/photos/', {_ALBUM}, '/', d.source, '_', CAST(d.doc_id AS STRING), {_SUFFIX}) AS full_path,
               l.quality = 1 AS has_characters,
               l.toxic = 1 AS has_dogs,
               CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars % 2 = 0 END AS has_cars,
               e.ts AS uploaded_at
        FROM {{documents}} d
        LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id
        LEFT JOIN {{events}} e ON e.event_id = d.doc_id AND e.event_type = 'purchase'""",
    "paths": f"""
        SELECT d.doc_id AS path_id,
               concat('/photos/', {_ALBUM}, '/', CASE WHEN d.doc_id % 23 = 0 THEN '.' ELSE '' END,
                      'IMG_', CAST(d.doc_id % 300 AS STRING),
                      CASE d.lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.HEIC' WHEN 'de' THEN '.mp4' ELSE '.tiff' END
               ) AS path,
               d.n_chars * 10000 AS size,
               e.ts AS modified
        FROM {{documents}} d LEFT JOIN {{events}} e ON e.event_id = d.doc_id""",
    "searchlog": """
        SELECT event_id AS seq, ts AS logged_at,
               concat(event_type, '_', CAST(user_id % 20 AS STRING)) AS query,
               CASE WHEN event_id % 2 = 0 THEN concat('Multi-phrase: ', event_type) END AS expanded_query,
               CAST(floor(value) AS INT) AS results_count,
               value / 500 AS top_score, value / 600 AS top_3_avg
        FROM {events}""",
    "vectors": """
        SELECT vec_id AS photo_id, 'driver-64' AS model_name, embedding FROM {embeddings}""",
    "fresh_vectors": """
        SELECT a.vec_id AS photo_id, b.embedding AS embedding
        FROM {embeddings} a JOIN {embeddings} b
          ON b.vec_id = CASE WHEN a.vec_id % 10 = 0 THEN a.vec_id + 1 ELSE a.vec_id END""",
    "face_refs": """
        SELECT CAST(label AS BIGINT) AS ref_id, concat('ref_', CAST(label AS STRING), '.jpg') AS ref_name,
               min_by(embedding, vec_id) AS embedding
        FROM {embeddings} GROUP BY label""",
    "faces": """
        SELECT CAST(floor(vec_id / 3) AS BIGINT) AS photo_id, CAST(vec_id % 3 AS INT) AS face_no, embedding
        FROM {embeddings}""",
    "candidates": """
        SELECT conv_id AS photo_id, turn AS candidate_idx, text FROM {conversations}""",
    "responses": """
        SELECT doc_id AS photo_id,
          CASE CAST(doc_id % 5 AS INT)
            WHEN 0 THEN '{{"has_characters": true, "characters": [{{"type": "man", "count": 2}}], "has_dogs": false, "dogs": [], "has_cars": false, "cars": []}}'
            WHEN 1 THEN 'Sure! {{"has_characters": false, "characters": [], "has_dogs": true, "dogs": [{{"type": "dog", "count": 1}}], "has_cars": false, "cars": []}} Done.'
            WHEN 2 THEN '{{"has_characters": true, "characters": [{{"type": "man", "count": 1}}], "has_dogs": false, "dogs": [], "has_cars": false'
            WHEN 3 THEN 'I cannot tell.'
            ELSE '{{"has_characters": false, "characters": [], "has_dogs": true, "dogs": [{{"type": "puppy", "count": 1}}' END AS response
        FROM {documents}""",
    # Words of a text annotated for the phrase operators: six words form a chunk, and a
    # word's class follows from its length, so that every class pattern occurs.
    "annotations": """
        SELECT photo_id, CAST(floor(pos / 6) AS INT) AS chunk, pos, token,
               CASE length(token) % 3 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' ELSE 'DET' END AS upos,
               CASE length(token) % 3 WHEN 0 THEN 'amod' ELSE 'dep' END AS dep,
               pos + 1 AS head_pos
        FROM ({word_rows}) w""",
    "search_queries": """
        SELECT * FROM (VALUES (1, 'the and'), (2, 'that with'), (3, 'license'), (4, 'worthless'), (5, 'sad people'))
            AS q(query_id, query)""",
    "boolean_queries": """
        SELECT * FROM (VALUES (1, 'license', 3), (2, 'that with', 3), (3, 'license or worthless', 3),
                              (4, 'that and worthless', 3), (5, 'this from that', 3),
                              (6, 'that with and license or worthless', 3), (7, 'of is', 2), (8, 'The, of', 3))
            AS q(query_id, query, d)""",
}

# The one place where the two engines need different text: word positions counted from 0.
_WORD_ROWS = {
    "spark": r"""
        SELECT doc_id AS photo_id, CAST(p.pos AS INT) AS pos, p.token AS token
        FROM {documents} LATERAL VIEW posexplode(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+', 0)) p AS pos, token""",
    "duckdb": r"""
        SELECT doc_id AS photo_id, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS token
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS t FROM {documents})""",
}


def _uses(text: str) -> list[str]:
    return [n for n in GIVEN if re.search(r"(?<!\{)\{" + n + r"\}(?!\})", text)]


# Texts are worth spreading when one file with one row group holds all of them.
TEXTS = ("documents", "conversations")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input views as a DataFrame."""
    text = VIEWS[name].replace("{word_rows}", _WORD_ROWS["spark"])
    return spark.sql(text, **{n: given(spark, sf_dir, n) for n in _uses(text)})


def check_cte(names: tuple[str, ...]) -> str:
    """``WITH`` clause that defines the views for the check engine."""
    parts = []
    for name in names:
        text = VIEWS[name].replace("{word_rows}", _WORD_ROWS["duckdb"])
        parts.append(f"{name} AS ({text.format(**{n: n for n in GIVEN})})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
