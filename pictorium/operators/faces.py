"""Faces per photo: roll-up of matched faces and the search for known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium import schemas
from pictorium.operators.ordering import numbered
from pictorium.operators.vectors import MAX_BROADCAST_ROWS, nearest_reference

_KNOWN = "array<struct<face_no:int,match_confidence:double,reference_image:string,distance:double>>"


def photo_faces(photos: DataFrame, matches: DataFrame) -> DataFrame:
    """``photo_id, face`` for every photo; a photo without faces gets an empty result.

    Known faces stay in face order.
    """
    known = F.when(
        F.col("matched"),
        F.struct(
            "face_no",
            "match_confidence",
            F.col("ref_name").alias("reference_image"),
            "distance",
        ),
    )
    rolled = matches.groupBy("photo_id").agg(
        F.count("*").alias("face_count"),
        F.bool_or("matched").alias("has_known"),
        F.array_sort(F.collect_list(known)).alias("known"),
    )
    faces = F.transform(
        F.coalesce("known", F.array().cast(_KNOWN)),
        lambda k: F.struct(k["match_confidence"].alias("match_confidence"),
                           k["reference_image"].alias("reference_image"), k["distance"].alias("distance")),
    )
    face = F.struct(
        F.col("face_count").isNotNull().alias("has_faces"),
        F.coalesce("face_count", F.lit(0)).alias("face_count"),
        F.coalesce("has_known", F.lit(False)).alias("has_known_faces"),
        faces.alias("known_faces"),
    )
    met = photos.select("photo_id").join(rolled, "photo_id", "left")
    return met.select("photo_id", face.cast(schemas.FACE).alias("face"))


def match_faces(
    photos: DataFrame, faces: DataFrame, refs: DataFrame, threshold: float = 0.4,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``photo_id, face``: nearest references rolled up for each photo."""
    return photo_faces(photos, nearest_reference(faces, refs, threshold, max_broadcast))


def face_stats(faces: DataFrame) -> DataFrame:
    """One row of counts: photos with face data, with faces, with known faces."""
    return faces.agg(
        F.count_if(F.col("face").isNotNull()).alias("with_face_data"),
        F.count_if(F.coalesce("face.has_faces", F.lit(False))).alias("with_faces"),
        F.count_if(F.coalesce("face.has_known_faces", F.lit(False))).alias("with_known_faces"),
    )


def face_label(face: Column) -> Column:
    percent = F.format_string("%.1f", face["match_confidence"] * 100)
    return F.concat(
        F.lit("Match: "), percent, F.lit("% confidence (ref: "), face["reference_image"], F.lit(")")
    )


def known_face_search(library: DataFrame, faces: DataFrame) -> DataFrame:
    """Library rows with known faces, with ``labels``, ``face_count``, ``known_faces_count``."""
    known = faces.filter(F.col("face.has_known_faces")).select(
        "photo_id",
        F.transform("face.known_faces", face_label).alias("labels"),
        F.col("face.face_count").alias("face_count"),
        F.size("face.known_faces").alias("known_faces_count"),
    )
    return library.join(known, "photo_id")


def known_face_ranking(library: DataFrame, faces: DataFrame) -> DataFrame:
    """The semantic form: known-face photos in library order, ``rank`` from 1, similarity 1."""
    found = known_face_search(library, faces).select("photo_id", "filename", "face_count", "known_faces_count")
    return numbered(found, [("photo_id", True)], name="rank").withColumn("similarity", F.lit(1.0))
