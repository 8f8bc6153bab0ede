"""Vectors by content: every different text is encoded once, whatever asks for it and how often.

A store below a path holds ``text_key, embedding`` for one model, in versions
that are added and never changed. A library first adds the texts that the store
lacks, each once however many photos have it; drift, writing and verification
then read vectors from the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.operators import vectors as V
from pictorium.sources.folders import numbered_folders


def text_key(text: Column) -> Column:
    """Digest of a text; null counts as empty, as it does for encoders."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class EncodingStore:
    """Encoded texts of one model below ``path``."""

    def __init__(self, path: str, model_name: str, encoder=None, dim: int = 64):
        self.path, self.model_name, self.encoder, self.dim = f"{path.rstrip('/')}/{model_name}", model_name, encoder, dim

    def _versions(self, spark) -> list[int]:
        return numbered_folders(spark, self.path, "version")

    def encoded(self, spark) -> DataFrame:
        """``text_key, embedding`` of all texts so far."""
        versions = self._versions(spark)
        if not versions:
            return spark.createDataFrame([], "text_key string, embedding array<double>")
        return spark.read.schema("text_key string, embedding array<double>").parquet(*(f"{self.path}/version={v}" for v in versions))

    def add(self, texts: DataFrame, text_column: str = "description") -> int:
        """Encode the texts that are not there yet, in a new version; returns how many they were."""
        spark = texts.sparkSession
        distinct = texts.select(text_key(F.col(text_column)).alias("text_key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        # Keys meet before texts do; a text with very many photos is one row from each task.
        distinct = distinct.groupBy("text_key").agg(F.first("text").alias("text"))
        new = distinct.join(self.encoded(spark).select("text_key"), "text_key", "left_anti")
        number = max(self._versions(spark), default=-1) + 1
        vectors = V.embed_text(new, "text_key", "text", self.encoder, self.dim)
        vectors.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return spark.read.parquet(f"{self.path}/version={number}").count()

    def vectors(self, library: DataFrame, text_column: str = "description") -> DataFrame:
        """``photo_id, model_name, embedding`` of a library; what the store lacks is encoded first."""
        self.add(library, text_column)
        keyed = library.select("photo_id", text_key(F.col(text_column)).alias("text_key"))
        return keyed.join(self.encoded(library.sparkSession), "text_key").select("photo_id", F.lit(self.model_name).alias("model_name"), "embedding")


def repair_library(
    library: DataFrame, stored: DataFrame, path: str, store: EncodingStore, threshold: float = 0.90, sample_size: int = 50, tolerance: float = 0.999
) -> DataFrame:
    """``vectors.repair_embeddings`` with fresh vectors from a store: no text is encoded twice."""
    return V.repair_embeddings(library, stored, store.vectors(library), path, store.model_name, threshold, sample_size, tolerance)
