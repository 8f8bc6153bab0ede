"""Vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium import schemas
from pictorium.operators.vectors import embedding_metadata


def read_embeddings(spark: SparkSession, path: str, model_name: str | None = None, dim: int | None = None) -> DataFrame:
    """``photo_id, model_name, embedding``; with ``dim``, a vector of another size raises."""
    vectors = spark.read.schema(schemas.VECTORS).parquet(path)
    if model_name is not None:
        vectors = vectors.filter(F.col("model_name") == model_name)
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit("vector of another size: photo "), F.col("photo_id").cast("string")))
        vectors = vectors.withColumn(
            "embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong.cast("array<float>"))
        )
    return vectors


def write_embeddings(vectors: DataFrame, path: str) -> DataFrame:
    """Write vectors below a new path, partitioned by model, and return their metadata rows."""
    typed = vectors.select("photo_id", "model_name", F.col("embedding").cast("array<float>").alias("embedding"))
    typed.write.mode("errorifexists").partitionBy("model_name").parquet(path)
    return embedding_metadata(read_embeddings(vectors.sparkSession, path))
