"""Catalogue tables laid out for joins on ``photo_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "photo_id") -> None:
    """Store a table in ``buckets`` hash buckets by key, sorted within each.

    Library and vectors stored with the same number of buckets meet without a
    shuffle. Rows are put in their buckets first, so each bucket is one file.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
