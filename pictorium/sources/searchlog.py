"""Search history as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium import schemas
from pictorium.operators.ordering import FILE_PLACE, file_place, numbered


def append_search_log(entries: DataFrame, path: str) -> None:
    """Append log rows; absent values are written as null."""
    writer = entries.write.mode("append").option("ignoreNullFields", False)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with ``seq`` from 1: by time, then by place in the files."""
    raw = spark.read.schema(schemas.SEARCH_LOG).json(path)
    order = [(c, True) for c in ("timestamp", *FILE_PLACE)]
    return numbered(raw.select("*", *file_place()), order, name="seq").select("seq", *raw.columns)
