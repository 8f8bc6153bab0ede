"""Helpers of the operators: columns by role, scratch tables, Arrow batches cut by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pictorium.session import scratch_path, ship_package

# Bytes of text that a Python task looks at together.
BATCH_BYTES = 4 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TABLES: dict[str, list[str]] = {}


def store(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table into the cluster's shared folder and read it back: lineage ends there.

    Nothing needs the shuffle files of the write afterwards, so Spark is asked
    to remove them with it. ``batch_rows`` bounds the rows that Python tasks of the
    write get together, where the session would give them more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    asked = {_CLEAN: "true"}
    if batch_rows:
        held = int(spark.conf.get(_BATCH))
        asked[_BATCH] = str(min(held, batch_rows) if held > 0 else batch_rows)
    before = {key: spark.conf.get(key) for key in asked}
    try:
        for key, value in asked.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Delete scratch tables that this application wrote: the given ones, or all of them.

    Only for tables that no unfinished DataFrame reads any more.
    """
    own = _TABLES.get(spark.sparkContext.applicationId, [])
    for path in list(own if tables is None else tables):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in own:
            own.remove(path)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of the scratch tables that are still there."""
    return list(_TABLES.get(spark.sparkContext.applicationId, []))


def id_and_text(df: DataFrame, id_col: str, text_col: str, id_name: str = "doc_id") -> DataFrame:
    """Two columns only, so that no other column of the input can clash with the operator's own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias(id_name), F.col(f"`{text_col}`").cast("string").alias("text"))


def boxed(df: DataFrame, **extra: Column) -> DataFrame:
    """Each row as one struct ``row`` beside ``extra`` columns: names of the input cannot clash with the operator's own."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in extra.items()))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package and keep no memory that a task has freed."""
    ship_package(df.sparkSession)
    return df.mapInArrow(handing_back(fn), schema)


def handing_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, then ``give_back``: an executor has more workers than cores where one task needs two, and idle ones count as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of one column; a longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return memory to the system that a worker has freed; workers go on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(values: pa.Array) -> list[bytes]:
    """Text values as UTF-8; null is empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def narrowed(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in no more partitions than one for ``each`` of ``rows``, but one a core: no shuffle, and no effect on tables that fill their partitions.

    A session that asks for many partitions else spends its time on starting tasks and committing files of a few rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def crc_fold(id_col: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
