"""Upload flow as a stream: admit, name, encode, append once.

Ids that were taken before are kept in hash buckets, with one Bloom filter for
each bucket. A micro-batch reads the filters, whose size does not grow, and
looks only those ids up that a filter knows, in their buckets only. Filters say
what certainly is new; the look-up decides the rest, so an id is taken exactly
once whatever the filters' size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pictorium.functions import names as N
from pictorium.functions import text as T
from pictorium.operators.vectors import embed_text
from pictorium.session import ship_package
from pictorium.sources.folders import numbered_folders

UPLOAD_SCHEMA = (
    "photo_id bigint, name string, size bigint, description string, uploaded_at timestamp_ntz"
)
BUCKETS = 64
# Bits of the filter of a bucket; ten for each id keep it sharp.
FILTER_BITS = 1 << 20
HASHES = 6


def upload_records(uploads: DataFrame, directory: str) -> DataFrame:
    """Library rows of admitted uploads; works on batches and on streams."""
    extension = N.file_extension(F.col("name"))
    admitted = uploads.filter(N.upload_rejection(extension, F.col("size")).isNull())
    filename = N.upload_name(F.col("name"), F.col("uploaded_at"))
    return admitted.select(
        "photo_id",
        filename.alias("filename"),
        "description",
        F.concat(F.lit(directory.rstrip("/") + "/"), filename).alias("full_path"),
        "uploaded_at",
        extension.alias("file_extension"),
        T.description_length(F.col("description")).alias("description_length"),
    )


def bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of each id in a filter, a row for each id: two halves of a mixed id, added up again and again."""
    h = ids.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (one[:, None] + np.arange(HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


def _filter(held: pa.Table, bits: int) -> np.ndarray:
    known = held.column("bits").to_pylist()
    return np.unpackbits(np.frombuffer(known[0], np.uint8)) if known else np.zeros(bits, np.uint8)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("photo_id"), F.lit(BUCKETS)).cast("int"))


class SeenIds:
    """Ids of earlier micro-batches below a path: ``ids/batch_id=N/bucket=B`` and ``filters/batch_id=N``."""

    def __init__(self, spark: SparkSession, path: str, bits: int = FILTER_BITS):
        ship_package(spark)
        self.spark, self.path, self.bits = spark, path, bits

    def _filters(self, batch_id: int) -> DataFrame:
        """The filters after the batch before: one bounded row for each bucket."""
        earlier = [n for n in numbered_folders(self.spark, f"{self.path}/filters", "batch_id") if n < batch_id]
        if not earlier:
            return self.spark.createDataFrame([], "bucket int, bits binary")
        return self.spark.read.schema("bucket int, bits binary").parquet(f"{self.path}/filters/batch_id={earlier[-1]}")

    def fresh(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows (ids do not repeat) whose id no earlier batch has."""
        bits = self.bits
        ids = _bucketed(rows.select("photo_id").filter(F.col("photo_id").isNotNull()))

        def test(asked: pa.Table, held: pa.Table) -> pa.Table:
            own = asked.column("photo_id").to_numpy()
            known = _filter(held, bits)[bits_of(own, bits).astype(np.int64)].all(1) if len(own) else np.zeros(0, bool)
            return asked.select(["photo_id", "bucket"]).filter(pa.array(known))

        maybe = ids.groupBy("bucket").cogroup(self._filters(batch_id).groupBy("bucket")).applyInArrow(test, "photo_id long, bucket int")
        maybe = maybe.persist()
        try:
            buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
            earlier = [n for n in numbered_folders(self.spark, f"{self.path}/ids", "batch_id") if n < batch_id]
            if not buckets or not earlier:
                return rows
            stored = self.spark.read.option("basePath", f"{self.path}/ids").parquet(*(f"{self.path}/ids/batch_id={n}" for n in earlier))
            taken = stored.filter(F.col("bucket").isin(buckets)).select("photo_id").join(maybe.select("photo_id"), "photo_id", "left_semi").distinct()
            return rows.join(taken, "photo_id", "left_anti")
        finally:
            maybe.unpersist()

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Remember the ids of a batch; a batch that runs again replaces what it wrote."""
        bits = self.bits
        ids = _bucketed(rows.select("photo_id").filter(F.col("photo_id").isNotNull()))
        ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/batch_id={batch_id}")

        def merge(new: pa.Table, held: pa.Table) -> pa.Table:
            bucket = (new if new.num_rows else held).column("bucket").to_pylist()[0]
            known = _filter(held, bits).copy()
            known[bits_of(new.column("photo_id").to_numpy(), bits).astype(np.int64).ravel()] = 1
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(known).tobytes()], pa.binary())})

        filters = ids.groupBy("bucket").cogroup(self._filters(batch_id).groupBy("bucket")).applyInArrow(merge, "bucket int, bits binary")
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/batch_id={batch_id}")


def ingest_stream(
    spark: SparkSession,
    incoming: str,
    library_path: str,
    vectors_path: str,
    checkpoint: str,
    directory: str = "/photos",
    model_name: str = "hash-64",
    encoder=None,
    dim: int = 64,
    files_per_batch: int = 1_000,
    filter_bits: int = FILTER_BITS,
) -> StreamingQuery:
    """Append arriving uploads (Parquet files) to the library and to the vectors, each id once.

    A micro-batch writes its own ``batch_id`` folder and replaces it when it is
    run again, so a failed batch leaves no duplicates. Of several uploads with
    one id in a batch the earliest counts. The ids taken are kept beside the
    library, in ``<library_path>-ids``. A library or id table that cannot be read
    raises; only a folder that is not there is empty. Uploads without an id are all taken.
    """
    seen = SeenIds(spark, f"{library_path.rstrip('/')}-ids", filter_bits)

    def write(batch: DataFrame, batch_id: int) -> None:
        record = F.struct(*[c for c in batch.columns if c != "photo_id"])
        earliest = F.struct("uploaded_at", "filename")
        once = batch.filter(F.col("photo_id").isNotNull()).groupBy("photo_id").agg(F.min_by(record, earliest).alias("r")).select("photo_id", "r.*")
        fresh = seen.fresh(once, batch_id).unionByName(batch.filter(F.col("photo_id").isNull()))
        fresh.write.mode("overwrite").parquet(f"{library_path}/batch_id={batch_id}")
        written = spark.read.schema(fresh.schema).parquet(f"{library_path}/batch_id={batch_id}")
        vectors = embed_text(written, encoder=encoder, dim=dim).withColumn("model_name", F.lit(model_name))
        vectors.write.mode("overwrite").parquet(f"{vectors_path}/batch_id={batch_id}")
        seen.add(written, batch_id)

    uploads = spark.readStream.schema(UPLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    return (
        upload_records(uploads, directory)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
