"""Listings of media folders, whole and kept up to date; file contents are never read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pictorium.sources.folders import numbered_folders, remove

_CHANGES = "path string, size bigint, modified timestamp, change string"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_SCAN_TASKS = "spark.sql.files.maxPartitionNum"
_LOG_MERGE = "spark.sql.streaming.fileSource.log.compactInterval"
# Micro-batches after which arrivals are merged into a new base.
MERGE_EVERY = 20
# Largest micro-batch, in files, whose paths are broadcast to the stored listing.
BROADCAST_FILES = 200_000
ROWS_PER_FILE = 100_000


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings that lists and scans in twice as many tasks as there are cores.

    Else every folder, and every file of a micro-batch, is a task of a listing, and every few files are one of a scan,
    though none is opened. A stream also writes all names that it ever saw anew now and then; here that is
    after 100 micro-batches instead of ten. It does so whenever it runs, so the settings must stay; in their own session
    they change nothing for the caller.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    tasks = 2 * spark.sparkContext.defaultParallelism
    for name in (_LISTING_TASKS, _SCAN_TASKS):
        own.conf.set(name, str(min(int(own.conf.get(name, None) or tasks), tasks)))
    own.conf.set(_LOG_MERGE, str(max(int(own.conf.get(_LOG_MERGE, None) or 0), 100)))
    return own


def _listing(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified`` of all files below the root; file contents are not read.

    Folders that start with a dot or an underscore are passed over, so trash
    folders do not come back in.
    """
    return _listing(_listing_session(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def listing_changes(current: DataFrame, stored: DataFrame, how: str = "full") -> DataFrame:
    """``path, size, modified, change`` of files that were added, changed (size or time) or are gone since ``stored``.

    A file that is gone has its last known size and time. Paths do not repeat. With ``how="left"``
    only the files of ``current`` are judged, so none is gone.
    """
    now = current.select("path", F.struct("size", "modified").alias("now"))
    then = stored.select("path", F.struct("size", "modified").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    both = now.join(then, "path", how).withColumn("change", change).filter(F.col("change").isNotNull())
    return both.select("path", F.coalesce("now.size", "then.size").alias("size"), F.coalesce("now.modified", "then.modified").alias("modified"), "change")


def _read(spark: SparkSession, path: str, schema: str, versions: list[int]) -> DataFrame:
    return spark.read.option("basePath", path).schema(f"{schema}, version long").parquet(*(f"{path}/version={v}" for v in versions))


def _events(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last arrival of each path in the newest base, and all later arrivals and all sweeps; None while there are none."""
    base = max((v for v in numbered_folders(spark, f"{path}/base", "version") if before is None or v < before), default=-1)
    arrivals = numbered_folders(spark, f"{path}/arrivals", "version", base, before)
    sweeps = numbered_folders(spark, f"{path}/sweeps", "version")
    arrived, swept = F.lit(0).cast("long").alias("sweep"), (F.col("version") + 1).alias("sweep")
    columns = ("path", "size", "modified", "change", "after")
    found = []
    if base >= 0:
        found.append(_read(spark, f"{path}/base", f"{_CHANGES}, after long", [base]).select(*columns, arrived))
    if arrivals:
        found.append(_read(spark, f"{path}/arrivals", _CHANGES, arrivals).withColumnRenamed("version", "after").select(*columns, arrived))
    if sweeps:
        found.append(_read(spark, f"{path}/sweeps", f"{_CHANGES}, after long", sweeps).filter(F.lit(True) if before is None else F.col("after") < before).select(*columns, swept))
    return reduce(DataFrame.unionByName, found) if found else None


def _last(events: DataFrame) -> DataFrame:
    """The last event of every path."""
    last = F.max_by(F.struct("size", "modified", "change", "after"), F.struct("after", "sweep"))
    return events.groupBy("path").agg(last.alias("r")).select("path", "r.*")


def stored_listing(spark: SparkSession, path: str, before: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """The listing that all changes written below ``path`` add up to, or those before a micro-batch; empty before the first.

    A sweep comes after the micro-batch that it names, and before the next one. With ``among`` only its paths are looked up.
    """
    events = _events(spark, path, before)
    if events is None:
        return spark.createDataFrame([], "path string, size bigint, modified timestamp")
    if among is not None:
        events = events.join(among, "path", "left_semi")
    return _last(events).filter("change <> 'gone'").select("path", "size", "modified")


def _merge_arrivals(spark: SparkSession, path: str, version: int) -> None:
    """Write the last arrival of each path up to a version as a new base; the one before it is kept, older ones go."""
    bases = numbered_folders(spark, f"{path}/base", "version")
    arrivals = numbered_folders(spark, f"{path}/arrivals", "version", max(bases, default=-1), version + 1)
    events = _read(spark, f"{path}/arrivals", _CHANGES, arrivals).withColumnRenamed("version", "after")
    if bases:
        events = events.unionByName(_read(spark, f"{path}/base", f"{_CHANGES}, after long", bases[-1:]).drop("version"))
    last = _last(events.withColumn("sweep", F.lit(0)))
    last.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/base/version={version}")
    for old in bases[:-1]:
        remove(spark, f"{path}/base/version={old}")


def watch_files(spark: SparkSession, root: str, path: str, checkpoint: str, files_per_batch: int = 10_000) -> StreamingQuery:
    """Write arriving files as changes below ``path``, a version for each micro-batch.

    Files that the stored listing has with another size or time are changed, others are added. A stream
    only sees files that come: ``sweep`` finds those that changed in place or went. A micro-batch that runs
    again replaces its own version. Every twentieth merges the arrivals so far into a base, and the arriving paths are brought
    to the stored listing, so neither a micro-batch nor a reader goes through all versions.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        own, arrived = batch.sparkSession, _listing(batch)
        # A base that knows this version or a later one is from before a new run.
        for base in numbered_folders(own, f"{path}/base", "version", batch_id - 1):
            remove(own, f"{path}/base/version={base}")
        paths = arrived.select("path")
        stored = stored_listing(own, path, batch_id, F.broadcast(paths) if files_per_batch <= BROADCAST_FILES else paths)
        # Only arrivals are compared, so nothing is gone here. Not every task of the scan writes a file.
        changes = listing_changes(arrived, stored, "left").repartition(1 + files_per_batch // ROWS_PER_FILE)
        changes.write.mode("overwrite").parquet(f"{path}/arrivals/version={batch_id}")
        if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
            _merge_arrivals(own, path, batch_id)

    listed = _listing_session(spark)
    files = listed.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    return (
        files.select("path", "modificationTime", "length")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sweep(spark: SparkSession, root: str, path: str) -> int:
    """Compare the whole folder with the stored listing, write what differs, and return the number of the sweep."""
    last = max(numbered_folders(spark, f"{path}/arrivals", "version"), default=-1)
    number = max(numbered_folders(spark, f"{path}/sweeps", "version"), default=-1) + 1
    changes = listing_changes(scan_files(spark, root), stored_listing(spark, path))
    changes.withColumn("after", F.lit(last).cast("long")).write.mode("overwrite").parquet(f"{path}/sweeps/version={number}")
    return number
