"""Search-quality monitoring over an arriving log.

Both monitors keep running state and write, for each micro-batch, only the rows
that it changed (update mode). A reader takes the last row of each key; now and
then a micro-batch merges all earlier changes into one base, so neither a batch
nor a reader goes through the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pictorium.operators.querylog import MIN_OCCURRENCES, SCORE_THRESHOLD
from pictorium.sources.folders import numbered_folders

LOG_SCHEMA = "seq bigint, logged_at timestamp_ntz, query string, expanded_query string, top_score double"
# Micro-batches after which changes are merged into a new base.
MERGE_EVERY = 20


def running_stats(log: DataFrame) -> DataFrame:
    """State of each query: count, score sum, first entry. Works on batches and on streams."""
    return log.groupBy("query").agg(
        F.count("*").alias("count"),
        F.sum("top_score").alias("score_sum"),
        F.min_by(F.col("expanded_query").isNotNull(), "seq").alias("has_expansion"),
        F.min("seq").alias("first_seq"),
    )


def report(
    stats: DataFrame, min_occurrences: int = MIN_OCCURRENCES, score_threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """The problem report from the state."""
    average = F.col("score_sum") / F.col("count")
    bad = stats.filter((F.col("count") >= min_occurrences) & (average < score_threshold))
    return bad.select(
        "query", "count", F.round(average, 4).alias("avg_top_score"), "has_expansion", "first_seq"
    )


def _last_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a key that of the highest version."""
    others = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("r")).select(*keys, *(f"r.{c}" for c in others))


def _history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last base and the changes after it, with their versions; None while there are none."""
    known = [v for v in numbered_folders(spark, f"{path}/changes", "version") if before is None or v < before]
    bases = [v for v in numbered_folders(spark, f"{path}/base", "version") if before is None or v < before]
    base = max(bases, default=-1)
    folders = [(f"{path}/changes/version={v}", v) for v in known if v > base] + [(f"{path}/base/version={base}", base)] * (base >= 0)
    if not folders:
        return None
    tables = [spark.read.parquet(f).withColumn("version", F.lit(v).cast("long")) for f, v in folders]
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found


def _write_changes(path: str, keys: list[str], merge_every: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/version={batch_id}")
        if batch_id % merge_every == merge_every - 1:
            _last_rows(_history(spark, path), keys).write.mode("overwrite").parquet(f"{path}/base/version={batch_id}")

    return write


def _run(stats: DataFrame, path: str, keys: list[str], checkpoint: str, merge_every: int) -> StreamingQuery:
    return (
        stats.writeStream.outputMode("update")
        .foreachBatch(_write_changes(path, keys, merge_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _arriving(spark: SparkSession, incoming: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)


def query_log_monitor(
    spark: SparkSession, incoming: str, path: str, checkpoint: str, files_per_batch: int = 1_000, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Keep the state of every query over arriving log files below ``path``.

    A micro-batch writes the queries that it changed, and replaces its own folder when it runs again.
    """
    return _run(running_stats(_arriving(spark, incoming, files_per_batch)), path, ["query"], checkpoint, merge_every)


def latest_snapshot(spark: SparkSession, path: str, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """The state as of the last micro-batch: the last row of every key."""
    history = _history(spark, path)
    if history is None:
        raise ValueError(f"no micro-batch has been written to {path}")
    return _last_rows(history, list(keys))


WINDOW_KEYS = ("start", "end", "query")


def windowed_quality(log: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Searches and mean score for each query and time window; rows later than ``lateness`` are dropped."""
    timed = log.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window).alias("window"), "query").agg(
        F.count("*").alias("searches"), F.avg("top_score").alias("avg_top_score")
    ).select("window.start", "window.end", "query", "searches", "avg_top_score")


def windowed_monitor(
    spark: SparkSession, incoming: str, path: str, checkpoint: str, window: str = "1 hour", lateness: str = "2 hours",
    files_per_batch: int = 1_000, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Keep the windows of ``windowed_quality`` over arriving log files; ``latest_snapshot`` with ``WINDOW_KEYS`` reads them.

    State is held for windows within ``lateness`` of the latest row seen and then dropped; what arrives for
    them afterwards is late and not counted, also after a restart from the same checkpoint.
    """
    stats = windowed_quality(_arriving(spark, incoming, files_per_batch), window, lateness)
    return _run(stats, path, list(WINDOW_KEYS), checkpoint, merge_every)
