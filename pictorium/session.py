"""Session helpers: defaults for tests, the shared scratch folder, size checks."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def local_session(cores: int = 8, name: str = "pictorium") -> SparkSession:
    """A single-JVM session for tests and for the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PICTORIUM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once for each application.

    The driver hands the sources to Spark, which gives them to every executor;
    it does nothing that ``--py-files`` would not do.
    """
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        name = os.path.basename(root)
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name), "zip", os.path.dirname(root), name
        )
        context.addPyFile(archive)
    _SHIPPED["application"] = context.applicationId


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: what the cluster names, or a temporary one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="pictorium-")
    return _LOCAL["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/pictorium/{label}-{uuid.uuid4().hex}"


def stored(table: DataFrame, label: str) -> DataFrame:
    """The table written to the scratch folder and read back: it is computed once, and the planner knows its size."""
    path = scratch_path(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def rows_within(df: DataFrame, cap: int) -> list[Row] | None:
    """The rows of a small table, or None when it has more than ``cap`` rows.

    Never brings more than ``cap + 1`` rows to the driver.
    """
    rows = df.limit(cap + 1).collect()
    return rows if len(rows) <= cap else None


# Splits of the largest size that a spread may move, on any cluster.
SPREAD_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Give each core a partition of a scan of few small files, whose rows else lie in a task for each row group.

    Splits of one row group but the one with its middle are empty, so partitions
    of the scan say nothing; files and bytes do. Only fewer files than half the
    cores, with at most ``SPREAD_SPLITS`` times ``spark.sql.files.maxPartitionBytes``,
    are moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or 2 * len(files) > cores:
        return df
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in (path(f) for f in files))
    return df.repartition(cores) if size <= SPREAD_SPLITS * split_bytes(spark) else df


def split_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
