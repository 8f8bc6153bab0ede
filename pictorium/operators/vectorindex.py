"""Exact cosine top-k through a metric index: lists of vectors around centroids, skipped by the triangle inequality.

Centroids are fitted on a bounded sample; they only decide how much is skipped.
Every vector is in the list of its nearest centroid, and each list knows the
angles between its vectors and the centroid. Angles obey the triangle inequality,
so the angle between a query and a centroid bounds the best score in the list.
A search reads the most promising lists of a query until they hold ``k`` vectors, takes
the ``k``-th best score there, and then reads exactly the lists whose bound reaches it:
the rows are those of comparing everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import kernels
from pictorium.operators import vectors as V
from pictorium.session import ship_package

# Vectors that centroids are fitted on: the first by the hash of their id. Every vector is indexed, whatever the sample.
SAMPLE_ROWS = 10_000
MAX_LISTS = 1_024
ROUNDS = 8
# Radians and score units, far above the rounding errors of angles near zero and of products.
ANGLE_SLACK = 1e-6


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = kernels.norms(rows)
    return rows / np.where(length > 0, length, 1.0)[:, None], length


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means; the same for the same sample."""
    unit, _ = _unit(sample)
    centroids = unit[np.linspace(0, len(unit) - 1, lists).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        found, length = _unit(sums)
        centroids = np.where(length[:, None] > 0, found, centroids)
    return centroids


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Write an index of ``photo_id, embedding`` rows below a new path.

    ``lists`` is the square root of the number of vectors unless given, at most
    ``MAX_LISTS``. Null vectors are left out; vectors of several sizes raise. An
    index of no vectors finds nothing. Lists are parts of a Parquet table, so a
    search opens only the folders of those it reads; a list with most of the
    vectors is written, and read, by many tasks.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("photo_id").cast("long").alias("photo_id"), "embedding")
    size = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count("*").alias("n")).first()
    if size["low"] != size["high"]:
        raise ValueError(f"vectors of several sizes: {size['low']} to {size['high']}")
    dim = size["low"] or 0
    sample = rows.orderBy(F.xxhash64("photo_id"), "photo_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    wanted = lists or math.isqrt(size["n"])
    centroids = fit_centroids(kernels.matrix(sample.column("embedding"), dim), max(1, min(wanted, MAX_LISTS, len(sample)))) if len(sample) else np.zeros((0, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, length = _unit(kernels.matrix(batch.column("embedding"), dim))
            scores = unit @ centroids.T
            nearest = scores.argmax(1)
            angle = np.arccos(np.clip(scores[np.arange(len(unit)), nearest], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("photo_id"), batch.column("embedding"), pa.array(nearest.astype(np.int32)), pa.array(angle), pa.array(length)],
                names=["photo_id", "embedding", "list", "angle", "length"],
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"photo_id long, embedding {kind}, list int, angle double, length double")
    placed = assigned.repartitionByRange("list", F.xxhash64("photo_id"))
    placed.write.mode("errorifexists").partitionBy("list").parquet(f"{path}/vectors")
    stored = _stored(rows.sparkSession, path, kind)
    of_list = stored.groupBy("list").agg(
        F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.min("length").alias("short"), F.max("length").alias("long"),
    )
    known = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    of_list.join(known, "list").coalesce(1).write.mode("errorifexists").parquet(f"{path}/lists")


def _stored(spark: SparkSession, path: str, kind: str = "array<float>") -> DataFrame:
    return spark.read.schema(f"photo_id long, embedding {kind}, angle double, length double, list int").parquet(f"{path}/vectors")


@dataclass
class Lists:
    """The lists of an index, at most ``MAX_LISTS`` rows."""

    number: np.ndarray
    n: np.ndarray
    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and list a score that no vector of the list exceeds."""
        unit, length = _unit(queries)
        angle = np.arccos(np.clip(unit @ self.centroids.T, -1.0, 1.0))
        least = np.maximum(np.maximum(angle - self.far, self.near - angle) - ANGLE_SLACK, 0.0)
        cosine = np.cos(np.minimum(least, np.pi))
        return length[:, None] * np.maximum(cosine * self.long, cosine * self.short) + ANGLE_SLACK * (1 + length[:, None] * self.long)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """For each query the lists with the best bounds that together hold ``k`` vectors."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, before < k, 1)
        return chosen


def read_lists(spark: SparkSession, path: str) -> Lists:
    table = spark.read.parquet(f"{path}/lists").toArrow().sort_by("list")
    dim = len(table.column("centroid")[0]) if len(table) else 0
    value = lambda c: table.column(c).to_numpy()
    return Lists(value("list"), value("n"), kernels.matrix(table.column("centroid"), dim), *(value(c) for c in ("near", "far", "short", "long")))


@dataclass
class Search:
    """Found rows, and the share of all pairs of query and vector whose score was computed for the final answer."""

    rows: DataFrame
    share: float


def _reached(partial: DataFrame, k: int) -> DataFrame:
    """``query_id, reached``: the ``k``-th best score found so far; nothing for queries with fewer rows."""
    return V.ranked(partial, k).filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("reached"))


def search(queries: DataFrame, spark: SparkSession, path: str, top_k: int = 20, threshold: float | None = 0.3, max_broadcast: int = V.MAX_BROADCAST_ROWS) -> Search:
    """``query_id, rank, photo_id, similarity``, the same rows as ``vectors.cosine_topk``.

    While the queries are few (checked by rows and bytes), the tasks know them and every task scans
    the chosen lists where they lie. Beyond that, queries and blocks of the lists meet in a cogroup.
    Query ids must not repeat; null vectors and vectors of another size find nothing.
    """
    lists = read_lists(spark, path)
    dim, table = V.asking_side(queries.select("query_id", "embedding"), max_broadcast)
    index = _stored(spark, path, spark.read.parquet(f"{path}/vectors").schema["embedding"].dataType.simpleString()) if len(lists.n) else None
    total = int(lists.n.sum())
    if index is None or not total or dim != lists.centroids.shape[1]:
        empty = V.usable(queries, -1).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("photo_id"), F.lit(0.0).alias("similarity"))
        return Search(empty, 0.0)
    floor = -np.inf if threshold is None else threshold - ANGLE_SLACK
    if table is not None:
        ids, asked = V.single(table, "query_id"), kernels.matrix(table.column("embedding"), dim)
        bounds = lists.bounds(asked)
        reached = {r["query_id"]: r["reached"] for r in _reached(_scan(index, lists, ids, asked, lists.first(bounds, top_k), top_k), top_k).collect()}
        least = np.array([max(reached.get(i, -np.inf), floor) for i in ids.to_pylist()])
        wanted = bounds >= least[:, None] if len(least) else np.zeros((0, len(lists.n)), bool)
        partial = _scan(index, lists, ids, asked, wanted, top_k)
        share = float((wanted * lists.n).sum()) / max(1, total * len(least))
    else:
        known = V.usable(queries.select("query_id", "embedding"), dim)
        first = _meet(index, lists, _chosen(known.withColumn("reached", F.lit(None).cast("double")), lists, top_k, floor), top_k)
        best = known.join(_reached(first, top_k), "query_id", "left")
        wanted = _chosen(best.withColumn("reached", F.coalesce("reached", F.lit(-math.inf))), lists, top_k, floor)
        partial = _meet(index, lists, wanted, top_k)
        pairs = wanted.join(F.broadcast(_sizes(spark, lists)), "list").agg(F.sum("n")).first()[0] or 0
        share = pairs / max(1, total * known.count())
    found = V.ranked(partial, top_k)
    if threshold is not None:
        found = found.filter(F.col("similarity") >= threshold)
    return Search(found.select("query_id", "rank", "photo_id", "similarity"), share)


def _sizes(spark: SparkSession, lists: Lists) -> DataFrame:
    return spark.createDataFrame([(int(i), int(n)) for i, n in zip(lists.number, lists.n)], "list int, n long")


def _scan(index: DataFrame, lists: Lists, ids: pa.Array, asked: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """Best ``k`` rows of each query in each task that reads one of its lists; other lists are not opened."""
    of_list = {int(lists.number[j]): np.flatnonzero(wanted[:, j]) for j in np.flatnonzero(wanted.any(0))}
    dim = asked.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, kernels.TopK] = {}
        for batch in batches:
            of_row = batch.column("list").to_numpy()
            photos, rows = batch.column("photo_id").to_numpy(), kernels.matrix(batch.column("embedding"), dim)
            for number in np.unique(of_row).tolist():
                state = states.setdefault(number, kernels.TopK(asked[of_list[number]], k, None, False))
                here = of_row == number
                state.add(photos[here], rows[here])
        for number, state in states.items():
            yield state.result(ids.take(pa.array(of_list[number])))

    chosen = index.filter(F.col("list").isin([*of_list])).select("photo_id", "embedding", "list")
    return chosen.mapInArrow(scan, V.topk_schema(pa_kind(ids)))


def pa_kind(ids: pa.Array) -> str:
    return {"int32": "int", "int64": "bigint", "string": "string", "large_string": "string"}[str(ids.type)]


def _chosen(queries: DataFrame, lists: Lists, k: int, floor: float) -> DataFrame:
    """``query_id, embedding, list``: the first lists of queries with null ``reached``, else all that may hold a better row."""
    dim = lists.centroids.shape[1]
    kind = queries.schema["query_id"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                bounds = lists.bounds(kernels.matrix(part.column("embedding"), dim))
                reached = part.column("reached").to_pylist()
                begun = np.array([r is None for r in reached], bool)
                least = np.array([floor if r is None else max(r, floor) for r in reached])
                q, j = np.nonzero(np.where(begun[:, None], lists.first(bounds, k), bounds >= least[:, None]))
                rows = part.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("embedding"), pa.array(lists.number[j].astype(np.int32))], names=["query_id", "embedding", "list"])

    embedding = queries.schema["embedding"].dataType.simpleString()
    return queries.select("query_id", "embedding", "reached").mapInArrow(choose, f"query_id {kind}, embedding {embedding}, list int")


def _meet(index: DataFrame, lists: Lists, chosen: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of each query in each block of its lists; blocks of both sides are bounded."""
    spark, dim = index.sparkSession, lists.centroids.shape[1]
    blocks = spark.createDataFrame(
        [(int(i), -(-int(n) // V.CORPUS_BLOCK)) for i, n in zip(lists.number, lists.n)], "list int, blocks long"
    )
    parts = chosen.groupBy("list").agg(F.ceil(F.count("*") / V.QUERY_BLOCK).alias("parts"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    # A row for each list: bounded by MAX_LISTS.
    layout = blocks.join(parts, "list")
    left = chosen.join(F.broadcast(layout), "list").select("query_id", "embedding", "list", F.pmod(F.xxhash64("query_id"), "parts").alias("qb"), numbers("blocks").alias("cb"))
    other = layout.select("list", F.col("blocks").alias("n_blocks"), F.col("parts").alias("n_parts"))
    right = index.select("photo_id", "embedding", "list").join(F.broadcast(other), "list")
    right = right.select("photo_id", "embedding", "list", F.pmod(F.xxhash64("photo_id"), "n_blocks").alias("cb"), numbers("n_parts").alias("qb"))

    def merge(query_part: pa.Table, corpus_part: pa.Table) -> pa.Table:
        ids = V.single(query_part, "query_id")
        state = kernels.TopK(kernels.matrix(query_part.column("embedding"), dim), k, None, False)
        if corpus_part.num_rows and query_part.num_rows:
            state.add(corpus_part.column("photo_id").to_numpy(), kernels.matrix(corpus_part.column("embedding"), dim))
        return pa.Table.from_batches([state.result(ids)])

    keys = ("list", "qb", "cb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(merge, V.topk_schema(chosen.schema["query_id"].dataType.simpleString()))
