"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pictorium.llm import common

# Links for which a round takes another task.
LINKS_A_TASK = 10_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around the smallest node of each part that the batch connects."""
    for batch in batches:
        up: dict[int, int] = {}

        def top(n: int) -> int:
            root = n
            while (above := up.get(root, root)) != root:
                root = above
            while n != root:
                up[n], n = root, up.get(n, n)
            return root

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], schema=_EDGES)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _settled(edges: DataFrame) -> tuple[bool, int]:
    """Whether the links are stars around nodes that are linked to no smaller one, and how many links there are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    links, left = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()
    return not left, links or 0


def stars(edges: DataFrame) -> DataFrame:
    """Links ``u, v`` from every node of the undirected edges ``u, v`` but the smallest of each component to that one.

    Each round replaces links by links to smaller nodes, so chains shrink in
    logarithmically many rounds, and every round is one stored table, in as many
    files as its links need. A node with very many links is no group: minima are
    aggregated and joined back.
    """
    edges = common.store(common.map_batches(edges.filter("u <> v"), _forest, "u long, v long"), "links")
    made = [common.scratch_tables(edges.sparkSession)[-1]]
    while True:
        settled, links = _settled(edges)
        if settled:
            return edges
        # A round has no more links than the one before it, but one for each node at most.
        edges = common.store(common.narrowed(_small(_large(edges)).distinct(), links, LINKS_A_TASK), "links")
        made.append(common.scratch_tables(edges.sparkSession)[-1])
        common.release(edges.sparkSession, made[:-1])
        made = made[-1:]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the undirected edges ``u, v``: the smallest node that it reaches."""
    edges = stars(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
