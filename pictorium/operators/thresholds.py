"""Hybrid search by a threshold algorithm: word evidence only where it can still matter.

The lexical factor of a row is at most ``ranking.BOOST``, so a semantic score
bounds the final one. First the best rows by semantic score alone are given
their factors; the ``k``-th best of them is a score that the answer reaches for certain. A
row whose semantic score times the largest factor stays below it cannot enter, and its text is
never looked at. The rows are those of ``hybrid.hybrid_search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions import kernels
from pictorium.functions import ranking as R
from pictorium.operators import hybrid as H
from pictorium.operators import vectors as V
from pictorium.operators.catalog import flag_filter
from pictorium.session import ship_package

# Rows by semantic score, as a multiple of the wanted ones, whose texts give the first threshold.
FIRST = 4
# Rounding of final scores to four decimals, and far above the error of products.
SLACK = 1.01e-4


@dataclass
class Search:
    """Found rows, and the photos whose texts were looked at for the answer: a table ``photo_id``."""

    rows: DataFrame
    read: DataFrame


def _candidates(stored: DataFrame, ids: pa.Array, asked: np.ndarray, least: np.ndarray) -> DataFrame:
    """``photo_id`` of rows whose score for some query reaches that query's least semantic score."""
    ship_package(stored.sparkSession)
    dim = asked.shape[1]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, kernels.MAX_CELLS // max(1, len(asked)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                scores = kernels.matrix(part.column("embedding"), dim) @ asked.T
                kept = np.flatnonzero((scores >= least[None, :]).any(1))
                if len(kept):
                    yield pa.RecordBatch.from_arrays([part.column("photo_id").take(pa.array(kept))], ["photo_id"])

    return V.usable(stored, dim).mapInArrow(choose, "photo_id long")


def hybrid_search(
    queries: DataFrame, phrases: DataFrame | None, library: DataFrame, vectors: DataFrame, pairs: DataFrame | None = None, top_k: int = 50,
    min_score: float | None = 0.0, has_characters: bool | None = None, has_dogs: bool | None = None, has_cars: bool | None = None,
    encoder=None, dim: int = 64, max_queries: int = H.MAX_KNOWN_QUERIES, model_name: str | None = None,
) -> Search:
    """The rows of ``hybrid.hybrid_search`` with the same arguments, and the photos that were read for them.

    A query table beyond the bounds of ``max_queries``, or query vectors beyond those of
    ``vectors.asking_side``, are searched without a threshold and read every photo.
    """
    queries = queries.filter(F.col("query").isNotNull())
    if phrases is not None:
        queries = queries.join(phrases.select("query_id").distinct(), "query_id", "left_semi")
        phrases = phrases.join(queries.select("query_id"), "query_id", "left_semi")
    options = dict(has_characters=has_characters, has_dogs=has_dogs, has_cars=has_cars)
    wanted = flag_filter(library, **options)
    stored = V.same_model(vectors, model_name).select("photo_id", "embedding").join(wanted.select("photo_id"), "photo_id", "left_semi")
    known = H._KnownQueries.within_bounds(H._asked(queries), max_queries)
    size, table = V.asking_side(H.query_vectors(H.whole_query_phrases(queries) if phrases is None else phrases, encoder, dim), max_queries)
    if known is None or table is None:
        found = H.hybrid_search(queries, phrases, library, vectors, pairs, top_k, min_score, encoder=encoder, dim=dim, max_queries=max_queries, model_name=model_name, **options)
        return Search(found, wanted.select("photo_id"))
    # Encoded once: from here on the query vectors are a constant table.
    asked = queries.sparkSession.createDataFrame(table.to_pylist(), f"query_id {queries.schema['query_id'].dataType.simpleString()}, embedding array<double>")
    ids, matrix = V.single(table, "query_id"), kernels.matrix(table.column("embedding"), size)

    def best(photos: DataFrame) -> DataFrame:
        texts = wanted.join(photos, "photo_id", "left_semi")
        corpus = known.photo_evidence(texts, pairs).join(stored, "photo_id")
        return V.ranked(V.partial_topk(asked, corpus, top_k, min_score, rounded=True, evidence=known.evidence, max_broadcast=max_queries), top_k)

    # Bounded by queries x FIRST x top_k.
    first = V.ranked(V.partial_topk(asked, stored, FIRST * top_k, min_score, max_broadcast=max_queries), FIRST * top_k).select("photo_id").distinct()
    reached = {r["query_id"]: r["similarity"] for r in best(first).filter(F.col("rank") == top_k).select("query_id", "similarity").collect()}
    floor = -np.inf if min_score is None else min_score - kernels.SLACK
    # A negative score is larger times a smaller factor, so nothing is skipped below it.
    least = np.array([max(floor, (t - SLACK) / R.BOOST if (t := reached.get(i, -np.inf)) > SLACK else -np.inf) for i in ids.to_pylist()])
    read = _candidates(stored, ids, matrix, least)
    flags = [c for c in H.FLAGS if c in library.columns]
    rows = best(read).join(library.select("photo_id", "filename", "description", *flags), "photo_id").select(
        "query_id", "rank", "photo_id", "filename", "description", "similarity",
        F.round("semantic", 4).alias("semantic_score"), "phrase_matched", "word_matches", *flags,
    )
    return Search(rows, read)
