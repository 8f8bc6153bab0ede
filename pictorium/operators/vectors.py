"""Vector operators: encoding, weighted phrases, cosine top-k, nearest reference, drift.

Vectors are keyed by ``photo_id`` (``ref_id``, ``query_id``); position never
matters. Queries and references are brought into the tasks only while they are
few (checked); beyond that both sides are cut into blocks that meet in a
cogroup, and the partial results are merged. No pairing of rows is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pictorium.functions import kernels
from pictorium.functions import text as T
from pictorium.session import scratch_path, ship_package

ENCODE_BATCH = 32  # fixed value: texts for each call of an encoder
MAX_BROADCAST_ROWS = 4_096
MAX_BROADCAST_BYTES = 64 << 20
QUERY_BLOCK = 2_048
CORPUS_BLOCK = 200_000
PAIR_BLOCK = (16_384, 32_768)  # queries and vectors that meet in one place, where all pairs are wanted


# ---------------------------------------------------------------- encoding


def hash_buckets(text: Column, dim: int) -> Column:
    """The bucket of every word: leading 32 bits of its md5, modulo ``dim``."""
    words = F.transform(T.words(text), F.lower)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))


def hash_embed(df: DataFrame, key: str, text_column: str, dim: int = 64) -> DataFrame:
    """Built-in encoder: word counts by hash bucket, scaled to unit length. ``key, embedding``.

    A text without words gets the zero vector.
    """
    ship_package(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("buckets")
            lengths = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(batch.num_rows), lengths) * dim + buckets.flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(cell, minlength=batch.num_rows * dim).reshape(batch.num_rows, dim)
            norm = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
            unit = counts / np.where(norm > 0, norm, 1.0)[:, None]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), vectors], names=[key, "embedding"])

    prepared = df.select(F.col(key).alias("key"), hash_buckets(F.col(text_column), dim).alias("buckets"))
    return prepared.mapInArrow(count, f"{key} {key_type}, embedding array<double>")


def embed_text(
    df: DataFrame,
    key: str = "photo_id",
    text_column: str = "description",
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    dim: int = 64,
    batch: int = ENCODE_BATCH,
) -> DataFrame:
    """``key, embedding`` with unit vectors from an injected encoder, or from the built-in one."""
    if encoder is None:
        return hash_embed(df, key, text_column, dim)
    ship_package(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                texts = [t or "" for t in part.column("text").to_pylist()]
                vectors = np.asarray(encoder(texts), dtype=np.float64)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(length > 0, length, 1.0)
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=[key, "embedding"])

    prepared = df.select(F.col(key).alias("key"), F.col(text_column).alias("text"))
    return prepared.mapInArrow(encode, f"{key} {key_type}, embedding array<double>")


def dot(left: Column, right: Column) -> Column:
    """Dot product of two vectors of one row, in double, summed in order."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def _weighted_sum(parts: DataFrame, *keys: str) -> DataFrame:
    """One vector for each key: the weighted sum of its parts, in phrase order."""
    ordered = F.array_sort(F.collect_list(F.struct("phrase_no", "weight", "embedding")))
    zero = F.transform(F.element_at("parts", 1)["embedding"], lambda x: F.lit(0.0))
    total = F.aggregate(
        "parts",
        zero,
        lambda acc, p: F.zip_with(acc, p["embedding"], lambda a, x: a + p["weight"] * x.cast("double")),
    )
    return parts.groupBy(*keys).agg(ordered.alias("parts"), F.min("phrase_no").alias("phrase_no")).select(
        *keys, "phrase_no", F.lit(1.0).alias("weight"), total.alias("embedding")
    )


def combine_phrases(phrases: DataFrame) -> DataFrame:
    """One vector for each query: the weighted sum of its phrase vectors, in phrase order.

    Scores are linear in the query vector, so one product per pair replaces one
    per phrase. Spans of phrases are summed first, so a query with very many
    phrases is not gathered in one place. Input: ``query_id, phrase_no, weight, embedding``.
    """
    parts = phrases.select("query_id", "phrase_no", "weight", "embedding")
    for bits in (10, 20):
        spans = parts.withColumn("span", F.shiftright(F.col("phrase_no").cast("long"), bits))
        parts = _weighted_sum(spans, "query_id", "span").drop("span")
    return _weighted_sum(parts, "query_id").select("query_id", "embedding")


# ---------------------------------------------------------------- scoring


def asking_side(vectors: DataFrame, cap: int) -> tuple[int, pa.Table | None]:
    """The common size of the vectors, and the table itself when it has at most ``cap`` rows and ``MAX_BROADCAST_BYTES``.

    Vectors of several sizes raise, however many rows there are. A small table
    is computed once: its sizes are checked where it has been brought.
    """
    ship_package(vectors.sparkSession)
    known = vectors.filter(F.col("embedding").isNotNull())
    few = known.limit(cap + 1).toArrow().combine_chunks() if cap else None
    if few is not None and few.num_rows <= cap:
        sizes = pc.min_max(pc.list_value_length(few.column("embedding"))).as_py()
        low, high = sizes["min"], sizes["max"]
        held = few if few.nbytes <= MAX_BROADCAST_BYTES else None
    else:
        sizes = known.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        low, high, held = sizes["low"], sizes["high"], None
    if low != high:
        raise ValueError(f"query vectors of several sizes: {low} to {high}")
    return low or 0, held


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim))


def single(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def topk_schema(query_id: str) -> str:
    return f"query_id {query_id}, photo_id long, semantic double, similarity double, phrase_matched boolean, word_matches int"


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _blocks(
    queries: DataFrame, corpus: DataFrame, corpus_key: Column, sizes: tuple[int, int] = (QUERY_BLOCK, CORPUS_BLOCK)
) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers ``qb, cb``; every query block meets every corpus block once."""
    n_q = max(1, math.ceil(queries.count() / sizes[0]))
    n_c = max(1, math.ceil(corpus.count() / sizes[1]))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn(
        "cb", F.explode(_numbers(n_c))
    )
    right = corpus.withColumn("cb", F.pmod(F.xxhash64(corpus_key), F.lit(n_c))).withColumn(
        "qb", F.explode(_numbers(n_q))
    )
    return left, right


def partial_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    min_score: float | None = None,
    rounded: bool = False,
    hits: DataFrame | None = None,
    evidence: Callable[[pa.Array], kernels.WordEvidence] | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Best ``k`` rows of every query in every part of the corpus; a superset of the final top-k.

    ``corpus`` has ``photo_id, embedding``. Word evidence comes in one of two
    forms: ``evidence`` (for the query ids in their order) together with the
    corpus columns ``terms``, ``phrases`` and maybe ``grammatical``; or, for
    query tables of any size, a table ``hits`` of ``photo_id, query_id, factor,
    phrase_matched, word_matches``.
    """
    queries = queries.select("query_id", "embedding")
    schema = topk_schema(queries.schema["query_id"].dataType.simpleString())
    dim, table = asking_side(queries, max_broadcast)
    corpus, queries = usable(corpus, dim), usable(queries, dim)

    if table is not None:
        query_ids, vectors = single(table, "query_id"), kernels.matrix(table.column("embedding"), dim)
        if hits is not None:
            corpus = corpus.join(_hits_by_photo(hits), "photo_id", "left")
        words = None if evidence is None else evidence(query_ids)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = kernels.TopK(vectors, k, min_score, rounded)
            for batch in batches:
                column = dict(zip(batch.schema.names, batch.columns))
                found, step = None, None
                if words is not None:
                    found = words.batch(column["terms"], column["phrases"], column.get("grammatical"))
                    step = words.chunk_rows()
                elif "hits" in column:
                    found = kernels.sparse_hits(column["hits"], query_ids)
                state.add(
                    column["photo_id"].to_numpy(zero_copy_only=False),
                    kernels.matrix(column["embedding"], dim),
                    found,
                    step,
                )
            yield state.result(query_ids)

        return corpus.mapInArrow(scan, schema)

    left, right = _blocks(queries, corpus, F.col("photo_id"))
    if hits is not None:
        n_q = max(1, math.ceil(queries.count() / QUERY_BLOCK))
        blocked = hits.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)))
        right = right.join(_hits_by_photo(blocked, "qb"), ["photo_id", "qb"], "left")

    def merge(query_part: pa.Table, corpus_part: pa.Table) -> pa.Table:
        ids = single(query_part, "query_id")
        state = kernels.TopK(kernels.matrix(query_part.column("embedding"), dim), k, min_score, rounded)
        if corpus_part.num_rows and query_part.num_rows:
            found = (
                kernels.sparse_hits(corpus_part.column("hits"), ids) if "hits" in corpus_part.column_names else None
            )
            state.add(
                corpus_part.column("photo_id").to_numpy(),
                kernels.matrix(corpus_part.column("embedding"), dim),
                found,
            )
        return pa.Table.from_batches([state.result(ids)])

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(merge, schema)


def _hits_by_photo(hits: DataFrame, *also: str) -> DataFrame:
    """One row for each photo; at most one hit for each query of a block."""
    packed = F.struct("query_id", "factor", "phrase_matched", "word_matches")
    return hits.groupBy("photo_id", *also).agg(F.collect_list(packed).alias("hits"))


def ranked(partial: DataFrame, k: int) -> DataFrame:
    """Final top ``k`` of each query with ``rank`` from 1; ties go to the smaller ``photo_id``."""
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("photo_id").asc())
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def same_model(vectors: DataFrame, model_name: str | None = None) -> DataFrame:
    """Vectors of one model: of the named one, or all of a table that has no more than one.

    Vectors of several models without a name raise; the names are aggregated
    when the plan is made.
    """
    if model_name is not None:
        return vectors.filter(F.col("model_name") == model_name)
    if "model_name" in vectors.columns:
        names = vectors.agg(F.min("model_name").alias("low"), F.max("model_name").alias("high")).first()
        if names["low"] != names["high"]:
            raise ValueError(f"vectors of several models ({names['low']}, {names['high']}): give model_name")
    return vectors


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    top_k: int = 20,
    threshold: float | None = 0.3,
    model_name: str | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``query_id, rank, photo_id, similarity``: best ``top_k`` first, the threshold afterwards.

    Vectors are unit vectors, so the dot product is the cosine. Only vectors of
    ``model_name`` are compared when it is given.
    """
    corpus = same_model(vectors, model_name).select("photo_id", "embedding")
    best = ranked(partial_topk(queries, corpus, top_k, max_broadcast=max_broadcast), top_k)
    if threshold is not None:
        best = best.filter(F.col("similarity") >= threshold)
    return best.select("query_id", "rank", "photo_id", "similarity")


def _computed_once(vectors: DataFrame) -> DataFrame:
    """Vectors that are counted and read, written to a scratch table so that texts are not encoded for both."""
    path = scratch_path(vectors.sparkSession, "block-vectors")
    vectors.write.parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)


def scores_above(
    queries: DataFrame, vectors: DataFrame, min_score: float, max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Every pair ``query_id, photo_id, score`` that reaches ``min_score``."""
    dim, table = asking_side(queries.select("query_id", "embedding"), max_broadcast)
    corpus = usable(vectors.select("photo_id", "embedding"), dim)
    queries = usable(queries.select("query_id", "embedding"), dim)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, photo_id long, score double"

    def found(ids: pa.Array, matrix: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        photo_ids, rows = batch.column("photo_id").to_numpy(zero_copy_only=False), kernels.matrix(batch.column("embedding"), dim)
        for q, photo, score in kernels.pairs_above(photo_ids, rows, matrix, min_score):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(q)), pa.array(photo), pa.array(score)], names=["query_id", "photo_id", "score"]
            )

    if table is not None:
        query_ids, matrix = single(table, "query_id"), kernels.matrix(table.column("embedding"), dim)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from found(query_ids, matrix, batch)

        return corpus.mapInArrow(scan, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each block, whose queries come first."""
        block, asked, known = None, [], None
        for batch in batches:
            blocks = list(zip(batch.column("qb").to_pylist(), batch.column("cb").to_pylist()))
            photo = batch.column("side").to_numpy()
            borders = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or photo[i] != photo[i - 1]), len(blocks)]
            for lo, hi in zip(borders, borders[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, asked, known = blocks[lo], [], None
                if not photo[lo]:
                    asked.append(part)
                elif asked:
                    if known is None:
                        whole = pa.Table.from_batches(asked)
                        known = single(whole, "query_id"), kernels.matrix(whole.column("embedding"), dim)
                    yield from found(*known, part)

    # Blocks come sorted and are read as they come: a task holds the queries of one block and a batch of vectors.
    left, right = _blocks(_computed_once(queries), _computed_once(corpus), F.col("photo_id"), PAIR_BLOCK)
    none = F.lit(None)
    left = left.select("qb", "cb", F.lit(0).alias("side"), "query_id", none.cast("long").alias("photo_id"), "embedding")
    right = right.select("qb", "cb", F.lit(1).alias("side"), none.cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("photo_id").cast("long"), "embedding")
    return left.unionByName(right).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "side").mapInArrow(merge, schema)


def multi_phrase_score(
    phrases: DataFrame, vectors: DataFrame, min_score: float = 0.0, max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Weighted phrase scores ``query_id, photo_id, score`` that reach ``min_score``."""
    return scores_above(combine_phrases(phrases), vectors, min_score, max_broadcast)


def nearest_reference(
    faces: DataFrame, refs: DataFrame, threshold: float = 0.4, max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """The closest reference of each face by cosine distance, the first one on ties.

    ``photo_id, face_no, ref_id, ref_name, distance, match_confidence, matched``:
    a row for every face. A face whose vector is null, zero or of another size
    than the references is near none: its reference and distance are null. A
    zero reference is near no face. No references at all raise.
    """
    dim, table = asking_side(refs.select("ref_id", "embedding"), max_broadcast)
    if not dim:
        raise ValueError("there are no reference faces")
    refs = usable(refs, dim).select("ref_id", "ref_name", "embedding")
    known = usable(faces, dim).select("photo_id", "face_no", "embedding")
    schema = "photo_id long, face_no int, ref_id long, distance double"

    def best(photo, face, rows: np.ndarray, numbers: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        ref, distance = kernels.nearest(rows, matrix, numbers)
        return pa.RecordBatch.from_arrays(
            [photo, face, pa.array(ref), pa.array(distance)], names=["photo_id", "face_no", "ref_id", "distance"]
        )

    if table is not None:
        table = table.sort_by("ref_id")
        numbers = table.column("ref_id").to_numpy()
        matrix = kernels.matrix(table.column("embedding"), dim)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(numbers):
                    rows = kernels.matrix(batch.column("embedding"), dim)
                    yield best(batch.column("photo_id"), batch.column("face_no"), rows, numbers, matrix)

        found = known.mapInArrow(scan, schema)
    else:
        keyed = refs.select(F.col("ref_id").alias("query_id"), "embedding")
        left, right = _blocks(keyed, known, F.struct("photo_id", "face_no"))

        def merge(ref_part: pa.Table, face_part: pa.Table) -> pa.Table:
            if not ref_part.num_rows or not face_part.num_rows:
                empty = pa.array([], pa.int64())
                return pa.table(
                    {"photo_id": empty, "face_no": pa.array([], pa.int32()), "ref_id": empty,
                     "distance": pa.array([], pa.float64())}
                )
            ref_part = ref_part.sort_by("query_id")
            batch = best(
                single(face_part, "photo_id"), single(face_part, "face_no"),
                kernels.matrix(face_part.column("embedding"), dim),
                ref_part.column("query_id").to_numpy(), kernels.matrix(ref_part.column("embedding"), dim),
            )
            return pa.Table.from_batches([batch])

        parts = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(merge, schema)
        found = (
            parts.groupBy("photo_id", "face_no")
            .agg(F.min(F.struct("distance", "ref_id")).alias("near"))
            .select("photo_id", "face_no", "near.ref_id", "near.distance")
        )

    far = F.lit(float("inf"))
    found = found.withColumns({
        "ref_id": F.when(F.col("distance") < far, F.col("ref_id")), "distance": F.when(F.col("distance") < far, F.col("distance")),
    })
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    apart = faces.filter(F.col("embedding").isNull() | (size != dim)).select(
        F.col("photo_id").cast("long"), F.col("face_no").cast("int"), F.lit(None).cast("long").alias("ref_id"),
        F.lit(None).cast("double").alias("distance"),
    )
    names = refs.select(F.col("ref_id").alias("named"), "ref_name")
    if table is not None:
        names = F.broadcast(names)  # no more rows than were just brought into the tasks
    # Faces near no reference are dealt out by their own key, not under one null.
    key = F.coalesce("ref_id", F.xxhash64("photo_id", "face_no"))
    return found.unionByName(apart).join(names, (key == F.col("named")) & F.col("ref_id").isNotNull(), "left").select(
        "photo_id", "face_no", "ref_id", "ref_name", "distance",
        (1.0 - F.col("distance") / 2.0).alias("match_confidence"),
        F.coalesce(F.col("distance") < threshold, F.lit(False)).alias("matched"),
    )


# ---------------------------------------------------------------- stored vectors


def embedding_metadata(vectors: DataFrame) -> DataFrame:
    """``model_name, num_embeddings, embedding_dim, normalized`` for each model."""
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.groupBy("model_name").agg(
        F.count("*").alias("num_embeddings"),
        F.max(F.size("embedding")).alias("embedding_dim"),
        F.bool_and(F.abs(length - 1.0) < 1e-3).alias("normalized"),
    )


def attach_embeddings(library: DataFrame, vectors: DataFrame, model_name: str | None = None) -> DataFrame:
    """Library rows with the vector of their id."""
    wanted = same_model(vectors, model_name).select("photo_id", "embedding")
    return library.join(wanted, "photo_id")


def alignment_audit(library: DataFrame, vectors: DataFrame, model_name: str | None = None) -> DataFrame:
    """How photos and vectors meet: ``status`` (matched, no_embedding, no_photo) and ``n``."""
    left = library.select("photo_id", F.lit(True).alias("has_photo"))
    right = same_model(vectors, model_name).select("photo_id", F.lit(True).alias("has_vector"))
    status = (
        F.when(F.col("has_vector").isNull(), "no_embedding")
        .when(F.col("has_photo").isNull(), "no_photo")
        .otherwise("matched")
    )
    return left.join(right, "photo_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _similarities(library: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    pair = (
        stored.select("photo_id", F.col("embedding").alias("stored"))
        .join(fresh.select("photo_id", F.col("embedding").alias("fresh")), "photo_id")
        .select("photo_id", dot(F.col("stored"), F.col("fresh")).alias("similarity"))
    )
    return library.select("photo_id", "filename").join(pair, "photo_id", "left")


def embedding_drift(
    library: DataFrame, stored: DataFrame, fresh: DataFrame, threshold: float = 0.90, model_name: str | None = None
) -> DataFrame:
    """Photos whose stored vector is missing or far from a fresh one.

    ``photo_id, filename, similarity, status``; a missing vector counts as 0.
    """
    compared = _similarities(library, same_model(stored, model_name), fresh)
    return compared.filter(F.col("similarity").isNull() | (F.col("similarity") < threshold)).select(
        "photo_id",
        "filename",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(F.col("similarity").isNull(), "NO_EMBEDDING").otherwise("MISMATCH").alias("status"),
    )


def verify_sample(
    stored: DataFrame, fresh: DataFrame, sample_size: int = 50, tolerance: float = 0.999, seed: int = 0,
    model_name: str | None = None,
) -> DataFrame:
    """A reproducible random sample of ids with their similarity and whether it is near enough."""
    order = F.md5(F.concat(F.col("photo_id").cast("string"), F.lit(f"#{seed}")))
    sample = same_model(stored, model_name).select("photo_id", "embedding").orderBy(order, "photo_id").limit(sample_size)
    return sample.join(fresh.select("photo_id", F.col("embedding").alias("fresh")), "photo_id").select(
        "photo_id",
        dot(F.col("embedding"), F.col("fresh")).alias("similarity"),
        (dot(F.col("embedding"), F.col("fresh")) >= tolerance).alias("verified"),
    )


def repair_embeddings(
    library: DataFrame,
    stored: DataFrame,
    fresh: DataFrame,
    path: str,
    model_name: str,
    threshold: float = 0.90,
    sample_size: int = 50,
    tolerance: float = 0.999,
) -> DataFrame:
    """Write fresh vectors for every photo to the new ``path`` when stored ones have drifted.

    The written copy is read back and a sample is verified before the metadata
    row says ``repaired``; the stored vectors stay as they are, as the backup.
    Only stored vectors of ``model_name`` count. ``fresh`` is read several times:
    give a stored table, or use ``encodings.repair_library``, so that texts are encoded once.
    Returns ``model_name, num_embeddings, embedding_dim, normalized, repaired, previous_mismatches``.
    """
    spark = library.sparkSession
    # Vectors of another model are none of this one.
    known = stored.filter(F.col("model_name") == model_name) if "model_name" in stored.columns else stored
    mismatches = embedding_drift(library, known, fresh, threshold).count()
    if not mismatches:
        current = embedding_metadata(known)
        return current.withColumns({"repaired": F.lit(False), "previous_mismatches": F.lit(0).cast("long")})
    wanted = fresh.join(library.select("photo_id"), "photo_id", "left_semi")
    wanted.select("photo_id", F.lit(model_name).alias("model_name"), "embedding").write.parquet(path)
    written = spark.read.parquet(path)
    failed = verify_sample(written, wanted, sample_size, tolerance).filter(~F.col("verified")).count()
    if failed:
        raise ValueError(f"{failed} sampled vectors differ from their texts; {path} must not be used")
    return embedding_metadata(written).withColumns(
        {"repaired": F.lit(True), "previous_mismatches": F.lit(mismatches).cast("long")}
    )
