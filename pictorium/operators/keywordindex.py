"""Stored positional index for keyword search: matches are decided on word positions, texts are read for hits only.

Below a path stand, for each version that was added, the postings ``word,
photo_id, steps`` in buckets of the word, and the words with their number of
photos. ``steps`` are positions as differences, the first one from 0. A search looks its
keywords up among the words, starts each AND group from its rarest keyword, and
meets the postings of the others by keyword and photo; so a common word is
read but never multiplied. Distances are judged on sorted positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import keywords as K
from pictorium.functions import text as T
from pictorium.operators import keyword as KW
from pictorium.session import ship_package, stored
from pictorium.sources.folders import numbered_folders

BUCKETS = 64
SLICE_WORDS = 1 << 20  # words that a task sorts at once, unless one text has more


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


_LISTED = pa.schema([("word", pa.string()), ("photo_id", pa.int64()), ("steps", pa.list_(pa.int32()))])


def _listed(ids: pa.Array, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    """``word, photo_id, steps`` of a few texts, from their words in order."""
    coded = words.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(zero_copy_only=False)
    # A stable order keeps the positions of a word in a text ascending.
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    again = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    steps = at - np.where(again, np.roll(at, 1), 0)
    first = np.flatnonzero(~again)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(steps, pa.int32()))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key[first] % kinds)), ids.take(pa.array(key[first] // kinds)), lists], schema=_LISTED)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of ``photo_id, lowered`` rows, a bounded number of words at once."""
    for batch in batches:
        ids, lowered = batch.column("photo_id"), batch.column("lowered")
        ends, first = lowered.offsets.to_numpy(), 0
        while first < len(lowered):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_WORDS, "right")) - 1)
            words = lowered.values.slice(ends[first], ends[last] - ends[first])
            yield _listed(ids.slice(first, last - first), words, np.diff(ends[first : last + 1]))
            first = last


def _positions(steps: Column) -> Column:
    """Sums of steps; long lists are summed in spans, so that no array is copied for each of its elements."""
    span = 64
    spans = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / span).cast("int")), lambda k: F.slice(steps, k * span + 1, span))
    summed = lambda values, first: F.slice(F.aggregate(
        values, F.array(first), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v)
    ), 2, F.size(values))
    starts = F.aggregate(spans, F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(s, F.lit(0), lambda a, v: a + v)))
    return F.flatten(F.transform(spans, lambda s, k: summed(s, F.get(starts, k))))


def add(library: DataFrame, path: str) -> int:
    """Index ``photo_id, description`` rows as a new version; returns its number. Ids of earlier versions must not come again."""
    spark = library.sparkSession
    number = max(numbered_folders(spark, f"{path}/words", "version"), default=-1) + 1
    ship_package(spark)
    # Positions of a word in a photo are bounded by its text.
    tokens = library.filter(F.col("description").isNotNull()).select(F.col("photo_id").cast("long"), K.lower_all(T.words(F.col("description"))).alias("lowered"))
    postings = tokens.mapInArrow(_postings, "word string, photo_id long, steps array<int>").withColumn("bucket", _bucket(F.col("word")))
    # A word of most photos is written by many tasks.
    spread = postings.repartition("bucket", F.pmod(F.xxhash64("photo_id"), F.lit(8)))
    spread.sortWithinPartitions("bucket", "word", "photo_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/version={number}")
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/version={number}")
    stored.groupBy("word").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/words/version={number}")
    return number


_POSTINGS = "word string, photo_id long, steps array<int>, bucket int"


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and words of all finished versions."""
    versions = numbered_folders(spark, f"{path}/words", "version")
    if not versions:
        return spark.createDataFrame([], _POSTINGS), spark.createDataFrame([], "word string, n long")
    read = lambda name, schema: spark.read.option("basePath", f"{path}/{name}").schema(schema).parquet(*(f"{path}/{name}/version={v}" for v in versions))
    return read("postings", f"{_POSTINGS}, version long"), read("words", "word string, n long, version long")


def _near_pair(one: Column, other: Column, distance: Column) -> Column:
    """Some position of one is at most ``distance`` from some position of the other: neighbours in the merged order tell."""
    tagged = lambda c, k: F.transform(c, lambda p: F.struct(p.alias("p"), F.lit(k).alias("k")))
    merged = F.array_sort(F.concat(tagged(one, 1), tagged(other, 2)))
    steps = lambda m: F.zip_with(m, F.slice(m, 2, F.size(m)), lambda a, b: F.coalesce((a["k"] != b["k"]) & (b["p"] - a["p"] <= distance), F.lit(False)))
    return F.get(F.transform(F.array(merged), lambda m: F.exists(steps(m), lambda s: s)), 0)


def _near_group(lists: Column, distance: Column) -> Column:
    """From some position on, every list has one within the span; walks from the end with the next position of each list."""
    span = distance * (F.size(lists) - 1)
    merged = F.array_sort(F.flatten(F.transform(lists, lambda c, k: F.transform(c, lambda p: F.struct((-p).alias("p"), k.alias("k"))))))
    never = F.lit(1 << 30)
    state = F.struct(F.transform(lists, lambda c: never).alias("next"), F.lit(False).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = -x["p"]
        following = F.transform(acc["next"], lambda n, k: F.when(k == x["k"], at).otherwise(n))
        return F.struct(following.alias("next"), (acc["found"] | F.forall(following, lambda n: n <= at + span)).alias("found"))

    return F.aggregate(merged, state, step)["found"]


def _item_matches(held: Column, keywords: Column, distance: Column) -> Column:
    at = lambda k: held[k]
    return (
        F.when(F.size(keywords) == 1, F.lit(True))
        .when(F.size(keywords) == 2, _near_pair(at(F.element_at(keywords, 1)), at(F.element_at(keywords, 2)), distance))
        .otherwise((F.size(F.array_distinct(keywords)) == F.size(keywords)) & _near_group(F.transform(keywords, at), distance))
    )


def matching_groups(queries: DataFrame, spark: SparkSession, path: str, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """``query_id, photo_id, group_no`` of the first matching OR group, from the index alone."""
    postings, words = _tables(spark, path)
    parsed = KW.parsed_queries(queries, distance).select("query_id", "d", F.inline("groups"))
    keywords = F.array_distinct(F.flatten(F.transform("items", lambda i: i["keywords"])))
    groups = parsed.withColumn("keywords", keywords)
    asked = groups.select("query_id", "group_no", F.explode("keywords").alias("term"))
    terms = asked.select("term").distinct()
    # Few pairs are broadcast to the postings, which else were all shuffled.
    matched = stored(KW.term_match(terms, words.select("word").distinct()), "matched")
    # How many photos may hold a keyword decides which is looked at first.
    counts = matched.join(words.groupBy("word").agg(F.sum("n").alias("n")), "word").groupBy("term").agg(F.sum("n").alias("n"))
    weighed = asked.join(counts, "term")
    probes = weighed.groupBy("query_id", "group_no").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("known"))
    # A group with a keyword that no word has matches nothing.
    probes = probes.join(groups.select("query_id", "group_no", F.size("keywords").alias("wanted")), ["query_id", "group_no"]).filter("known = wanted")
    located = matched.withColumn("bucket", _bucket(F.col("word")))
    held = postings.join(located, ["bucket", "word"]).groupBy("term", "photo_id").agg(
        F.array_sort(F.flatten(F.collect_list(_positions(F.col("steps"))))).alias("positions")
    )
    first = located.join(probes.select("term").distinct(), "term", "left_semi")
    holders = postings.select("bucket", "word", "photo_id").join(first, ["bucket", "word"]).select("term", "photo_id").distinct()
    candidates = probes.select("query_id", "group_no", "term").join(holders, "term").select("query_id", "group_no", "photo_id")
    needed = candidates.join(asked, ["query_id", "group_no"]).join(held, ["term", "photo_id"])
    entries = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    met = needed.groupBy("query_id", "group_no", "photo_id").agg(entries.alias("held")).join(groups, ["query_id", "group_no"])
    whole = F.size("held") == F.size("keywords")
    hit = F.forall("items", lambda i: _item_matches(F.col("held"), i["keywords"], F.col("d")))
    return met.filter(F.when(whole, hit).otherwise(False)).groupBy("query_id", "photo_id").agg(F.min("group_no").alias("group_no"))


def keyword_search(queries: DataFrame, library: DataFrame, path: str, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """The rows of ``keyword.keyword_search`` from a stored index; only the texts of hits are read, for their snippets."""
    spark = library.sparkSession
    hits = matching_groups(queries, spark, path, distance).select("query_id", "photo_id")
    count = F.coalesce("word_count", F.lit(0)) if "word_count" in library.columns else F.lit(0)
    source = library.withColumns({"word_count": count, "description_length": F.length("description")})
    keep = ("filename", "full_path", "description_length", "word_count")
    pairs = KW.asked_texts(hits, KW.parsed_queries(queries, distance), source, *keep, hits_only=False)
    return KW.evaluated(pairs, *keep).select("query_id", "photo_id", "filename", "matches", "full_path", "description_length", "word_count")
