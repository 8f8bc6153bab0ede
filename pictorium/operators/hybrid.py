"""Hybrid search: weighted phrase vectors re-ranked by word evidence.

The library is read once for the word evidence, which is kept as small arrays
beside ``photo_id``; descriptions never take part in a shuffle before the top-k
cut. Vectors join on ``photo_id``, each partition keeps its best rows, and only
those meet their descriptions again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pictorium.functions import kernels
from pictorium.functions import ranking as R
from pictorium.functions import text as T
from pictorium.functions.kernels import WordEvidence
from pictorium.operators import vectors as V
from pictorium.operators.catalog import FLAGS, flag_filter
from pictorium.operators.keyword import substring_match
from pictorium.session import rows_within, ship_package

MAX_LITERAL_QUERIES = 64
MAX_KNOWN_QUERIES = 2_048
MAX_TERM_CELLS = 20_000_000
FEW_TERMS = 48
LONG_WORD = 128
MAX_BROADCAST_HITS = 100_000


def query_words(queries: DataFrame) -> DataFrame:
    """``query_id, full_phrase, words`` of each query."""
    return queries.select(
        "query_id",
        R.full_phrase(F.col("query")).alias("full_phrase"),
        R.individual_words(F.col("query")).alias("words"),
    )


def expand_queries(queries: DataFrame) -> DataFrame:
    """``query_id, query, expanded``."""
    return queries.select("query_id", "query", R.expand_query(F.col("query")).alias("expanded"))


def whole_query_phrases(queries: DataFrame) -> DataFrame:
    """The query itself as its only phrase: ``query_id, phrase_no, phrase, token_count``."""
    phrase = T.strip(F.col("query"))
    return queries.select(
        "query_id",
        F.lit(1).alias("phrase_no"),
        phrase.alias("phrase"),
        F.size(T.blank_split(phrase)).alias("token_count"),
    )


def phrase_weights(phrases: DataFrame) -> DataFrame:
    """Phrases with ``weight``; the weights of a query sum to 1."""
    raw = R.raw_weight(F.col("token_count"))
    total = F.sum(raw).over(W.partitionBy("query_id"))
    return phrases.withColumn("weight", raw / total)


def encoded_phrases(phrases: DataFrame, encoder=None, dim: int = 64) -> DataFrame:
    """Weighted phrases with the vector of their expanded text."""
    weighted = phrase_weights(phrases).withColumn("expanded", R.expand_query(F.col("phrase")))
    keyed = weighted.withColumn("phrase_key", F.struct("query_id", "phrase_no").cast("string"))
    vectors = V.embed_text(keyed, "phrase_key", "expanded", encoder, dim)
    return keyed.join(vectors, "phrase_key").select("query_id", "phrase_no", "phrase", "weight", "embedding")


def query_vectors(phrases: DataFrame, encoder=None, dim: int = 64) -> DataFrame:
    """One vector for each query from its weighted phrases."""
    return V.combine_phrases(encoded_phrases(phrases, encoder, dim))


# ---------------------------------------------------------------- word evidence


def _asked(queries: DataFrame) -> DataFrame:
    """What the factor needs to know of each query."""
    return queries.select(
        "query_id",
        T.strip(F.lower("query")).alias("full"),
        (F.size(T.blank_split(F.col("query"))) > 1).alias("several"),
        R.individual_words(F.col("query")).alias("words"),
    )


def _literal_queries(asked: DataFrame, cap: int) -> Column | None:
    """The query table as one constant array, or None when it is too long."""
    rows = rows_within(asked.select(F.to_json(F.struct(*asked.columns)).alias("json")), cap)
    if rows is None:
        return None
    return F.from_json(F.lit("[" + ",".join(r["json"] for r in rows) + "]"), f"array<{asked.schema.simpleString()}>")


def _hit(q: Column, phrase: Column, matched: Column, pairs: Column) -> Column:
    asked = F.size(q["words"])
    return F.struct(
        q["query_id"].alias("query_id"),
        R.lexical_factor(phrase, matched, asked, R.adj_noun_match(q["words"], pairs)).alias("factor"),
        phrase.alias("phrase_matched"),
        matched.alias("word_matches"),
    )


def _photo_hits(library: DataFrame, literal: Column, pairs: DataFrame | None) -> DataFrame:
    """``photo_id, hits`` in one pass over the library; texts are not shuffled."""
    texts = library.select("photo_id", F.lower("description").alias("lowered"))
    evidence = F.transform(
        literal,
        lambda q: F.struct(
            q["query_id"].alias("query_id"),
            q["words"].alias("words"),
            (q["several"] & F.contains(F.col("lowered"), q["full"])).alias("phrase"),
            F.size(F.filter(q["words"], lambda w: F.contains(F.col("lowered"), w))).alias("matched"),
        ),
    )
    found = F.filter(evidence, lambda e: e["phrase"] | (e["matched"] > 0))
    read = texts.select("photo_id", F.explode_outer(found).alias("e")).filter(F.col("e").isNotNull())
    met = _meet_pairs(read, library, pairs)
    hit = _hit(F.col("e"), F.col("e.phrase"), F.col("e.matched"), F.col("pairs"))
    return met.select("photo_id", hit.alias("hit")).select("photo_id", "hit.*")


class _KnownQueries:
    """A small query table on the driver: its terms, and what each query asks of them.

    Only made when the table and the term-by-query counts are within bounds.
    """

    def __init__(self, rows: list[Row]):
        self.rows = rows
        self.terms = sorted({w for r in rows for w in r["words"]})
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.lengths = sorted({len(t) for t in self.terms})

    @classmethod
    def within_bounds(cls, asked: DataFrame, max_queries: int) -> _KnownQueries | None:
        rows = rows_within(asked, max_queries)
        if rows is None:
            return None
        known = cls(rows)
        return known if len(known.terms) * len(rows) <= MAX_TERM_CELLS else None

    def evidence(self, query_ids: pa.Array) -> WordEvidence:
        """Counts with queries in the order of the vector table."""
        column = {q: i for i, q in enumerate(query_ids.to_pylist())}
        place = np.array([column[r["query_id"]] for r in self.rows], dtype=np.int64)
        asked = np.zeros((max(1, len(self.terms)), len(column)))
        total = np.zeros(len(column))
        for row, q in zip(self.rows, place):
            for word in row["words"]:
                asked[self.number[word], q] += 1
            total[q] = len(row["words"])
        return WordEvidence(asked, total, place, R.BOOST, R.SCATTERED, R.MISSING_PENALTY)

    def photo_evidence(self, library: DataFrame, pairs: DataFrame | None) -> DataFrame:
        """``photo_id, terms, phrases`` and maybe ``grammatical``: term numbers, and queries by their place."""
        place = {r["query_id"]: i for i, r in enumerate(self.rows)}
        whole = [{"no": place[r["query_id"]], "full": r["full"]} for r in self.rows if r["several"]]
        phrases = F.transform(
            F.filter(_constant(whole, "no:int,full:string"), lambda q: F.contains(F.col("lowered"), q["full"])),
            lambda q: q["no"],
        )
        found = self._found_terms(library, phrases, whole)
        if pairs is None and "pairs" not in library.columns:
            return found
        related = [{"no": place[r["query_id"]], "words": r["words"]} for r in self.rows if len(r["words"]) > 1]
        grammatical = F.transform(
            F.filter(
                _constant(related, "no:int,words:array<string>"), lambda q: R.adj_noun_match(q["words"], F.col("pairs"))
            ),
            lambda q: q["no"],
        )
        met = _meet_pairs(found, library, pairs)
        return met.select("photo_id", "terms", "phrases", F.when(F.size("pairs") > 0, grammatical).alias("grammatical"))

    def _found_terms(self, library: DataFrame, phrases: Column, whole: list[dict]) -> DataFrame:
        """``photo_id, terms, phrases``.

        Few terms are looked for in the text one by one. Many are found together
        in one pass over each text where a multi-pattern matcher is installed;
        otherwise from the text's side, where each piece of a word that has the
        length of a term is looked up in the term table.
        """
        texts = library.select("photo_id", F.lower("description").alias("lowered"))
        if len(self.terms) <= FEW_TERMS:
            numbered = _constant([{"no": i, "term": t} for i, t in enumerate(self.terms)], "no:int,term:string")
            terms = F.transform(
                F.filter(numbered, lambda t: F.contains(F.col("lowered"), t["term"])), lambda t: t["no"]
            )
            return texts.select("photo_id", terms.alias("terms"), phrases.alias("phrases"))

        if kernels.ahocorasick is not None:
            return self._matched_terms(texts, whole)

        # The empty piece keeps texts without any term in the result.
        entries = [("", None), *((t, i) for i, t in enumerate(self.terms))]
        table = library.sparkSession.createDataFrame(entries, "term string, term_no int")
        pieces = F.array_append(self._pieces(F.col("lowered")), F.lit(""))
        read = texts.select("photo_id", phrases.alias("phrases"), pieces.alias("pieces"))
        # Never empty; the outer form keeps the optimizer from testing for that by making the pieces twice.
        exploded = read.select("photo_id", "phrases", F.explode_outer("pieces").alias("term"))
        return exploded.join(F.broadcast(table), "term").groupBy("photo_id").agg(
            F.collect_set("term_no").alias("terms"), F.max(F.when(F.col("term") == "", F.col("phrases"))).alias("phrases")
        )

    def _matched_terms(self, texts: DataFrame, whole: list[dict]) -> DataFrame:
        ship_package(texts.sparkSession)
        terms, queries = self.terms, {}
        for q in whole:
            queries.setdefault(q["full"], []).append(q["no"])

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = kernels.term_finder(terms, list(queries.items()))
            for batch in batches:
                found = find(batch.column("lowered").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("photo_id"), *found], names=["photo_id", "terms", "phrases"]
                )

        return texts.mapInArrow(match, "photo_id long, terms array<int>, phrases array<int>")

    def _pieces(self, lowered: Column) -> Column:
        """Pieces of the text's words that may be terms. Very long words are searched for the terms instead."""
        lengths = F.array(*[F.lit(n) for n in self.lengths])
        terms = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")

        def of_length(word: Column, n: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(word) - n + 1)
            return F.transform(starts, lambda i: F.substr(word, i, n))

        def of_word(word: Column) -> Column:
            fitting = F.filter(lengths, lambda n: n <= F.length(word))
            short = F.flatten(F.transform(fitting, lambda n: of_length(word, n)))
            return F.when(F.length(word) <= LONG_WORD, short).otherwise(
                F.filter(terms, lambda t: F.contains(word, t))
            )

        return F.flatten(F.transform(F.array_distinct(T.blank_split(lowered)), of_word))


def _constant(items: list[dict], fields: str) -> Column:
    """A list of records as one constant array."""
    return F.from_json(F.lit(json.dumps(items)), f"array<struct<{fields}>>")


def _indexed_hits(asked: DataFrame, library: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Hits of a query table of any size: ``photo_id, query_id, factor, phrase_matched, word_matches``."""
    every = asked.withColumn("parts", T.blank_split(F.col("full")))
    terms = every.select("query_id", F.explode("parts").alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("times")
    )
    held = library.select(
        "photo_id", F.explode(F.array_distinct(T.blank_split(F.lower("description")))).alias("word")
    )
    matched = substring_match(terms.select("term").distinct(), held.select("word").distinct())
    holders = held.join(matched, "word").select("photo_id", "term").distinct()
    counts = (
        holders.join(terms, "term")
        .groupBy("query_id", "photo_id")
        .agg(
            F.coalesce(F.sum(F.when(F.length("term") >= R.MIN_WORD_LENGTH, F.col("times"))), F.lit(0))
            .cast("int").alias("matched"),
            F.count("*").alias("terms_found"),
        )
        .join(every.withColumn("terms_asked", F.size(F.array_distinct("parts"))), "query_id")
    )
    # The whole phrase can only occur where each of its words does.
    worth_reading = (F.col("matched") > 0) | (F.col("several") & (F.col("terms_found") == F.col("terms_asked")))
    texts = library.select("photo_id", F.lower("description").alias("lowered"))
    phrase = F.col("several") & F.contains(F.col("lowered"), F.col("full"))
    read = counts.filter(worth_reading).join(texts, "photo_id").select(
        "photo_id", "query_id", "words", "matched", phrase.alias("phrase")
    ).filter(F.col("phrase") | (F.col("matched") > 0))
    hit = _hit(F.struct("query_id", "words"), F.col("phrase"), F.col("matched"), F.col("pairs"))
    return _meet_pairs(read, library, pairs).select("photo_id", hit.alias("hit")).select("photo_id", "hit.*")


def _gathered(pairs: DataFrame) -> DataFrame:
    """``photo_id, pairs``: the distinct pairs of each text."""
    return pairs.groupBy("photo_id").agg(F.collect_set(F.struct("adj", "noun")).alias("pairs"))


def _meet_pairs(narrow: DataFrame, library: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``narrow`` (by ``photo_id``, without texts) with ``pairs``; none without a parser.

    Pairs are joined to the evidence, not to the library, so texts stay where they are.
    """
    if pairs is not None:
        return narrow.join(_gathered(pairs), "photo_id", "left")
    if "pairs" in library.columns:
        return narrow.join(library.select("photo_id", "pairs"), "photo_id", "left")
    return narrow.withColumn("pairs", F.array().cast("array<struct<adj:string,noun:string>>"))


def lexical_factors(
    queries: DataFrame,
    library: DataFrame,
    pairs: DataFrame | None = None,
    max_literal: int = MAX_LITERAL_QUERIES,
) -> DataFrame:
    """Word evidence where there is any: ``query_id, photo_id, phrase_matched, word_matches, factor``.

    Pairs that are not listed have factor 1.
    """
    asked = _asked(queries)
    literal = _literal_queries(asked, max_literal)
    hits = _indexed_hits(asked, library, pairs) if literal is None else _photo_hits(library, literal, pairs)
    return hits.select("query_id", "photo_id", "phrase_matched", "word_matches", "factor")


# ---------------------------------------------------------------- search


def hybrid_search(
    queries: DataFrame,
    phrases: DataFrame | None,
    library: DataFrame,
    vectors: DataFrame,
    pairs: DataFrame | None = None,
    top_k: int = 50,
    min_score: float | None = 0.0,
    has_characters: bool | None = None,
    has_dogs: bool | None = None,
    has_cars: bool | None = None,
    encoder=None,
    dim: int = 64,
    max_queries: int = MAX_KNOWN_QUERIES,
    model_name: str | None = None,
) -> DataFrame:
    """Best ``top_k`` photos of each query by semantic score times lexical factor.

    ``query_id, rank, photo_id, filename, description, similarity,
    semantic_score, phrase_matched, word_matches`` and the flags. ``phrases``
    (``query_id, phrase_no, phrase, token_count``) come from
    ``noun_phrase_split``; without them the whole query is one phrase.
    ``min_score`` applies before the factor. A null query, or one without a
    phrase, finds nothing, however many queries there are. ``vectors`` of several
    models need ``model_name``.
    """
    queries = queries.filter(F.col("query").isNotNull())
    if phrases is not None:
        queries = queries.join(phrases.select("query_id").distinct(), "query_id", "left_semi")
        phrases = phrases.join(queries.select("query_id"), "query_id", "left_semi")
    wanted = flag_filter(library, has_characters, has_dogs, has_cars)
    asked = query_vectors(whole_query_phrases(queries) if phrases is None else phrases, encoder, dim)
    stored = V.same_model(vectors, model_name).select("photo_id", "embedding")
    known = _KnownQueries.within_bounds(_asked(queries), max_queries)
    if known is not None:
        corpus = known.photo_evidence(wanted, pairs).join(stored, "photo_id")
        partial = V.partial_topk(
            asked, corpus, top_k, min_score, rounded=True, evidence=known.evidence, max_broadcast=max_queries
        )
    else:
        corpus = wanted.select("photo_id").join(stored, "photo_id")
        hits = _indexed_hits(_asked(queries), wanted, pairs)
        partial = V.partial_topk(asked, corpus, top_k, min_score, rounded=True, hits=hits)
    best = V.ranked(partial, top_k)
    if known is not None and len(known.rows) * top_k <= MAX_BROADCAST_HITS:
        # So few hits meet their texts without a shuffle of the library.
        best = F.broadcast(best)
    flags = [c for c in FLAGS if c in library.columns]
    return best.join(library.select("photo_id", "filename", "description", *flags), "photo_id").select(
        "query_id", "rank", "photo_id", "filename", "description", "similarity",
        F.round("semantic", 4).alias("semantic_score"), "phrase_matched", "word_matches", *flags,
    )


def search_summary(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``query_id, results_count, top_score, top_3_avg`` of searches with results.

    With ``queries``, searches without results are listed too, with a count of 0.
    """
    top = F.when(F.col("rank") <= 3, F.col("similarity"))
    found = hits.groupBy("query_id").agg(
        F.count("*").cast("int").alias("results_count"),
        F.round(F.max("similarity"), 4).alias("top_score"),
        F.round(F.avg(top), 4).alias("top_3_avg"),
    )
    if queries is None:
        return found
    return queries.select("query_id").join(found, "query_id", "left").fillna(0, ["results_count"])


# ---------------------------------------------------------------- annotated words


def noun_phrase_split(annotations: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Phrases of annotated noun chunks: ``query_id, phrase_no, phrase, token_count``.

    Annotations: ``query_id, chunk, pos, token, upos``. A chunk is cut after a
    noun that another noun follows, once an adjective has come since the last
    cut. Longer phrases come first, equal ones in reading order. With
    ``queries``, a query without chunks is its own only phrase.

    A boundary between two nouns is a cut exactly when it is the first one
    after its latest adjective, so running maxima suffice.
    """
    in_chunk = W.partitionBy("query_id", "chunk").orderBy("pos")
    boundary = (F.col("upos") == "NOUN") & (F.lead("upos").over(in_chunk) == "NOUN")
    marked = annotations.select(
        "query_id", "chunk", "pos", "token",
        F.coalesce(boundary, F.lit(False)).alias("boundary"),
        F.max(F.when(F.col("upos") == "ADJ", F.col("pos"))).over(in_chunk).alias("last_adj"),
    )
    since_adj = W.partitionBy("query_id", "chunk", "last_adj").orderBy("pos")
    earlier = F.sum(F.col("boundary").cast("int")).over(since_adj.rowsBetween(W.unboundedPreceding, -1))
    cut = F.col("boundary") & F.col("last_adj").isNotNull() & (F.coalesce(earlier, F.lit(0)) == 0)
    cuts = marked.withColumn("cut", cut.cast("int"))
    part = F.coalesce(F.sum("cut").over(in_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda w: w["token"])
    phrases = (
        cuts.withColumn("part", part)
        .groupBy("query_id", "chunk", "part")
        .agg(words.alias("tokens"), F.min("pos").alias("start"))
        .select("query_id", "chunk", "start", F.array_join("tokens", " ").alias("phrase"),
                F.size("tokens").alias("token_count"))
    )
    longest = W.partitionBy("query_id").orderBy(F.col("token_count").desc(), "chunk", "start")
    split = phrases.select(
        "query_id", F.row_number().over(longest).alias("phrase_no"), "phrase", "token_count"
    )
    if queries is None:
        return split
    unsplit = whole_query_phrases(queries).join(split.select("query_id").distinct(), "query_id", "left_anti")
    return split.unionByName(unsplit)


def adj_noun_pairs(annotations: DataFrame) -> DataFrame:
    """Adjectives that modify a noun: ``photo_id, pos, adj, noun``.

    Annotations: ``photo_id, pos, token, upos, dep, head_pos``; words in lower case.
    """
    nouns = annotations.filter(F.col("upos") == "NOUN").select(
        "photo_id", F.col("pos").alias("head_pos"), F.lower("token").alias("noun")
    )
    modifiers = annotations.filter(F.col("dep") == "amod").select(
        "photo_id", "pos", "head_pos", F.lower("token").alias("adj")
    )
    return modifiers.join(nouns, ["photo_id", "head_pos"]).select("photo_id", "pos", "adj", "noun")


def adj_noun_matches(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct ``query_id, photo_id`` where some pair stands in the relation that the query names.

    Pairs and queries meet by prefix: a query word meets the words of the pair
    table that start with it through their leading characters, never pair by pair.
    Queries of one word pass for every photo and are not listed.
    """
    words = R.individual_words(F.col("query"))
    asked = queries.select("query_id", words.alias("words")).filter(F.size("words") > 1)
    size = F.size("words")
    roles = asked.select("query_id", F.inline(F.array(
        F.struct(F.element_at("words", -1).alias("noun_word"), F.slice("words", 1, size - 1).alias("adj_words")),
        F.struct(F.element_at("words", 1).alias("noun_word"), F.slice("words", 2, size - 1).alias("adj_words")),
    )))
    wanted = roles.select("query_id", "noun_word", F.explode(F.array_distinct("adj_words")).alias("adj_word")).distinct()
    head = R.MIN_WORD_LENGTH
    keyed = wanted.withColumns({"n": F.left("noun_word", F.lit(head)), "a": F.left("adj_word", F.lit(head))})
    known = pairs.select("photo_id", "adj", "noun").distinct().withColumns(
        {"n": F.left("noun", F.lit(head)), "a": F.left("adj", F.lit(head))}
    )
    met = known.join(keyed, ["n", "a"]).filter(
        F.startswith("noun", F.col("noun_word")) & F.startswith("adj", F.col("adj_word"))
    )
    return met.select("query_id", "photo_id").distinct()
