"""Boolean and proximity keyword search: a table of queries against a library.

Query columns: ``query_id``, ``query`` and optionally ``d`` (words allowed
between keywords). Library columns: ``photo_id``, ``filename``,
``description``, ``full_path``.

Two exact ways lead to the candidate pairs. While the query table is small
(checked), the library is scanned once with the queries as a constant, without
a join or a shuffle. Beyond that, candidates come from equi-joins over the vocabulary:
keyword and word meet on a shared three-letter piece, so neither side is
broadcast and no pairing is exhaustive. Both ways end in the same row-local
evaluation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pictorium.functions import keywords as K
from pictorium.functions import text as T
from pictorium.session import rows_within, stored

MAX_LITERAL_QUERIES = 1_000
MAX_LITERAL_PROBES = 256
ANSWERED_TOGETHER = 1_000


def with_distance(queries: DataFrame, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """Queries with their distance column; a missing column or value takes the default."""
    d = F.coalesce(F.col("d").cast("int"), F.lit(distance)) if "d" in queries.columns else F.lit(distance)
    return queries.select("query_id", "query", d.alias("d"))


def parsed_queries(queries: DataFrame, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """``query_id, d, groups``: blank queries and the face query ``me`` left out."""
    cleaned = T.strip(F.lower("query"))
    return (
        with_distance(queries, distance)
        .filter((cleaned != "") & (cleaned != "me"))
        .select("query_id", "d", K.parse_query(F.col("query")).alias("groups"))
    )


def normalize_queries(queries: DataFrame, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """One row for each AND item: ``query_id, d, group_no, item_no, kind, keywords``."""
    return (
        parsed_queries(queries, distance)
        .select("query_id", "d", F.inline("groups"))
        .select("query_id", "d", "group_no", F.posexplode("items").alias("item_no", "item"))
        .select("query_id", "d", "group_no", "item_no", "item.kind", "item.keywords")
    )


def token_index(library: DataFrame) -> DataFrame:
    """Postings ``photo_id, pos, token``; positions count from 0, case is kept."""
    return library.select("photo_id", F.posexplode(T.words(F.col("description"))).alias("pos", "token"))


def vocabulary(library: DataFrame) -> DataFrame:
    """Distinct lower-case words. Repeats within a text go before the shuffle."""
    words = F.array_distinct(K.lower_all(T.words(F.col("description"))))
    return library.select(F.explode(words).alias("word")).distinct()


def _pieces(word: Column, size: int = 3) -> Column:
    """Distinct pieces of ``size`` characters; none for shorter words."""
    count = F.greatest(F.length(word) - (size - 1), F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(word, i, F.lit(size))))


def _sharing_piece(terms: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Pairs where the word contains the term, for terms of at least ``size`` characters.

    A term meets only the words that share its rarest piece, so the join runs on
    equality; the containment is then checked.
    """
    word_pieces = words.select("word", F.explode(_pieces(F.col("word"), size)).alias("piece"))
    term_pieces = terms.select("term", F.explode(_pieces(F.col("term"), size)).alias("piece"))
    spread = word_pieces.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (
        term_pieces.join(spread, "piece")
        .groupBy("term")
        .agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    )
    return word_pieces.join(rarest, "piece").filter(F.contains("word", F.col("term"))).select("term", "word")


def substring_match(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs ``(term, word)`` where the word contains the term; both columns distinct."""
    sized = [terms.filter(F.length("term") == 1), terms.filter(F.length("term") == 2), terms.filter(F.length("term") > 2)]
    parts = [_sharing_piece(t, words, size) for size, t in enumerate(sized, start=1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def term_match(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs ``(term, word)`` where the word satisfies the term; both columns distinct, lower case.

    Terms under three characters must equal the word, longer ones occur in it.
    """
    short = terms.filter(F.length("term") < 3).join(words, F.col("term") == F.col("word")).select("term", "word")
    return short.unionByName(_sharing_piece(terms.filter(F.length("term") >= 3), words, 3))


def tokenised(library: DataFrame, *keep: str) -> DataFrame:
    """Library with ``tokens`` and ``lowered`` arrays, each text split once."""
    split = library.select("photo_id", *keep, T.words(F.col("description")).alias("tokens"))
    return split.withColumn("lowered", K.lower_all(F.col("tokens")))


def _probe(keywords: Column) -> Column:
    """The longest keyword: a text without it cannot match."""
    return F.aggregate(
        keywords, F.lit(""), lambda best, k: F.when(F.length(k) > F.length(best), k).otherwise(best)
    )


def _group_probes(groups: Column) -> Column:
    return F.transform(groups, lambda g: _probe(F.flatten(F.transform(g["items"], lambda i: i["keywords"]))))


def _may_contain(lowered_text: Column, probes: Column) -> Column:
    """False only for texts that cannot match. Keywords outside ASCII are not judged here,
    since lower case of a word may differ from lower case of its text."""
    return F.exists(probes, lambda p: F.contains(lowered_text, p) | (F.octet_length(p) != F.length(p)))


def _any_probe(library: DataFrame, probes: list[str]) -> DataFrame:
    """Library rows that hold at least one probe; runs inside the scan."""
    judged = [p for p in dict.fromkeys(probes) if p.isascii()]
    if len(judged) < len(set(probes)) or not judged or len(judged) > MAX_LITERAL_PROBES:
        return library
    lowered = F.lower("description")
    test = F.contains(lowered, F.lit(judged[0]))
    for probe in judged[1:]:
        test = test | F.contains(lowered, F.lit(probe))
    return library.filter(test)


def asked_texts(pairs: DataFrame, parsed: DataFrame, library: DataFrame, *keep: str, hits_only: bool = True) -> DataFrame:
    """Each text with each query that ``pairs`` (``query_id, photo_id``) names, and the ``group`` that matches it.

    Texts are shuffled as they are, and split once for up to about
    ``ANSWERED_TOGETHER`` queries. Without ``hits_only`` pairs without a matching group stay.
    """
    packs = max(1, math.ceil(parsed.count() / ANSWERED_TOGETHER))
    pack = F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")
    asked = pairs.join(parsed, "query_id").groupBy("photo_id", pack).agg(F.collect_list(F.struct("query_id", "d", "groups")).alias("asked"))
    columns = list(dict.fromkeys((*keep, "description")))
    texts = tokenised(library.select("photo_id", *columns).join(asked, "photo_id"), *keep, "asked")
    judged = F.transform("asked", lambda q: F.struct(
        q["query_id"].alias("query_id"), q["d"].alias("d"), K.first_matching_group(F.col("lowered"), q["groups"], q["d"]).alias("group")
    ))
    found = F.filter(judged, lambda q: q["group"].isNotNull()) if hits_only else judged
    # As in ``_matching``, the outer explode keeps the queries from being evaluated twice.
    rows = texts.select("photo_id", *keep, "tokens", "lowered", F.explode_outer(found).alias("_q")).filter(F.col("_q").isNotNull())
    return rows.select("photo_id", *keep, "tokens", "lowered", "_q.*")


def evaluated(pairs: DataFrame, *keep: str) -> DataFrame:
    """Snippets of the first matching group of each joined (query, text) row."""
    group = F.col("group") if "group" in pairs.columns else K.first_matching_group(F.col("lowered"), F.col("groups"), F.col("d"))
    chosen = pairs.select("query_id", "photo_id", *keep, "tokens", "lowered", "d", group.alias("group"))
    return chosen.select(
        "query_id",
        "photo_id",
        *keep,
        F.col("group.group_no").alias("group_no"),
        K.snippet_map(F.col("tokens"), F.col("lowered"), F.col("group.items"), F.col("d")).alias("matches"),
    )


def _matching(texts: DataFrame, table: DataFrame, json_rows: list[str], hit) -> DataFrame:
    """Each text with each query of a small table that ``hit`` accepts, as columns of the query.

    The queries stand in the plan as one constant array, so there is no join.
    The outer explode keeps the optimizer from testing for empty arrays, which
    would evaluate every query twice.
    """
    constant = F.from_json(F.lit("[" + ",".join(json_rows) + "]"), f"array<{table.schema.simpleString()}>")
    found = texts.select("*", F.explode_outer(F.filter(constant, hit)).alias("_q")).filter(F.col("_q").isNotNull())
    return found.select(*texts.columns, "_q.*")


def _as_json(table: DataFrame) -> Column:
    return F.to_json(F.struct(*table.columns)).alias("json")


def _scan_pairs(parsed: DataFrame, known: list[Row], library: DataFrame, *keep: str) -> DataFrame:
    """Small query table: one pass over the library, exact test in place, no shuffle."""
    probes = [p for row in known for p in row["probes"]]
    texts = tokenised(_any_probe(library, probes), *keep, "description").withColumn(
        "lowered_text", F.lower("description")
    )

    def hit(q: Column) -> Column:
        found = K.first_matching_group(F.col("lowered"), q["groups"], q["d"]).isNotNull()
        return _may_contain(F.col("lowered_text"), q["probes"]) & found

    with_probes = parsed.withColumn("probes", _group_probes(F.col("groups")))
    return _matching(texts, with_probes, [r["json"] for r in known], hit).drop("lowered_text", "probes")


def _index_pairs(parsed: DataFrame, library: DataFrame, *keep: str) -> DataFrame:
    """Any query table: candidates through the vocabulary, equi-joins only.

    The words of the texts, the vocabulary and its matches are stored, so each text is split once for all of them.
    """
    probes = parsed.select("query_id", F.explode(F.array_distinct(_group_probes(F.col("groups")))).alias("term"))
    distinct = F.array_distinct(K.lower_all(F.array_distinct(T.words(F.col("description")))))
    words = stored(library.select("photo_id", distinct.alias("words")), "words").select("photo_id", F.explode("words").alias("word"))
    known = stored(words.select("word").distinct(), "vocabulary")
    matched = stored(term_match(probes.select("term").distinct(), known), "matched")
    holders = words.join(matched, "word").select("term", "photo_id").distinct()
    candidates = holders.join(probes, "term").select("query_id", "photo_id").distinct()
    return asked_texts(candidates, parsed, library, *keep)


def _hits(parsed: DataFrame, library: DataFrame, *keep: str, max_literal: int = MAX_LITERAL_QUERIES) -> DataFrame:
    probed = parsed.withColumn("probes", _group_probes(F.col("groups")))
    known = rows_within(probed.select("probes", _as_json(probed)), max_literal)
    pairs = _index_pairs(parsed, library, *keep) if known is None else _scan_pairs(parsed, known, library, *keep)
    return evaluated(pairs, *keep)


def keyword_hits(
    queries: DataFrame,
    library: DataFrame,
    *keep: str,
    distance: int = K.DEFAULT_DISTANCE,
    max_literal: int = MAX_LITERAL_QUERIES,
) -> DataFrame:
    """``query_id, photo_id, <keep>, group_no, matches`` of every match."""
    return _hits(parsed_queries(queries, distance), library, *keep, max_literal=max_literal)


def keyword_search(
    queries: DataFrame,
    library: DataFrame,
    distance: int = K.DEFAULT_DISTANCE,
    faces: DataFrame | None = None,
    max_literal: int = MAX_LITERAL_QUERIES,
) -> DataFrame:
    """The full search: ``query_id, photo_id, filename, matches, full_path, description_length, word_count``.

    ``photo_id`` is library order. With ``faces`` (``photo_id, face``), the query
    ``me`` returns the photos with known faces. A library without a
    ``word_count`` column reports 0, as records without metadata do.
    """
    count = F.coalesce("word_count", F.lit(0)) if "word_count" in library.columns else F.lit(0)
    source = library.withColumns({"word_count": count, "description_length": F.length("description")})
    columns = ["query_id", "photo_id", "filename", "matches", "full_path", "description_length", "word_count"]
    hits = keyword_hits(
        queries, source, "filename", "full_path", "description_length", "word_count",
        distance=distance, max_literal=max_literal,
    ).select(*columns)
    if faces is None:
        return hits
    from pictorium.operators.faces import known_face_search

    known = known_face_search(source, faces).withColumn(
        "matches", F.create_map(F.lit("Face Recognition"), F.col("labels"))
    )
    me = queries.filter(T.strip(F.lower("query")) == "me").select("query_id")
    packs = max(1, math.ceil(me.count() / ANSWERED_TOGETHER))
    packed = me.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")).agg(
        F.collect_list("query_id").alias("query_ids")
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))
    answered = known.withColumn("pack", F.explode(numbers)).join(packed, "pack")
    return hits.unionByName(answered.withColumn("query_id", F.explode("query_ids")).select(*columns))


def _one_group(items: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("group_no"), items.alias("items")))


def item_matches(queries: DataFrame, library: DataFrame, kind: str, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """Matches of single items: ``query_id, group_no, item_no, photo_id, label, snippets``.

    ``kind`` picks the items: ``standalone``, ``pair`` (two keywords) or
    ``group`` (three or more).
    """
    size = F.size("keywords")
    wanted = {"standalone": size == 1, "pair": size == 2, "group": size > 2}[kind]
    items = normalize_queries(queries, distance).filter(wanted)
    parsed = items.select(
        F.struct("query_id", "group_no", "item_no").alias("query_id"),
        "d",
        _one_group(F.array(F.struct("kind", "keywords"))).alias("groups"),
    )
    hits = _hits(parsed, library)
    only = F.get(F.map_entries("matches"), F.lit(0))
    return hits.select("query_id.*", "photo_id", only["key"].alias("label"), only["value"].alias("snippets"))


def and_groups(queries: DataFrame, library: DataFrame, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """Every matching AND group: ``query_id, group_no, photo_id, matches``."""
    parsed = (
        parsed_queries(queries, distance)
        .select("query_id", "d", F.inline("groups"))
        .select(F.struct("query_id", "group_no").alias("query_id"), "d", _one_group(F.col("items")).alias("groups"))
    )
    return _hits(parsed, library).select("query_id.*", "photo_id", "matches")


def or_groups(queries: DataFrame, library: DataFrame, distance: int = K.DEFAULT_DISTANCE) -> DataFrame:
    """The first matching group of each query: ``query_id, photo_id, group_no, matches``."""
    return keyword_hits(queries, library, distance=distance).select("query_id", "photo_id", "group_no", "matches")


def word_proximity(
    queries: DataFrame,
    library: DataFrame,
    distance: int = K.DEFAULT_DISTANCE,
    max_literal: int = MAX_LITERAL_QUERIES,
) -> DataFrame:
    """Pairs ``query_id, photo_id`` whose query words lie close together (blank-separated, by substring).

    Queries with fewer than two words ask for nothing and are left out.
    """
    words = queries.select("query_id", T.blank_split(F.lower("query")).alias("words")).filter(F.size("words") > 1)
    texts = library.select("photo_id", F.lower("description").alias("lowered_text"))
    texts = texts.withColumn("tokens", T.blank_split(F.col("lowered_text")))
    known = rows_within(words.select(_as_json(words)), max_literal)
    if known is not None:
        def hit(q: Column) -> Column:
            present = F.forall(q["words"], lambda w: F.contains(F.col("lowered_text"), w))
            return present & K.word_proximity(F.col("tokens"), q["words"], distance)

        return _matching(texts, words, [r["json"] for r in known], hit).select("query_id", "photo_id")

    probes = words.select("query_id", _probe(F.col("words")).alias("term"))
    held = library.select(
        "photo_id", F.explode(F.array_distinct(T.blank_split(F.lower("description")))).alias("word")
    )
    matched = substring_match(probes.select("term").distinct(), held.select("word").distinct())
    holders = held.join(matched, "word").select("term", "photo_id").distinct()
    candidates = holders.join(probes, "term").select("query_id", "photo_id")
    close = K.word_proximity(F.col("tokens"), F.col("words"), distance)
    joined = candidates.join(words, "query_id").alias("q").join(
        texts.alias("t"), (F.col("q.photo_id") == F.col("t.photo_id")) & close
    )
    return joined.select("query_id", F.col("t.photo_id").alias("photo_id"))
