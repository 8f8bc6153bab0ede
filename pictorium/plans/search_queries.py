"""Registered queries: keyword search, vectors, hybrid search, annotated words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions import ranking as R
from pictorium.functions import text as T
from pictorium.operators import encodings
from pictorium.operators import hybrid as H
from pictorium.operators import keyword as KW
from pictorium.operators import keywordindex
from pictorium.operators import thresholds
from pictorium.operators import vectorindex
from pictorium.operators import vectors as V
from pictorium.plans import sqlbits as S
from pictorium.plans.catalog_queries import turn_queries
from pictorium.plans.registry import Inputs, query
from pictorium.session import scratch_path

# ---------------------------------------------------------------- check texts for keyword search


def _items(source: str) -> str:
    """CTEs ``items(query_id, d, group_no, item_no, kind, keywords)`` from a table of queries."""
    blank = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
    return f"""
    raw_groups AS (
        SELECT query_id, d, unnest(string_split_regex(lower(query), '{blank}or{blank}')) AS grp,
               generate_subscripts(string_split_regex(lower(query), '{blank}or{blank}'), 1) AS gi
        FROM {source} WHERE {S.strip('query')} <> ''),
    raw_parts AS (
        SELECT query_id, d, gi, unnest(string_split_regex({S.strip('grp')}, '{blank}and{blank}')) AS part,
               generate_subscripts(string_split_regex({S.strip('grp')}, '{blank}and{blank}'), 1) AS pi
        FROM raw_groups),
    items AS (
        SELECT query_id, d, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY gi) - 1 AS INT) AS group_no,
               CAST(row_number() OVER (PARTITION BY query_id, gi ORDER BY pi) - 1 AS INT) AS item_no,
               CASE WHEN len(keywords) > 1 THEN 'proximity' ELSE 'standalone' END AS kind, keywords
        FROM (SELECT *, {S.blank_words('part')} AS keywords FROM raw_parts) WHERE len(keywords) > 0)"""


_MATCH = "CASE WHEN length({k}) < 3 THEN {w} = {k} ELSE contains({w}, {k}) END"

_ITEM_HITS = _items("boolean_queries") + rf""",
    toks AS (SELECT photo_id, regexp_extract_all(description, '{S.WORD_CLASS}') AS t FROM library),
    postings AS (SELECT photo_id, CAST(unnest(range(len(t))) AS INT) AS pos, lower(unnest(t)) AS w FROM toks),
    item_words AS (SELECT query_id, group_no, item_no, d, len(keywords) AS n, len(list_distinct(keywords)) AS nd,
                          unnest(keywords) AS k, generate_subscripts(keywords, 1) AS ki FROM items),
    word_hits AS (
        SELECT query_id, group_no, item_no, d, n, nd, k, ki, photo_id, pos
        FROM item_words JOIN postings ON {_MATCH.format(k='k', w='w')}),
    single_snips AS (
        SELECT query_id, group_no, item_no, photo_id, pos AS p1, 0 AS p2,
               array_to_string(list_concat(t[pos - b2 + 1 : pos], ['**' || t[pos + 1] || '**'],
                                           t[pos + 2 : pos + a2 + 1]), ' ') AS snip
        FROM (SELECT *, CASE WHEN bef < 3 THEN least(room, 6 - bef) ELSE aft END AS a2,
                        CASE WHEN bef >= 3 AND aft < 3 THEN least(pos, 6 - aft) ELSE bef END AS b2
              FROM (SELECT h.*, t, least(pos, 3) AS bef, least(len(t) - pos - 1, 3) AS aft, len(t) - pos - 1 AS room
                    FROM word_hits h JOIN toks USING (photo_id) WHERE n = 1))),
    pair_snips AS (
        SELECT query_id, group_no, item_no, photo_id, min(p1) AS p1, arg_min(p2, p1::BIGINT * 1000000 + p2) AS p2, snip
        FROM (SELECT query_id, group_no, item_no, photo_id, p1, p2,
                     array_to_string(list_transform(
                         range(greatest(least(p1, p2) - 3, 0), least(greatest(p1, p2) + 3, len(t) - 1) + 1),
                         lambda i: CASE WHEN i = p1 OR i = p2 THEN '**' || t[i + 1] || '**' ELSE t[i + 1] END), ' ') AS snip
              FROM (SELECT a.query_id, a.group_no, a.item_no, a.photo_id, a.pos AS p1, b.pos AS p2
                    FROM word_hits a JOIN word_hits b
                      ON a.query_id = b.query_id AND a.group_no = b.group_no AND a.item_no = b.item_no
                     AND a.photo_id = b.photo_id AND a.ki = 1 AND b.ki = 2 AND abs(a.pos - b.pos) <= a.d
                    WHERE a.n = 2) JOIN toks USING (photo_id))
        GROUP BY query_id, group_no, item_no, photo_id, snip),
    anchors AS (
        SELECT query_id, group_no, item_no, photo_id, a, last, d, n
        FROM (SELECT x.query_id, x.group_no, x.item_no, x.photo_id, x.d, x.n, x.pos AS a, max(y.pos) AS last,
                     row_number() OVER (PARTITION BY x.query_id, x.group_no, x.item_no, x.photo_id ORDER BY x.pos) AS r
              FROM (SELECT DISTINCT query_id, group_no, item_no, photo_id, d, n, nd, pos FROM word_hits WHERE n > 2) x
              JOIN word_hits y ON x.query_id = y.query_id AND x.group_no = y.group_no AND x.item_no = y.item_no
                   AND x.photo_id = y.photo_id AND y.pos BETWEEN x.pos AND x.pos + x.d * (x.n - 1)
              GROUP BY x.query_id, x.group_no, x.item_no, x.photo_id, x.d, x.n, x.nd, x.pos
              HAVING count(DISTINCT y.k) = x.n)
        WHERE r = 1),
    group_snips AS (
        SELECT query_id, group_no, item_no, photo_id, a AS p1, 0 AS p2,
               (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM word_hits h
                        WHERE h.query_id = s.query_id AND h.group_no = s.group_no AND h.item_no = s.item_no
                          AND h.photo_id = s.photo_id AND h.pos = s.i)
                        THEN '**' || s.w || '**' ELSE s.w END, ' ' ORDER BY s.i)
                FROM (SELECT c.query_id, c.group_no, c.item_no, c.photo_id, unnest(range(c.s, c.e + 1)) AS i,
                             unnest(c.t[c.s + 1 : c.e + 1]) AS w) s) AS snip
        FROM (SELECT anchors.*, t, greatest(a - 3, 0) AS s, least(last + 3, len(t) - 1) AS e
              FROM anchors JOIN toks USING (photo_id)) c),
    item_hits AS (
        SELECT query_id, group_no, item_no, photo_id, array_to_string(keywords, ' ') AS label,
               string_agg(snip, ' | ' ORDER BY p1, p2) AS snippets
        FROM (SELECT * FROM single_snips UNION ALL SELECT * FROM pair_snips UNION ALL SELECT * FROM group_snips)
        JOIN items USING (query_id, group_no, item_no)
        GROUP BY query_id, group_no, item_no, photo_id, label),
    group_hits AS (
        SELECT query_id, group_no, photo_id, string_agg(label || '=>' || snippets, ' ;; ' ORDER BY label) AS matches
        FROM (SELECT DISTINCT query_id, group_no, photo_id, label, snippets FROM item_hits
              WHERE (query_id, group_no, photo_id) IN (
                  SELECT (h.query_id, h.group_no, h.photo_id) FROM item_hits h
                  JOIN (SELECT query_id, group_no, count(*) AS n FROM items GROUP BY ALL) c USING (query_id, group_no)
                  GROUP BY h.query_id, h.group_no, h.photo_id, c.n HAVING count(DISTINCT h.item_no) = c.n))
        GROUP BY query_id, group_no, photo_id),
    first_groups AS (
        SELECT query_id, photo_id, min(group_no) AS group_no, arg_min(matches, group_no) AS matches
        FROM group_hits GROUP BY query_id, photo_id)"""

_KEYWORD_VIEWS = ("library", "boolean_queries")


def snippets_text(snippets: Column) -> Column:
    return F.array_join(snippets, " | ")


def matches_text(matches: Column) -> Column:
    entries = F.transform(F.map_entries(matches), lambda e: F.concat(e["key"], F.lit("=>"), snippets_text(e["value"])))
    return F.array_join(F.array_sort(entries), " ;; ")


# ---------------------------------------------------------------- keyword search


@query("normalize_queries", f"""
    WITH turns AS (SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS query_id, text AS query, 3 AS d
                   FROM conversations), {_items("turns")}
    SELECT query_id, group_no, item_no, kind, array_to_string(keywords, ' ') AS keywords FROM items
""")
def _(inputs):
    return KW.normalize_queries(turn_queries(inputs)).select(
        "query_id", "group_no", "item_no", "kind", F.array_join("keywords", " ").alias("keywords")
    )


@query("token_index", rf"""
    SELECT photo_id, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS token
    FROM (SELECT photo_id, regexp_extract_all(description, '{S.WORD_CLASS}') AS t FROM library)
""", ("library",))
def _(inputs):
    return KW.token_index(inputs.library)


@query("vocabulary", rf"""
    SELECT DISTINCT lower(unnest(regexp_extract_all(description, '{S.WORD_CLASS}'))) AS word FROM library
""", ("library",))
def _(inputs):
    return KW.vocabulary(inputs.library)


@query("term_match", rf"""
    WITH terms AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{S.WORD_CLASS}'))) AS term FROM benchmark),
    words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(description, '{S.WORD_CLASS}'))) AS word FROM library)
    SELECT term, word FROM terms JOIN words ON {_MATCH.format(k='term', w='word')}
""", ("library",))
def _(inputs):
    terms = KW.vocabulary(inputs.benchmark.select(F.col("text").alias("description"))).withColumnRenamed("word", "term")
    return KW.term_match(terms, KW.vocabulary(inputs.library))


def _item_query(kind: str):
    def run(inputs: Inputs) -> DataFrame:
        hits = KW.item_matches(inputs.boolean_queries, inputs.library, kind)
        return hits.withColumn("snippets", snippets_text(F.col("snippets")))

    return run


def _item_check(size: str, columns: str = "query_id, group_no, item_no, photo_id, label, snippets") -> str:
    return f"""WITH {_ITEM_HITS}
    SELECT {columns} FROM item_hits JOIN items USING (query_id, group_no, item_no) WHERE len(keywords) {size}"""


for _name, _kind, _size in (
    ("standalone_match", "standalone", "= 1"), ("proximity2_match", "pair", "= 2"), ("proximityN_match", "group", "> 2"),
):
    query(_name, _item_check(_size, "query_id, group_no, item_no, photo_id, label"), _KEYWORD_VIEWS)(
        lambda inputs, kind=_kind: _item_query(kind)(inputs).drop("snippets")
    )
for _name, _kind, _size in (("snippet1", "standalone", "= 1"), ("snippet2", "pair", "= 2"), ("snippetN", "group", "> 2")):
    query(_name, _item_check(_size), _KEYWORD_VIEWS)(_item_query(_kind))


@query("and_group", f"WITH {_ITEM_HITS} SELECT * FROM group_hits", _KEYWORD_VIEWS)
def _(inputs):
    return KW.and_groups(inputs.boolean_queries, inputs.library).withColumn("matches", matches_text(F.col("matches")))


@query("or_groups", f"WITH {_ITEM_HITS} SELECT * FROM first_groups", _KEYWORD_VIEWS)
def _(inputs):
    return KW.or_groups(inputs.boolean_queries, inputs.library).withColumn("matches", matches_text(F.col("matches")))


_KEYWORD_CHECK = f"""WITH {_ITEM_HITS}
    SELECT query_id, photo_id, filename, matches, full_path, CAST(length(description) AS INT) AS description_length,
           CAST(len({S.blank_words('description')}) AS INT) AS word_count
    FROM first_groups JOIN library USING (photo_id)"""


def _searchable(inputs: Inputs) -> DataFrame:
    return inputs.library.withColumn("word_count", T.word_count(F.col("description")))


@query("keyword_search", _KEYWORD_CHECK, _KEYWORD_VIEWS)
def _(inputs):
    hits = KW.keyword_search(inputs.boolean_queries, _searchable(inputs))
    return hits.withColumn("matches", matches_text(F.col("matches")))


@query("keyword_search_indexed", _KEYWORD_CHECK, _KEYWORD_VIEWS)
def _(inputs):
    hits = KW.keyword_search(inputs.boolean_queries, _searchable(inputs), max_literal=0)
    return hits.withColumn("matches", matches_text(F.col("matches")))


@query("keyword_search_stored", _KEYWORD_CHECK, _KEYWORD_VIEWS)
def _(inputs):
    searchable, path = _searchable(inputs), scratch_path(inputs.spark, "keyword-index")
    for part in (0, 1):
        keywordindex.add(searchable.filter(F.pmod("photo_id", F.lit(2)) == part), path)
    hits = keywordindex.keyword_search(inputs.boolean_queries, searchable, path)
    return hits.withColumn("matches", matches_text(F.col("matches")))


@query("word_proximity", f"""
    WITH words AS (SELECT query_id, {S.blank_words('lower(query)')} AS w FROM boolean_queries),
    pairs AS (SELECT query_id, w, photo_id, {S.blank_words('lower(description)')} AS t FROM words, library
              WHERE len(w) > 1 AND len(list_filter(w, lambda x: contains(lower(description), x))) = len(w)),
    hits AS (SELECT query_id, photo_id, w, ki, pos
             FROM (SELECT query_id, photo_id, w, t, unnest(range(1, len(w) + 1)) AS ki FROM pairs),
                  LATERAL (SELECT unnest(range(len(t))) AS pos, unnest(t) AS word) WHERE contains(word, w[ki]))
    SELECT DISTINCT query_id, photo_id FROM (
        SELECT a.query_id, a.photo_id, a.pos, len(a.w) AS n, count(DISTINCT b.ki) AS near
        FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.photo_id = b.photo_id AND a.ki = 1 AND b.ki > 1
             AND abs(a.pos - b.pos) <= 3
        GROUP BY a.query_id, a.photo_id, a.pos, len(a.w)) WHERE near = n - 1
""", _KEYWORD_VIEWS)
def _(inputs):
    return KW.word_proximity(inputs.boolean_queries, inputs.library)


# ---------------------------------------------------------------- vectors


def hashed(name: str, key: str, text: str, source: str) -> str:
    """CTE ``name(key, embedding)`` with the built-in encoder's vectors of a source."""
    return rf"""
    {name}_counts AS (
        SELECT {key}, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS c
        FROM (SELECT {key}, lower(unnest(regexp_extract_all({text}, '{S.WORD_CLASS}'))) AS w FROM {source})
        GROUP BY 1, 2),
    {name} AS (
        SELECT {key}, list(coalesce(c, 0) / CASE WHEN n > 0 THEN sqrt(n) ELSE 1 END ORDER BY bucket) AS embedding
        FROM (SELECT {key}, unnest(range(64)) AS bucket FROM {source})
        LEFT JOIN {name}_counts USING ({key}, bucket)
        LEFT JOIN (SELECT {key}, sum(c * c)::DOUBLE AS n FROM {name}_counts GROUP BY 1) USING ({key})
        GROUP BY {key})"""


_EXPANDED = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(R.EXPANSIONS))


def expanded(text: str) -> str:
    asked = S.strip(f"lower({text})")
    return f"""concat({text}, coalesce((SELECT ' ' || r.expansion FROM (VALUES {_EXPANDED}) r(priority, key, expansion)
        WHERE contains({asked}, r.key) ORDER BY {asked} <> r.key, r.priority LIMIT 1), ''))"""


@query("embed_text", f"""
    WITH {hashed('e', 'photo_id', 'description', 'library')}
    SELECT photo_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim_no, round(unnest(embedding), 6) AS value FROM e
""", ("library",))
def _(inputs):
    rows = V.embed_text(inputs.library).select("photo_id", F.posexplode("embedding").alias("dim_no", "value"))
    return rows.withColumn("value", F.round("value", 6))


def reference_queries(inputs: Inputs) -> DataFrame:
    """One query vector for each label."""
    return inputs.face_refs.select(F.col("ref_id").alias("query_id"), "embedding")


_COSINE = """
    SELECT query_id, rank, photo_id, round(similarity, 6) AS similarity
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, photo_id) AS INT) AS rank
          FROM (SELECT ref_id AS query_id, photo_id,
                       list_dot_product(r.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
                FROM face_refs r, vectors v))
    WHERE rank <= 20"""


@query("cosine_topk", _COSINE + " AND similarity >= 0.3", ("face_refs", "vectors"))
def _(inputs):
    hits = V.cosine_topk(reference_queries(inputs), inputs.vectors, 20, 0.3, "driver-64")
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("cosine_topk_blocked", _COSINE, ("face_refs", "vectors"))
def _(inputs):
    hits = V.cosine_topk(reference_queries(inputs), inputs.vectors, 20, None, "driver-64", max_broadcast=0)
    return hits.withColumn("similarity", F.round("similarity", 6))


def _index(inputs) -> str:
    path = scratch_path(inputs.spark, "vector-index")
    vectorindex.build(V.same_model(inputs.vectors, "driver-64"), path)
    return path


@query("cosine_topk_indexed", _COSINE, ("face_refs", "vectors"))
def _(inputs):
    hits = vectorindex.search(reference_queries(inputs), inputs.spark, _index(inputs), 20, None).rows
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("cosine_topk_index_blocks", _COSINE + " AND similarity >= 0.3", ("face_refs", "vectors"))
def _(inputs):
    hits = vectorindex.search(reference_queries(inputs), inputs.spark, _index(inputs), 20, 0.3, max_broadcast=0).rows
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("top_k_per_query", _COSINE.replace("rank <= 20", "rank <= 5"), ("face_refs", "vectors"))
def _(inputs):
    hits = V.cosine_topk(reference_queries(inputs), inputs.vectors, 5, None)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("min_score", """
    SELECT ref_id AS query_id, photo_id, round(list_dot_product(r.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM face_refs r, vectors v WHERE list_dot_product(r.embedding::DOUBLE[], v.embedding::DOUBLE[]) >= 0.25
""", ("face_refs", "vectors"))
def _(inputs):
    return V.scores_above(reference_queries(inputs), inputs.vectors, 0.25).withColumn("score", F.round("score", 6))


_PHRASES = f"""
    phrases AS (
        SELECT phrase_key, query_id, phrase_no, phrase, raw / sum(raw) OVER (PARTITION BY query_id) AS weight
        FROM (SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS phrase_key, conv_id AS query_id,
                     turn AS phrase_no, {expanded('text')} AS phrase,
                     CASE WHEN n >= 3 THEN 0.6::DOUBLE WHEN n = 2 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS raw
              FROM (SELECT *, len({S.blank_words('text')}) AS n FROM conversations)))"""


@query("multi_phrase_score", f"""
    WITH {_PHRASES}, {hashed('p', 'phrase_key', 'phrase', 'phrases')}, {hashed('e', 'photo_id', 'description', 'library')}
    SELECT query_id, photo_id, round(score, 5) AS score FROM (
        SELECT query_id, e.photo_id, sum(weight * list_dot_product(p.embedding, e.embedding)) AS score
        FROM phrases JOIN p USING (phrase_key), e GROUP BY query_id, e.photo_id) WHERE score >= 0.8
""", ("library",))
def _(inputs):
    phrases = inputs.conversations.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("phrase_no"), F.col("text").alias("phrase"),
        F.size(T.blank_split(F.col("text"))).alias("token_count"),
    )
    encoded = H.encoded_phrases(phrases)
    return V.multi_phrase_score(encoded, V.embed_text(inputs.library), 0.8).withColumn("score", F.round("score", 5))


@query("attach_embeddings", """
    SELECT photo_id, filename, model_name, CAST(len(embedding) AS INT) AS dim FROM library JOIN vectors USING (photo_id)
    WHERE model_name = 'driver-64'
""", ("library", "vectors"))
def _(inputs):
    met = V.attach_embeddings(inputs.library, inputs.vectors, "driver-64")
    return met.select("photo_id", "filename", F.lit("driver-64").alias("model_name"), F.size("embedding").alias("dim"))


@query("alignment_audit", """
    SELECT CASE WHEN v.photo_id IS NULL THEN 'no_embedding' WHEN l.photo_id IS NULL THEN 'no_photo'
                ELSE 'matched' END AS status, count(*) AS n
    FROM library l FULL JOIN vectors v ON l.photo_id = v.photo_id GROUP BY 1
""", ("library", "vectors"))
def _(inputs):
    return V.alignment_audit(inputs.library, inputs.vectors)


_DRIFT = """
    SELECT l.photo_id, l.filename, round(coalesce(s.similarity, 0), 6) AS similarity,
           CASE WHEN s.similarity IS NULL THEN 'NO_EMBEDDING' ELSE 'MISMATCH' END AS status
    FROM library l LEFT JOIN (
        SELECT v.photo_id, list_dot_product(v.embedding::DOUBLE[], f.embedding::DOUBLE[]) AS similarity
        FROM vectors v JOIN fresh_vectors f ON f.photo_id = v.photo_id) s ON s.photo_id = l.photo_id
    WHERE s.similarity IS NULL OR s.similarity < 0.9"""


@query("embedding_drift", _DRIFT, ("library", "vectors", "fresh_vectors"))
def _(inputs):
    drift = V.embedding_drift(inputs.library, inputs.vectors, inputs.fresh_vectors)
    return drift.withColumn("similarity", F.round("similarity", 6))


@query("verify_sample", """
    SELECT v.photo_id, round(list_dot_product(v.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS similarity,
           list_dot_product(v.embedding::DOUBLE[], f.embedding::DOUBLE[]) >= 0.999 AS verified
    FROM (SELECT * FROM vectors ORDER BY md5(concat(CAST(photo_id AS STRING), '#0')), photo_id LIMIT 50) v
    JOIN fresh_vectors f ON f.photo_id = v.photo_id
""", ("vectors", "fresh_vectors"))
def _(inputs):
    sample = V.verify_sample(inputs.vectors, inputs.fresh_vectors)
    return sample.withColumn("similarity", F.round("similarity", 6))


@query("repair_embeddings", f"""
    SELECT 'driver-64' AS model_name, count(*) AS num_embeddings, CAST(max(len(embedding)) AS INT) AS embedding_dim,
           true AS normalized, true AS repaired, (SELECT count(*) FROM ({_DRIFT})) AS previous_mismatches
    FROM fresh_vectors WHERE photo_id IN (SELECT photo_id FROM library)
""", ("library", "vectors", "fresh_vectors"))
def _(inputs):
    from pictorium.session import scratch_path

    return V.repair_embeddings(
        inputs.library, inputs.vectors, inputs.fresh_vectors, scratch_path(inputs.spark, "repaired"), "driver-64"
    )


@query("repair_library", f"""
    WITH {hashed('e', 'photo_id', 'description', 'library')}, b AS (
        SELECT photo_id, CASE WHEN photo_id % 7 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS old FROM e WHERE photo_id % 5 <> 0)
    SELECT 'hash-64' AS model_name, count(*) AS num_embeddings, CAST(max(len(embedding)) AS INT) AS embedding_dim, true AS normalized, true AS repaired,
           count(*) FILTER (WHERE old IS NULL OR list_dot_product(old, embedding) < 0.9) AS previous_mismatches
    FROM e LEFT JOIN b USING (photo_id)
""", ("library",))
def _(inputs):
    """Every fifth vector is missing and every seventh turned round; texts are encoded once for all of it."""
    store = encodings.EncodingStore(scratch_path(inputs.spark, "encodings"), "hash-64")
    turned = F.when(F.col("photo_id") % 7 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    old = store.vectors(inputs.library).filter("photo_id % 5 <> 0").withColumn("embedding", turned)
    return encodings.repair_library(inputs.library, old, scratch_path(inputs.spark, "repaired"), store)


# ---------------------------------------------------------------- annotated words


@query("noun_phrase_split", """
    WITH RECURSIVE a AS (
        SELECT photo_id, chunk, pos, token, upos,
               lead(upos) OVER (PARTITION BY photo_id, chunk ORDER BY pos) AS next_upos,
               min(pos) OVER (PARTITION BY photo_id, chunk) AS first_pos
        FROM annotations),
    walk AS (
        SELECT photo_id, chunk, pos, 0 AS part, upos = 'ADJ' AS seen,
               upos = 'NOUN' AND next_upos = 'NOUN' AND upos = 'ADJ' AS cut FROM a WHERE pos = first_pos
        UNION ALL
        SELECT a.photo_id, a.chunk, a.pos, w.part + CASE WHEN w.cut THEN 1 ELSE 0 END,
               (w.seen AND NOT w.cut) OR a.upos = 'ADJ',
               ((w.seen AND NOT w.cut) OR a.upos = 'ADJ') AND a.upos = 'NOUN' AND coalesce(a.next_upos = 'NOUN', false)
        FROM walk w JOIN a ON a.photo_id = w.photo_id AND a.chunk = w.chunk AND a.pos = w.pos + 1)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY token_count DESC, start) AS INT) AS phrase_no,
           phrase, CAST(token_count AS INT) AS token_count
    FROM (SELECT w.photo_id AS query_id, string_agg(a.token, ' ' ORDER BY a.pos) AS phrase, count(*) AS token_count,
                 min(a.pos) AS start
          FROM walk w JOIN a ON a.photo_id = w.photo_id AND a.pos = w.pos GROUP BY w.photo_id, w.chunk, w.part)
""", ("annotations",))
def _(inputs):
    return H.noun_phrase_split(inputs.annotations.withColumnRenamed("photo_id", "query_id"))


# The head of a word is the next one of its text (``head_pos`` is ``pos + 1``).
_PAIRS = """SELECT photo_id, pos, lower(token) AS adj, lower(head) AS noun
    FROM (SELECT photo_id, pos, token, dep, lead(token) OVER w AS head, lead(upos) OVER w AS head_upos FROM annotations
          WINDOW w AS (PARTITION BY photo_id ORDER BY pos)) p
    WHERE dep = 'amod' AND head_upos = 'NOUN'"""


@query("adj_noun_pairs", _PAIRS, ("annotations",))
def _(inputs):
    return H.adj_noun_pairs(inputs.annotations)


_WORDS3 = f"list_filter({S.blank_words('lower(query)')}, lambda w: length(w) >= 3)"
_RELATED = """(
    (starts_with(p.noun, w[-1]) AND len(list_filter(w[1:-2], lambda x: starts_with(p.adj, x))) > 0)
    OR (starts_with(p.noun, w[1]) AND len(list_filter(w[2:], lambda x: starts_with(p.adj, x))) > 0))"""

_PAIR_QUERIES = """pair_queries AS (
    SELECT query_id, query FROM search_queries UNION ALL SELECT 1000 + item_id, text FROM benchmark)"""


def pair_queries(inputs: Inputs) -> DataFrame:
    """The search queries, and every benchmark text as a further query."""
    texts = inputs.benchmark.select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query"))
    return inputs.search_queries.select(F.col("query_id").cast("long").alias("query_id"), "query").unionByName(texts)


@query("adj_noun_match", f"""
    WITH {_PAIR_QUERIES}, pairs AS ({_PAIRS})
    SELECT DISTINCT query_id, photo_id FROM (SELECT query_id, {_WORDS3} AS w FROM pair_queries) q, pairs p
    WHERE len(w) > 1 AND {_RELATED}
""", ("annotations", "search_queries"))
def _(inputs):
    return H.adj_noun_matches(pair_queries(inputs), H.adj_noun_pairs(inputs.annotations))


# ---------------------------------------------------------------- hybrid search


def _evidence(queries: str, pairs: str) -> str:
    """CTE ``evidence(query_id, photo_id, phrase_matched, word_matches, factor)`` over all pairs."""
    return f"""
    evidence AS (
        SELECT query_id, photo_id, phrase_matched, CAST(m AS INT) AS word_matches,
               CASE WHEN phrase_matched THEN 1.1::DOUBLE
                    WHEN m = n AND n > 0 AND (n = 1 OR EXISTS (
                        SELECT 1 FROM ({pairs}) p WHERE p.photo_id = x.photo_id AND {_RELATED})) THEN 1.1::DOUBLE
                    WHEN m = n AND n > 0 THEN 0.6::DOUBLE
                    WHEN m > 0 AND n > 1 THEN 1.0::DOUBLE - 0.5::DOUBLE * (1.0::DOUBLE - m::DOUBLE / n)
                    ELSE 1.0::DOUBLE END AS factor
        FROM (SELECT query_id, photo_id, w, len(w) AS n,
                     len(list_filter(w, lambda x: contains(lower(description), x))) AS m,
                     several AND contains(lower(description), whole) AS phrase_matched
              FROM (SELECT query_id, {_WORDS3} AS w, len({S.blank_words('query')}) > 1 AS several,
                           {S.strip('lower(query)')} AS whole FROM {queries}), library) x)"""


_NO_PAIRS = "SELECT CAST(NULL AS BIGINT) AS photo_id, '' AS adj, '' AS noun WHERE false"
_FACTORS = "SELECT query_id, photo_id, phrase_matched, word_matches, round(factor, 6) AS factor FROM evidence WHERE phrase_matched OR word_matches > 0"


@query("lexical_factor", f"WITH {_evidence('search_queries', _PAIRS)} {_FACTORS}",
       ("library", "annotations", "search_queries"))
def _(inputs):
    pairs = H.adj_noun_pairs(inputs.annotations)
    found = H.lexical_factors(inputs.search_queries, inputs.library, pairs)
    return found.withColumn("factor", F.round("factor", 6))


@query("lexical_factor_indexed", f"WITH {_evidence('search_queries', _NO_PAIRS)} {_FACTORS}",
       ("library", "search_queries"))
def _(inputs):
    found = H.lexical_factors(inputs.search_queries, inputs.library, max_literal=0)
    return found.withColumn("factor", F.round("factor", 6))


def _hybrid(queries: str, k: int, where: str = "true") -> str:
    return f"""
    asked AS (SELECT query_id, {expanded(S.strip('query'))} AS expanded FROM {queries}),
    {hashed('q', 'query_id', 'expanded', 'asked')}, {hashed('e', 'photo_id', 'description', 'library')},
    {_evidence(queries, _NO_PAIRS)},
    hits AS (
        SELECT query_id, photo_id, filename, phrase_matched, word_matches, similarity, semantic_score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, photo_id) AS INT) AS rank
        FROM (SELECT query_id, photo_id, filename, phrase_matched, word_matches, round(semantic * factor, 4) AS similarity,
                     round(semantic, 4) AS semantic_score
              FROM (SELECT q.query_id, e.photo_id, list_dot_product(q.embedding, e.embedding) AS semantic FROM q, e)
              JOIN evidence USING (query_id, photo_id) JOIN library USING (photo_id)
              WHERE semantic >= 0 AND {where})
        QUALIFY rank <= {k})"""


_HIT_COLUMNS = ["query_id", "rank", "photo_id", "filename", "similarity", "semantic_score", "phrase_matched", "word_matches"]


@query("hybrid_search", f"WITH {_hybrid('search_queries', 20)} SELECT {', '.join(_HIT_COLUMNS)} FROM hits",
       ("library", "search_queries"))
def _(inputs):
    hits = H.hybrid_search(inputs.search_queries, None, inputs.library, V.embed_text(inputs.library), top_k=20)
    return hits.select(*_HIT_COLUMNS)


@query("hybrid_search_threshold", f"WITH {_hybrid('search_queries', 20)} SELECT {', '.join(_HIT_COLUMNS)} FROM hits",
       ("library", "search_queries"))
def _(inputs):
    vectors = encodings.EncodingStore(scratch_path(inputs.spark, "encodings"), "hash-64").vectors(inputs.library)
    return thresholds.hybrid_search(inputs.search_queries, None, inputs.library, vectors, top_k=20).rows.select(*_HIT_COLUMNS)


@query("hybrid_search_filtered", f"""
    WITH {_hybrid('search_queries', 20, 'coalesce(has_characters, false) = true')}
    SELECT {', '.join(_HIT_COLUMNS)} FROM hits
""", ("library", "search_queries"))
def _(inputs):
    hits = H.hybrid_search(
        inputs.search_queries, None, inputs.library, V.embed_text(inputs.library), top_k=20, has_characters=True
    )
    return hits.select(*_HIT_COLUMNS)


_TEXT_QUERIES = "text_queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query("hybrid_search_batch", f"""
    WITH {_TEXT_QUERIES}, {_hybrid('text_queries', 10)} SELECT {', '.join(_HIT_COLUMNS)} FROM hits
""", ("library",))
def _(inputs):
    asked = inputs.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = H.hybrid_search(asked, None, inputs.library, V.embed_text(inputs.library), top_k=10)
    return hits.select(*_HIT_COLUMNS)


@query("search_summary", f"""
    WITH {_hybrid('search_queries', 50)}
    SELECT query_id, CAST(count(*) AS INT) AS results_count, round(max(similarity), 4) AS top_score,
           round(avg(similarity) FILTER (WHERE rank <= 3), 4) AS top_3_avg FROM hits GROUP BY query_id
""", ("library", "search_queries"))
def _(inputs):
    hits = H.hybrid_search(inputs.search_queries, None, inputs.library, V.embed_text(inputs.library), top_k=50)
    return H.search_summary(hits)
