"""Table operators against brute force on small tables."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.functions import kernels
from pictorium.operators import catalog as C
from pictorium.operators import encodings
from pictorium.operators import faces as FA
from pictorium.operators import hybrid as H
from pictorium.operators import keyword as KW
from pictorium.operators import modelout as M
from pictorium.operators import ordering as O
from pictorium.operators import querylog as Q
from pictorium.operators import thresholds
from pictorium.operators import vectors as V


# ---------------------------------------------------------------- ordering


@pytest.mark.parametrize("range_rows", [7, 1_000_000])
def test_numbered_is_exact_with_one_hot_group(spark, range_rows):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.choice([None, 1, 2, 3]), i) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int, id long")
    for ascending in (True, False):
        got = O.numbered(df, [("v", ascending), ("id", True)], ("g",), "n", range_rows).collect()
        for group in {r[0] for r in rows}:
            def key(r):
                v = r[1]
                return (v is None, (v if ascending else -v) if v is not None else 0, r[2])
            want = {r[2]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == group), key=key))}
            assert {r["id"]: r["n"] for r in got if r["g"] == group} == want


def test_deep_page_equals_top_page(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").alias("photo_id"))
    near = [r[0] for r in O.page(df, [("photo_id", False)], 10, 20).collect()]
    monkeypatch.setattr(O, "MAX_TOP_ROWS", 5)
    deep = [r[0] for r in O.page(df, [("photo_id", False)], 10, 20).collect()]
    assert near == deep == list(range(79, 69, -1))


# ---------------------------------------------------------------- names


def unique_names(names, taken=()):
    """The rule, one file after the other, with every name in use reserved."""
    reserved, used, out = set(names) | set(taken), set(taken), []
    for name in names:
        target = name
        if target in used:
            stem, dot, suffix = name.rpartition(".")
            n = 1
            while f"{stem}_{n}{dot}{suffix}" in reserved | used:
                n += 1
            target = f"{stem}_{n}{dot}{suffix}"
        used.add(target)
        out.append(target)
    return out


@pytest.mark.parametrize(
    "names, taken",
    [
        (["a.jpg"] * 3, []),
        (["a.jpg", "a.jpg"], ["a_1.jpg"]),
        (["a.jpg", "a.jpg", "a_1.jpg", "a_3.jpg", "a.jpg", "b.png", "a.jpg"], []),
        (["a.jpg"] * 12 + ["a_2.jpg", "a_3.jpg", "a_7.jpg"], ["a.jpg", "a_5.jpg"]),
        (["x.y.jpg", "x.y.jpg", "x_01.jpg", "x.jpg", "x.jpg"], ["x_1.jpg"]),
    ],
)
@pytest.mark.parametrize("range_rows", [3, None])
def test_assign_unique_names(spark, names, taken, range_rows):
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "path_id int, name string")
    known = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    got = C.assign_unique_names(files, known, "path_id", range_rows).orderBy("path_id").collect()
    assert [r["target"] for r in got] == unique_names(names, taken)


# ---------------------------------------------------------------- keyword search


TEXTS = (
    "A red dog and a black cat sit near the old house",
    "The hair of the woman is red; a dog runs",
    "Red hair, red HAIR everywhere. Hairy dogs like order",
    "nothing here",
    "été à la plage, les chiens jouent dans l'eau près du chien",
    "dog",
)
QUERIES = ("red dog", "dog or cat", "red hair and dog", "red and cat or order", "chien", "of", "a", "me", "  ", "red dog cat", "İ")


def test_both_search_paths_agree_and_keep_blank_and_face_queries_out(spark, library, queries):
    def run(limit):
        hits = KW.keyword_search(queries(*QUERIES), library(*TEXTS), max_literal=limit)
        return {(r["query_id"], r["photo_id"]): r["matches"] for r in hits.collect()}

    scan, indexed = run(2_000), run(0)
    assert scan == indexed
    found = {}
    for q, p in scan:
        found.setdefault(QUERIES[q], set()).add(p)
    assert found["dog or cat"] == {0, 1, 2, 5}
    assert found["red dog"] == {0, 1}
    assert found["red hair and dog"] == {2}
    assert found["red and cat or order"] == {0, 2}
    assert found["chien"] == {4}
    assert found["of"] == {1}
    assert "me" not in found and "  " not in found
    assert scan[(QUERIES.index("red and cat or order"), 0)] == {
        "red": ["A **red** dog and a black cat"], "cat": ["and a black **cat** sit near the"],
    }


def test_keyword_properties(spark, library, queries):
    """AND lies within each item, OR is the union of its groups."""
    lib = library(*TEXTS)

    def ids(q):
        return {r["photo_id"] for r in KW.keyword_search(queries(q), lib).collect()}

    assert ids("red and dog") == ids("red") & ids("dog")
    assert ids("cat or chien") == ids("cat") | ids("chien")


def test_search_for_known_faces(spark, library, queries):
    lib = library("one", "two", "three")
    face = "struct<has_faces:boolean,face_count:bigint,has_known_faces:boolean,known_faces:array<struct<match_confidence:double,reference_image:string,distance:double>>>"
    rows = [(0, (True, 2, True, [(0.875, "r.jpg", 0.25)])), (1, (False, 0, False, []))]
    faces = spark.createDataFrame(rows, f"photo_id long, face {face}")
    got = KW.keyword_search(queries("ME ", "two", "me"), lib, faces=faces).collect()
    assert {(r["query_id"], r["photo_id"]) for r in got} == {(0, 0), (1, 1), (2, 0)}
    assert next(r for r in got if r["query_id"] == 0)["matches"] == {
        "Face Recognition": ["Match: 87.5% confidence (ref: r.jpg)"]
    }
    ranked = FA.known_face_ranking(lib, faces).collect()
    assert [(r["photo_id"], r["rank"], r["similarity"]) for r in ranked] == [(0, 1, 1.0)]


def test_substring_match_equals_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {tuple(r) for r in KW.substring_match(t, w).select("term", "word").collect()}
    assert got == {(a, b) for a in terms for b in words if a in b}
    strict = {tuple(r) for r in KW.term_match(t, w).select("term", "word").collect()}
    assert strict == {(a, b) for a in terms for b in words if a == b or (len(a) >= 3 and a in b)}


@pytest.mark.parametrize("limit", [2_000, 0])
def test_word_proximity_paths(spark, library, queries, limit):
    lib = library("vibrant pink hair", "dark brown hair and a long grey pink shirt", "hairpink")
    got = KW.word_proximity(queries("pink hair", "pink"), lib, max_literal=limit).collect()
    assert {tuple(r) for r in got} == {(0, 0), (0, 2)}


# ---------------------------------------------------------------- vectors


def unit_rows(n, dim, seed):
    rows = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("limit", [100, 0])
def test_topk_equals_full_sort(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "CORPUS_BLOCK", 20)
    rows, asked = unit_rows(70, 8, 1), unit_rows(7, 8, 2)
    rows[10] = rows[3]
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "photo_id long, embedding array<double>")
    corpus = corpus.repartition(5)
    queries = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(asked)], "query_id string, embedding array<double>")
    got = V.cosine_topk(queries, corpus, 6, 0.2, max_broadcast=limit).collect()
    want = set()
    for q, a in enumerate(asked):
        scores = kernels.ordered_dots(rows, np.broadcast_to(a, rows.shape))
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:6]
        want |= {(f"q{q}", rank + 1, i, scores[i]) for rank, i in enumerate(order) if scores[i] >= 0.2}
    assert {tuple(r) for r in got} == want
    above = V.scores_above(queries, corpus, 0.3, max_broadcast=limit).collect()
    assert len(above) == int((rows @ asked.T >= 0.3).sum())


def test_rows_of_a_large_table_are_numbered_in_several_tasks(spark):
    """Rows may carry whole texts: a table under a million rows is no single task."""
    rows = spark.range(120_000, numPartitions=6).select(F.pmod(F.col("id") * 7919, F.lit(120_000)).alias("id"), F.lit("text").alias("text"))
    got = O.numbered(rows, [("id", True)], name="n")
    assert len(O._bounds(rows, [("id", True)], 120_000, O.RANGE_ROWS)) == 2
    assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter(F.col("n") != F.col("id") + 1).count() == 0 and got.count() == 120_000


def test_scores_above_hold_few_pairs_at_a_time(spark, monkeypatch):
    rows, asked = unit_rows(300, 8, 5), unit_rows(40, 8, 6)
    monkeypatch.setattr(kernels, "MAX_CELLS", 400)
    monkeypatch.setattr(kernels, "MAX_PAIRS", 7)
    parts = list(kernels.pairs_above(np.arange(300) + 5, rows, asked, 0.1))
    assert len(parts) > 300 * 40 // 400 and max(len(q) for q, _, _ in parts) <= 7
    r, q = np.nonzero(rows @ asked.T >= 0.1)
    assert sorted((a, b) for part in parts for a, b in zip(part[0].tolist(), part[1].tolist())) == sorted(zip(q.tolist(), (r + 5).tolist()))
    assert list(kernels.pairs_above(np.arange(0), rows[:0], asked, 0.1)) == []


@pytest.mark.parametrize("sizes", [(3, 20), (100, 1000)])
def test_scores_above_in_blocks_meet_every_pair(spark, monkeypatch, sizes):
    monkeypatch.setattr(V, "PAIR_BLOCK", sizes)
    rows, asked = unit_rows(70, 8, 1), unit_rows(7, 8, 2)
    corpus = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] * 2, "photo_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(asked)] + [(None, asked[0].tolist())], "query_id string, embedding array<double>")
    few, many = (sorted(map(str, V.scores_above(queries, corpus, 0.3, max_broadcast=n).collect())) for n in (100, 0))
    assert few == many and len(few) == 2 * int((rows @ np.vstack([asked, asked[:1]]).T >= 0.3).sum())


@pytest.mark.parametrize("limit", [100, 0])
def test_nearest_reference_takes_the_first_on_ties(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "CORPUS_BLOCK", 4)
    refs = unit_rows(5, 6, 3)
    refs[4] = refs[1]
    faces = np.vstack([refs[1] * 3.0, unit_rows(9, 6, 4)])
    r = spark.createDataFrame([(i, f"r{i}.jpg", v.tolist()) for i, v in enumerate(refs)], "ref_id long, ref_name string, embedding array<double>")
    f = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(faces)], "photo_id long, face_no int, embedding array<double>")
    got = {(x["photo_id"], x["face_no"]): x for x in V.nearest_reference(f, r, 0.4, max_broadcast=limit).collect()}
    assert len(got) == len(faces)
    for i, v in enumerate(faces):
        distance = 1 - refs @ v / (np.linalg.norm(refs, axis=1) * np.linalg.norm(v))
        row = got[(i // 2, i % 2)]
        assert row["ref_id"] == int(np.argmin(np.round(distance, 12)))
        assert row["distance"] == pytest.approx(distance.min(), abs=1e-12)
        assert row["matched"] == (distance.min() < 0.4)
    assert got[(0, 0)]["match_confidence"] == pytest.approx(1.0)


def test_match_faces_rolls_up_in_face_order(spark):
    refs = spark.createDataFrame([(0, "r0.jpg", [1.0, 0.0]), (1, "r1.jpg", [0.0, 1.0])], "ref_id long, ref_name string, embedding array<double>")
    faces = spark.createDataFrame(
        [(1, 1, [1.0, 0.0]), (1, 0, [0.0, 2.0]), (1, 2, [-1.0, -1.0]), (2, 0, [-1.0, -1.0])],
        "photo_id long, face_no int, embedding array<double>",
    )
    photos = spark.createDataFrame([(1,), (2,), (3,)], "photo_id long")
    got = {r["photo_id"]: r["face"] for r in FA.match_faces(photos, faces, refs).collect()}
    assert [k["reference_image"] for k in got[1]["known_faces"]] == ["r1.jpg", "r0.jpg"]
    assert (got[1]["has_faces"], got[1]["face_count"], got[1]["has_known_faces"]) == (True, 3, True)
    assert (got[2]["has_faces"], got[2]["face_count"], got[2]["has_known_faces"]) == (True, 1, False)
    assert (got[3]["has_faces"], got[3]["face_count"], got[3]["known_faces"]) == (False, 0, [])


def test_embed_text_with_an_injected_encoder(spark, library):
    def encoder(texts):
        assert len(texts) <= V.ENCODE_BATCH
        return np.array([[len(t), 1.0] for t in texts])

    got = V.embed_text(library("abc", ""), encoder=encoder).orderBy("photo_id").collect()
    assert got[0]["embedding"] == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])
    assert got[1]["embedding"] == [0.0, 1.0]


def test_combine_phrases_over_many_spans(spark):
    rows = [(1, n, 0.5, [float(n), 1.0]) for n in (1, 2, 2_000, 3_000_000)] + [(2, 1, 1.0, [3.0, 4.0])]
    phrases = spark.createDataFrame(rows, "query_id int, phrase_no long, weight double, embedding array<double>")
    got = {r["query_id"]: r["embedding"] for r in V.combine_phrases(phrases).collect()}
    assert got == {1: [0.5 * 3_002_003, 2.0], 2: [3.0, 4.0]}


def test_repair_writes_only_when_vectors_have_drifted(spark, library, tmp_path):
    lib = library("a", "b", "c")
    make = lambda rows: spark.createDataFrame(rows, "photo_id long, model_name string, embedding array<double>")
    fresh = make([(0, "m", [1.0, 0.0]), (1, "m", [0.0, 1.0]), (2, "m", [0.6, 0.8])])
    same = V.repair_embeddings(lib, fresh, fresh, str(tmp_path / "same"), "m").first()
    assert (same["repaired"], same["previous_mismatches"]) == (False, 0)
    assert not (tmp_path / "same").exists()
    stored = make([(0, "m", [1.0, 0.0]), (1, "m", [1.0, 0.0])])
    fixed = V.repair_embeddings(lib, stored, fresh, str(tmp_path / "new"), "m").first()
    assert (fixed["repaired"], fixed["previous_mismatches"], fixed["num_embeddings"]) == (True, 2, 3)


def test_every_text_is_encoded_once(spark, library, tmp_path):
    log = tmp_path / "encoded"
    log.mkdir()

    def encoder(texts):
        with open(log / f"{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write("".join(t + "\n" for t in texts))
        return np.array([[float(len(t)) + 1, 1.0] for t in texts])

    seen = lambda: sorted(line for file in log.iterdir() for line in file.read_text("utf-8").splitlines())
    lib = library("one", "two", "one", "three", None, "", "été").repartition(4)
    store = encodings.EncodingStore(str(tmp_path / "store"), "m", encoder)
    old = spark.createDataFrame([(0, "m", [0.0, 1.0]), (0, "other", [1.0, 0.0])], "photo_id long, model_name string, embedding array<double>")
    fixed = encodings.repair_library(lib, old, str(tmp_path / "new"), store).first()
    # Photo 0 is near enough to no stored vector, all others have none.
    assert (fixed["repaired"], fixed["num_embeddings"], fixed["previous_mismatches"]) == (True, 7, 7)
    assert seen() == ["", "one", "three", "two", "été"]
    again = encodings.repair_library(lib, spark.read.parquet(str(tmp_path / "new")), str(tmp_path / "unused"), store).first()
    assert (again["repaired"], again["previous_mismatches"]) == (False, 0) and len(seen()) == 5
    more = library("four", "one")
    assert store.add(more) == 1 and sorted(r.photo_id for r in store.vectors(more).collect()) == [0, 1] and len(seen()) == 6


# ---------------------------------------------------------------- hybrid search


WORDS = ["red", "dog", "hair", "old", "house", "carpet", "à", "it", "longword" * 40]


@pytest.mark.parametrize("few, matcher, known", [(48, True, 2_048), (0, True, 2_048), (0, False, 2_048), (48, True, 0)])
def test_hybrid_search_equals_brute_force(spark, library, queries, monkeypatch, few, matcher, known):
    monkeypatch.setattr(H, "FEW_TERMS", few)
    if not matcher:
        monkeypatch.setattr(kernels, "ahocorasick", None)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    asked = ["red dog", "hair", "old house red", "it à", "ongword", "dog dog", "it"]
    lib, qs = library(*texts), queries(*asked)
    vectors = V.embed_text(lib)
    pairs = spark.createDataFrame([(0, "red", "dogs"), (3, "old", "house")], "photo_id long, adj string, noun string")
    found_pairs = {0: [("red", "dogs")], 3: [("old", "house")]}
    got = H.hybrid_search(qs, None, lib, vectors, pairs, top_k=5, max_queries=known).collect()

    stored = {r["photo_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    encoded = {r["query_id"]: np.array(r["embedding"]) for r in H.query_vectors(H.whole_query_phrases(qs)).collect()}

    def related(words, pid):
        for adj, noun in found_pairs.get(pid, []):
            if any(adj.startswith(w) for w in words[:-1]) and noun.startswith(words[-1]):
                return True
            if any(adj.startswith(w) for w in words[1:]) and noun.startswith(words[0]):
                return True
        return False

    want = set()
    for q, query in enumerate(asked):
        words = [w for w in query.split() if len(w) >= 3]
        hits = []
        for p, text in enumerate(texts):
            semantic = kernels.ordered_dots(stored[p][None], encoded[q][None])[0]
            if semantic < 0:
                continue
            m, n = sum(w in text for w in words), len(words)
            phrase = len(query.split()) > 1 and query in text
            if phrase:
                factor = 1.10
            elif n and m == n:
                factor = 1.10 if n == 1 or related(words, p) else 0.60
            elif m and n > 1:
                factor = 1.0 - 0.5 * (1.0 - m / n)
            else:
                factor = 1.0
            hits.append((-round(semantic * factor, 4), p, phrase, m))
        for rank, (score, p, phrase, m) in enumerate(sorted(hits)[:5], start=1):
            want.add((q, rank, p, -score, phrase, m))
    assert {
        (r["query_id"], r["rank"], r["photo_id"], r["similarity"], r["phrase_matched"], r["word_matches"]) for r in got
    } == want


@pytest.mark.parametrize("top_k, min_score, known", [(5, 0.0, 2_048), (3, None, 2_048), (5, 0.5, 2_048), (200, 0.0, 2_048), (5, 0.0, 0)])
def test_threshold_search_gives_the_same_rows(spark, library, queries, tmp_path, top_k, min_score, known):
    rng = random.Random(top_k)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    # Vectors of their own, near a few of the queries; some negative, some missing.
    chosen = np.random.default_rng(5)
    vectors = chosen.normal(size=(150, 64)) * 0.1
    lib = library(*texts).withColumn("has_dogs", F.col("photo_id") % 3 != 0)
    qs = queries("red dog", "hair", "old house red", "" if top_k == 200 else "carpet", "dog dog")
    asked = {r["query_id"]: np.array(r["embedding"]) for r in H.query_vectors(H.whole_query_phrases(qs)).collect()}
    for i in range(150):
        vectors[i] += list(asked.values())[i % len(asked)] * (1.2 if i % 2 == 0 else 0.1)
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors) if i % 17], "photo_id long, embedding array<double>")
    pairs = spark.createDataFrame([(0, "red", "dogs"), (10, "old", "house")], "photo_id long, adj string, noun string")
    options = dict(top_k=top_k, min_score=min_score, max_queries=known, has_dogs=True)
    found = thresholds.hybrid_search(qs, None, lib, stored, pairs, **options)
    wanted = H.hybrid_search(qs, None, lib, stored, pairs, **options)
    order = ("query_id", "rank")
    assert found.rows.orderBy(*order).collect() == wanted.orderBy(*order).collect()
    read = found.read.count()
    assert (0 < read < 70 if top_k < 200 and known else read <= 100), read


def test_noun_phrases(spark):
    def sizes(classes):
        rows = [(1, 0, i, f"t{i}", c) for i, c in enumerate(classes.split())]
        df = spark.createDataFrame(rows, "query_id int, chunk int, pos int, token string, upos string")
        got = H.noun_phrase_split(df).orderBy("phrase_no").collect()
        return [r["token_count"] for r in got]

    assert sizes("ADJ ADJ NOUN NOUN") == [3, 1]
    assert sizes("NOUN NOUN") == [2]
    assert sizes("ADJ NOUN NOUN NOUN") == [2, 2]
    assert sizes("ADJ NOUN NOUN ADJ NOUN NOUN") == [3, 2, 1]


def test_queries_without_chunks_are_their_own_phrase(spark, queries):
    rows = [(0, 0, 0, "red", "ADJ"), (0, 0, 1, "hair", "NOUN")]
    df = spark.createDataFrame(rows, "query_id int, chunk int, pos int, token string, upos string")
    got = H.phrase_weights(H.noun_phrase_split(df, queries("red hair", " at home "))).collect()
    assert {(r["query_id"], r["phrase"], r["token_count"], r["weight"]) for r in got} == {
        (0, "red hair", 2, 1.0), (1, "at home", 2, 1.0),
    }


def test_phrase_weights(spark):
    rows = [(1, 1, 3), (1, 2, 1), (2, 1, 2), (3, 1, 3), (3, 2, 2), (3, 3, 1)]
    df = spark.createDataFrame(rows, "query_id int, phrase_no int, token_count int")
    got = {(r["query_id"], r["phrase_no"]): r["weight"] for r in H.phrase_weights(df).collect()}
    want = {(1, 1): 0.75, (1, 2): 0.25, (2, 1): 1.0, (3, 1): 6 / 11, (3, 2): 3 / 11, (3, 3): 2 / 11}
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- catalogue


def test_merge_and_delete_keep_the_rest(spark, library):
    lib = library("one.", "two", "three")
    new = spark.createDataFrame([(1, "Two."), (2, "")], "photo_id long, new_description string")
    got = {r["photo_id"]: (r["description"], r["updated"]) for r in C.merge_descriptions(lib, new).collect()}
    assert got == {0: ("one.", False), 1: ("Two.", True), 2: ("three", False)}

    vectors = lib.select("photo_id", F.array(F.lit(1.0)).alias("embedding"))
    added = spark.createDataFrame([(9, "new.jpg", "x", "/n")], lib.schema)
    grown = C.append_photos(lib, added)
    kept, rest = C.delete_photos(grown, C.append_photos(vectors, added.select("photo_id")), added.select("filename"))
    assert sorted(kept.collect()) == sorted(lib.collect())
    assert sorted(r["photo_id"] for r in rest.collect()) == [0, 1, 2]
    assert C.append_photos(lib, lib).count() == 3


def test_flag_filter_counts_missing_as_false(spark):
    lib = spark.createDataFrame([(1, True), (2, False), (3, None)], "photo_id long, has_dogs boolean")
    assert {r[0] for r in C.flag_filter(lib, has_dogs=False).collect()} == {2, 3}
    assert {r[0] for r in C.flag_filter(lib, has_dogs=True).collect()} == {1}
    assert C.flag_filter(lib).count() == 3


def test_regenerate_queue_drops_missing_files(spark, library):
    lib = library("open", "done.", "also open")
    existing = spark.createDataFrame([("/photos/p2.jpg",)], "full_path string")
    assert [r["photo_id"] for r in C.regenerate_queue(lib, existing).collect()] == [2]


def test_problematic_queries_and_log_entries(spark, queries):
    rows = [(1, "a", "x", 0.2), (2, "a", None, 0.4), (3, "b", None, 0.1), (4, "c", None, 0.9), (5, "c", "x", 0.8)]
    log = spark.createDataFrame(rows, "seq long, query string, expanded_query string, top_score double")
    got = [tuple(r) for r in Q.problematic_queries(log).collect()]
    assert got == [("a", 2, 0.3, True)]
    assert [r["seq"] for r in Q.recent_searches(log, 2).collect()] == [4, 5]

    summary = spark.createDataFrame([(0, 3, 0.5, 0.4)], "query_id int, results_count int, top_score double, top_3_avg double")
    asked = queries("red", "none")
    assert Q.log_entries(summary, asked).count() == 1
    every = {r["query"]: r["results_count"] for r in Q.log_entries(summary, asked, keep_empty=True).collect()}
    assert every == {"red": 3, "none": 0}


# ---------------------------------------------------------------- model answers


CLEAN = '{"has_characters": true, "characters": [{"type": "man", "count": 2}], "has_dogs": false, "dogs": [], "has_cars": false, "cars": []}'


@pytest.mark.parametrize(
    "response, outcome, flags",
    [
        (CLEAN, "parsed", (True, False, False)),
        (f"Sure! {CLEAN} Done.", "parsed", (True, False, False)),
        (CLEAN[: CLEAN.index(', "cars"')], "repaired", (True, False, False)),
        ("I cannot tell.", "no_json", (False, False, False)),
        ('{"has_characters": false, "has_dogs": true, "dogs": [{"type": "puppy", "count": 1}', "repaired", (False, True, False)),
        ('{"has_characters": false, "has_dogs": true, "dogs": [{"type": "puppy", "count": 1}]', "repaired", (False, True, False)),
        ('{"has_characters": true, "has_dogs": true', "no_json", (False, False, False)),
        ('{"has_characters": true, "characters": [{}], oops', "unreadable", (False, False, False)),
    ],
)
def test_repair_json(spark, response, outcome, flags):
    df = spark.createDataFrame([(1, response)], "photo_id long, response string")
    row = M.repair_json(df).first()
    assert row["outcome"] == outcome
    assert tuple(bool(row["flags"][f]) for f in C.FLAGS) == flags


def test_best_candidate_and_continuation(spark):
    tries = {
        1: ["a b", "done.", "longer but open"], 2: ["abc", "abcd", "wxyz"], 3: ["", " ", None], 4: ["x. ", "y."],
    }
    rows = [(p, i, t) for p, ts in tries.items() for i, t in enumerate(ts)]
    best = M.best_candidate(spark.createDataFrame(rows, "photo_id long, candidate_idx long, text string"))
    assert {r["photo_id"]: r["best"] for r in best.collect()} == {1: "done.", 2: "abcd", 3: "", 4: "x."}
    more = spark.createDataFrame([(1, "much longer text"), (2, " abcdef "), (3, "text")], "photo_id long, continuation string")
    got = {r["photo_id"]: r["description"] for r in M.continue_candidate(best, more).collect()}
    assert got == {1: "done.", 2: "abcdef", 3: "", 4: "x."}


def test_run_model_goes_on_after_errors(spark):
    def load():
        def model(rows):
            if (rows["v"] < 0).any():
                raise ValueError("negative")
            return {"double": rows["v"] * 2}

        return model

    df = spark.createDataFrame([(i, i if i != 3 else -1) for i in range(6)], "id long, v long").coalesce(1)
    got = {r["id"]: (r["double"], r["status"]) for r in M.run_model(df, load, "double long", ("id",), batch=4).collect()}
    assert got[3] == (None, "error")
    assert {i: v for i, v in got.items() if i != 3} == {i: (2 * i, "ok") for i in (0, 1, 2, 4, 5)}


@pytest.mark.parametrize("limit", [0, 100])
def test_every_face_counts(spark, limit):
    faces = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0, 0.0]), (2, 0, None), (3, 0, [0.0, 0.0]), (4, 0, [0.0, 1.0])],
        "photo_id long, face_no int, embedding array<float>",
    )
    refs = spark.createDataFrame([(7, "r7", [2.0, 0.0]), (8, "r8", [0.0, 0.0])], "ref_id long, ref_name string, embedding array<float>")
    photos = spark.createDataFrame([(i,) for i in range(1, 6)], "photo_id long")
    found = {(r["photo_id"], r["face_no"]): r for r in V.nearest_reference(faces, refs, 0.4, limit).collect()}
    assert len(found) == 5 and found[1, 0]["ref_name"] == "r7" and found[1, 0]["matched"]
    assert [found[k]["ref_id"] for k in ((1, 1), (2, 0), (3, 0))] == [None] * 3 and not found[4, 0]["matched"]
    rolled = {r["photo_id"]: r["face"] for r in FA.match_faces(photos, faces, refs, 0.4, limit).collect()}
    assert [rolled[i]["face_count"] for i in range(1, 6)] == [2, 1, 1, 1, 0]
    assert [rolled[i]["has_known_faces"] for i in range(1, 6)] == [True, False, False, False, False]
    with pytest.raises(ValueError, match="no reference faces"):
        V.nearest_reference(faces, refs.limit(0), 0.4, limit)


@pytest.mark.parametrize("limit", [0, 1, 100])
def test_query_vectors_of_several_sizes_raise_at_every_bound(spark, limit):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])], "query_id int, embedding array<float>")
    with pytest.raises(ValueError, match="several sizes"):
        V.asking_side(asked, limit)


@pytest.mark.parametrize("max_queries", [0, 64])
def test_null_and_phraseless_queries_find_nothing_at_every_bound(spark, library, max_queries):
    photos = library("red dog runs", "blue car")
    vectors = V.hash_embed(photos, "photo_id", "description").withColumn("model_name", F.lit("m"))
    asked = spark.createDataFrame([(1, "red dog"), (2, None), (3, "blue car")], "query_id int, query string")
    phrases = spark.createDataFrame([(1, 0, "red dog", 2), (2, 0, "x", 1)], "query_id int, phrase_no int, phrase string, token_count int")
    found = H.hybrid_search(asked, phrases, photos, vectors, max_queries=max_queries).collect()
    assert {r["query_id"] for r in found} == {1} and found[0]["description"] == "red dog runs"
    whole = H.hybrid_search(asked, None, photos, vectors, max_queries=max_queries).collect()
    assert {r["query_id"] for r in whole} == {1, 3}
    both = vectors.union(vectors.withColumn("model_name", F.lit("n")))
    with pytest.raises(ValueError, match="several models"):
        H.hybrid_search(asked, None, photos, both, max_queries=max_queries)
    named = H.hybrid_search(asked, None, photos, both, max_queries=max_queries, model_name="n").collect()
    assert sorted((r["query_id"], r["photo_id"], r["rank"]) for r in named) == sorted((r["query_id"], r["photo_id"], r["rank"]) for r in whole)
