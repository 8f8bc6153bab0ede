"""Keyword search through the stored index against the scan of all texts."""

import random

from pyspark.sql import functions as F

from pictorium.operators import keyword as KW
from pictorium.operators import keywordindex as X

WORDS = ["red", "Dog", "dogs", "hair", "redhead", "it", "a", "à", "Été", "house", "the", "the", "the"]
QUERIES = [
    "dog", "it", "red hair", "the the", "red dog house", "the a it", "dog and red hair", "dog or hair and it", "zebra or dog", "zebra and dog",
    "dog dog", "red red dog", "à", "me", "  ", "house and the red or it a",
]


def rows(df):
    return sorted((r.query_id, r.photo_id, r.filename, r.full_path, r.description_length, r.word_count, str(sorted(r.matches.items()))) for r in df.collect())


def test_stored_index_gives_the_rows_of_the_scan(spark, library, queries, tmp_path):
    chosen = random.Random(2)
    texts = [" ".join(chosen.choice(WORDS) for _ in range(chosen.randint(0, 25))) for _ in range(120)] + [None, "", "the " * 3000 + "dog", "red" + " x" * 9 + " hair"]
    lib = library(*texts)
    path = str(tmp_path / "index")
    for part in range(3):
        assert X.add(lib.filter(F.col("photo_id") % 3 == part).repartition(3), path) == part
    for distance in (0, 1, 3, 10):
        asked = queries(*QUERIES)
        assert rows(X.keyword_search(asked, lib, path, distance)) == rows(KW.keyword_search(asked, lib, distance))


def test_positions_are_read_back(spark, library, tmp_path):
    path = str(tmp_path / "index")
    X.add(library("b a b " + "c " * 500 + "b", "c"), path)
    postings, words = X._tables(spark, path)
    got = {(r.word, r.photo_id): r.at for r in postings.select("word", "photo_id", X._positions(F.col("steps")).alias("at")).collect()}
    assert got == {("a", 0): [1], ("b", 0): [0, 2, 503], ("c", 0): list(range(3, 503)), ("c", 1): [0]}
    assert {(r.word, r.n) for r in words.collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_texts_are_read_for_hits_only(spark, library, queries, tmp_path):
    path = str(tmp_path / "index")
    lib = library("red dog", "cat")
    assert X.matching_groups(queries("dog"), spark, path).collect() == []
    X.add(lib, path)
    plan = X.matching_groups(queries("red dog"), spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "regexp_extract_all" not in plan
    assert [tuple(r) for r in X.matching_groups(queries("red dog", "cat or dog"), spark, path).orderBy("query_id", "photo_id").collect()] == [(0, 0, 0), (1, 0, 1), (1, 1, 0)]


def test_texts_are_split_once_and_after_the_shuffle(spark, library, queries, tmp_path):
    path = str(tmp_path / "index")
    lib = library("red dog house", "cat", "the red hair")
    X.add(lib, path)
    asked = queries("red dog", "house or hair")
    for found in (X.keyword_search(asked, lib, path), KW.keyword_search(asked, lib, max_literal=0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        splits = [line for line in plan.splitlines() if "regexp_extract_all" in line]
        assert len(splits) == 1 and plan.index(splits[0]) < plan.index("Join")


def test_repeated_ids_and_queries_give_the_rows_of_the_scan(spark, library, queries):
    lib = library("red dog", "red hair", None).unionByName(library("red dog house", "x"))
    asked = queries("red dog", "hair or dog", "  ").unionByName(queries("house", "red"))
    assert rows(KW.keyword_search(asked, lib, max_literal=0)) == rows(KW.keyword_search(asked, lib))


def test_postings_of_bounded_slices(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(X, "SLICE_WORDS", 3)
    texts = [["b", "a", "b"], [], ["c"], ["a"] * 5, ["b", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, None, 9, 1, 2], pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["photo_id", "lowered"])
    for whole in (batch, batch.slice(1), batch.slice(1, 1)):
        found = [r for b in X._postings(iter([whole])) for r in b.to_pylist()]
        wanted = {}
        for photo_id, words in zip(*(c.to_pylist() for c in whole.columns)):
            for pos, word in enumerate(words):
                wanted.setdefault((word, photo_id), []).append(pos)
        assert {(r["word"], r["photo_id"]): np.cumsum(r["steps"]).tolist() for r in found} == wanted and len(found) == len(wanted)
