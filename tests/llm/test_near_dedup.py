import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import near_dedup, shingles
from pictorium.llm.components import components, stars

from .samples import prose


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows, percent):
    """Component of every row by comparing all texts."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_copies(seed, copies, size, rate):
    chosen = random.Random(seed)
    base = prose(seed, size).split(" ")
    return [" ".join(w if chosen.random() > rate else prose(1000 * seed + 10 * i + k, 1) for k, w in enumerate(base)) for i in range(copies)]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_comparing_all(documents, odd_documents, percent):
    texts = near_copies(1, 60, 150, 0.02) + near_copies(2, 40, 60, 0.03) + near_copies(3, 30, 300, 0.005) + [prose(9, n) for n in range(30)]
    rows = [(100 + 7 * i % 1000, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd_documents.collect()]
    found = near_dedup.near_duplicates(documents(*rows), percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, percent)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_small_blocks_lose_no_pair(documents, monkeypatch):
    rows = list(enumerate(near_copies(4, 80, 120, 0.03)))
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    found = near_dedup.near_duplicates(documents(*rows), 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, 85)


def test_one_of_each_group_stays(documents, odd_documents):
    rows = list(enumerate(near_copies(5, 20, 200, 0.0) + [prose(77, 50)], 50))
    left = near_dedup.keep_one(documents(*rows), 80)
    assert sorted(r.doc_id for r in left.collect()) == [50, 70] and left.columns == documents(*rows).columns
    assert near_dedup.keep_one(odd_documents, 80).filter("doc_id is null").count() == 2


def test_empty_table(odd_documents):
    assert near_dedup.near_duplicates(odd_documents.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [50, 60, 70, 75, 79, 80, 85, 90, 100])
def test_keys_cover_the_similarity(percent):
    keys = near_dedup.keys_for(percent)
    n, s = keys.size, percent / 100
    beyond = sum(math.comb(n, k) * (1 - s) ** k * s ** (n - k) for k in range(keys.distance + 1, n + 1))
    assert beyond <= near_dedup.KEY_MISS
    # Pigeonhole: as many differences as allowed leave some key equal, wherever they are.
    chosen = np.random.default_rng(percent)
    one = chosen.integers(0, 1 << 16, (200, n)).astype(np.uint16)
    other = one.copy()
    for row in other:
        row[chosen.choice(n, keys.distance, replace=False)] += 1
    assert (near_dedup.chunk_keys(one, keys) == near_dedup.chunk_keys(other, keys)).any(1).all()
    with pytest.raises(ValueError):
        near_dedup.keys_for(near_dedup.LEAST_PERCENT - 1)


@pytest.mark.parametrize("percent", [50, 65])
def test_low_similarities_equal_comparing_all(documents, percent):
    texts = near_copies(11, 40, 80, 0.06) + near_copies(12, 40, 80, 0.09) + near_copies(13, 20, 300, 0.04)
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(documents(*rows), percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, percent)


def test_documents_are_joined_through_a_text_without_id(documents):
    words = prose(5, 100).split(" ")
    middle = words[:92] + prose(61, 8).split(" ")
    texts = [" ".join(w) for w in (words, middle, prose(62, 6).split(" ") + middle[6:])]
    rows = [(7, texts[0]), (None, texts[1]), (3, texts[2]), (None, "nothing like it at all in here"), (None, "nothing like it at all in here")]
    found = near_dedup.near_duplicates(documents(*rows), 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, 80)
    assert {r.component_id for r in found if r.n_shingles > 20} == {3} and near_dedup.near_duplicates(documents(rows[0], rows[2]), 80).filter("kept").count() == 2


def test_copies_of_one_text_leave_few_pairs_open(documents, monkeypatch):
    # Each copy is like the original, and unlike the other copies.
    base = prose(21, 400).split(" ")
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        changed = list(base)
        for k in random.Random(i).sample(range(5, 395, 6), 6):
            changed[k] = f"w{i}x{k}"
        rows.append((i, " ".join(changed)))
    stored = {}
    store = near_dedup.common.store
    monkeypatch.setattr(near_dedup.common, "store", lambda df, label: stored.setdefault(label, store(df, label)) if label == "near-open" else store(df, label))
    shuffled = [(1000 - i, t) for i, t in rows]
    found = near_dedup.near_duplicates(documents(*shuffled), 85).collect()
    assert {r.component_id for r in found} == {851} and len(found) == 150
    assert stored["near-open"].count() < 300


def test_shingles_are_words_in_order():
    texts = [t.encode() for t in ("", "  ", "a", "a b", "b a", "a b c d e", "a  b\tc\nd e f", "a b c d e f", "é ü ß", "x" * 1000)]
    found = shingles.sets(texts)
    assert [len(f) for f in found] == [len(shingle_set(t.decode())) for t in texts]
    assert (found[6] == found[7]).all() and found[3] != found[4]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (6001, 6000)]
    edges = spark.createDataFrame(chain, "u long, v long").repartition(7)
    found = components(edges).groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d")).collect()
    assert sorted(map(tuple, found)) == [(0, 301, 301), (1000, 400, 400), (6000, 2, 2)]
    assert components(edges.limit(0)).collect() == []


def test_settled_links_take_no_further_round(spark, monkeypatch):
    rounds = []
    store = near_dedup.common.store
    monkeypatch.setattr(near_dedup.common, "store", lambda df, label: rounds.append(label) or store(df, label))
    settled = spark.createDataFrame([(i, i % 3) for i in range(3, 90)], "u long, v long").coalesce(1)
    assert sorted(map(tuple, stars(settled).collect())) == [(i, i % 3) for i in range(3, 90)] and len(rounds) == 1
    rounds.clear()
    assert stars(settled.limit(0)).collect() == [] and len(rounds) == 1
    rounds.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long").repartition(5)
    assert sorted(map(tuple, stars(chain).collect())) == [(i, 0) for i in range(1, 41)] and len(rounds) > 1


def test_many_shuffle_partitions_write_few_files_of_small_tables(documents, spark, monkeypatch):
    files = {}
    store = near_dedup.common.store
    monkeypatch.setattr(near_dedup.common, "store", lambda df, label, *more: files.setdefault(label, []).append(out := store(df, label, *more)) or out)
    rows = list(enumerate(near_copies(31, 30, 60, 0.03)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = near_dedup.near_duplicates(documents(*rows), 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, 85)
    assert max(len(t.inputFiles()) for tables in files.values() for t in tables) <= spark.sparkContext.defaultParallelism
    # One round of hubs: candidates are compared and confirmed for the hubs and for the open pairs.
    assert "near-centres" in files and len(files["near-mixed"]) == 1
