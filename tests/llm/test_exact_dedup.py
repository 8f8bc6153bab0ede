import hashlib
import tempfile
import time
from collections import defaultdict

import public_tokenizers
import pyarrow as pa

from pictorium.llm import common, exact_dedup, near_dedup, packing


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def plain(rows, largest=True):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    out = []
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        sha, used = hashlib.sha256(key).hexdigest(), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not used, sha))
            used |= i == keep
    return sorted(out, key=repr)


def test_owners_equal_plain_grouping(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for keep in ("largest", "smallest"):
        for bound in (exact_dedup.TRIE_BYTES, 200):
            found = exact_dedup.owners(odd_documents, keep=keep, trie_bytes=bound).collect()
            assert sorted(map(tuple, found), key=repr) == plain(rows, keep == "largest")


def test_rows_that_stay_keep_their_columns(odd_documents):
    left = exact_dedup.deduplicate(odd_documents)
    assert left.columns == odd_documents.columns
    assert len(left.collect()) == len({lower(r.text) for r in odd_documents.collect()})
    assert left.filter("row <> 'row'").count() == 0


def test_empty_table(odd_documents):
    assert exact_dedup.owners(odd_documents.limit(0)).collect() == []
    assert exact_dedup.deduplicate(odd_documents.limit(0)).collect() == []


def test_trie_spills_whole_subtrees_and_loses_nothing():
    merge = exact_dedup._merger(True)
    keys = [b"common-" + str(i % 700).encode() * (i % 5 + 1) for i in range(4000)] + [b"", b"common-"]
    with tempfile.TemporaryDirectory() as folder:
        trie = exact_dedup.PatriciaTrie(merge, 3000, folder)
        expected = defaultdict(list)
        for i, key in enumerate(keys):
            trie.put(key, (i, i, 1, [i]))
            expected[key].append(i)
        found = {key: value for key, value in trie.entries()}
    assert {k: (v[0], v[2], sorted(v[3])) for k, v in found.items()} == {k: (max(v), len(v), v) for k, v in expected.items()}


def test_many_equal_rows_take_linear_time():
    trie = exact_dedup.PatriciaTrie(exact_dedup._merger(True))
    start = time.perf_counter()
    for i in range(200_000):
        trie.put(b"the same text", (i, i, 1, [i]))
    ((key, (doc, _, count, groups)),) = trie.entries()
    assert (key, doc, count, len(groups)) == (b"the same text", 199_999, 200_000, 200_000)
    assert time.perf_counter() - start < 10


def test_whole_rows_are_shuffled_once(spark, documents):
    docs = documents((1, "one"), (1, "one"), (0, "two"), (None, "two"), (None, None), (None, ""), (0, "three"), (None, "Four"), (None, "four"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = exact_dedup.deduplicate(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        found = sorted(((r.doc_id, lower(r.text)) for r in left.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # Whole rows go through one exchange and one sort; a null id is not the id 0.
    below = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "sha#" in line]
    assert len(below) == 2, plan  # the rows, and the keys of those that stay
    assert plan.count("Sort [id#") == 2, plan
    assert found == sorted([(1, b"one"), (0, b"two"), (None, b""), (0, b"three"), (None, b"four")], key=repr)


def test_tasks_get_few_texts_at_a_time(spark, documents, monkeypatch):
    asked, store = {}, common.store

    def stored(df, label, batch_rows=None):
        asked[label] = batch_rows
        return store(df, label, batch_rows)

    monkeypatch.setattr(common, "store", stored)
    docs = documents((1, "one"))
    exact_dedup.owners(docs)
    near_dedup.near_duplicates(docs)
    packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert asked["exact-rows"] == exact_dedup.BATCH_ROWS
    assert asked["near-sets"] == near_dedup.BATCH_ROWS
    assert asked["token-runs"] == packing.BATCH_ROWS


def test_words_are_hashed_a_slice_at_a_time(monkeypatch):
    asked, pieces = [], common.pieces
    monkeypatch.setattr(common, "pieces", lambda batches, column, limit=common.BATCH_BYTES: asked.append(limit) or pieces(batches, column, limit))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "mark": [1, 2], "text": ["one two", None]})
    (found,) = near_dedup._sets(near_dedup.keys_for(80))(iter([batch]))
    assert asked == [near_dedup.SLICE]
    assert found.column("n_shingles").to_pylist() == [1, 0]


def test_a_worker_hands_memory_back_after_its_task(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("back"))

    def fn(batches):
        yield from batches
        done.append("over")

    assert list(common.handing_back(fn)(iter([1, 2]))) == [1, 2]
    assert done == ["over", "back"]
