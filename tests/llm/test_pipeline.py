import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pictorium.llm import toxicity
from pictorium.llm.queries import CHECKS, QUERIES

from .test_exact_dedup import lower
from .test_filters import plain_spans
from .test_near_dedup import shingle_set


def test_every_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        held[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    texts = {n: ({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()} if n != "packing" else None) for n, (a, b) in held.items()}

    before, after = texts["toxicity"]
    model = toxicity.learn(held["toxicity"][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    calm = {r.doc_id for r in toxicity.score(held["toxicity"][0], model).collect() if r.predicted == 0}
    assert after == {i: before[i] for i in calm}

    before, after = texts["exact_dedup"]
    last = {lower(t): i for i, t in sorted(before.items())}
    assert after == {i: before[i] for i in last.values()}

    before, after = texts["near_dedup"]
    sets = {i: shingle_set(t) for i, t in before.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    assert after == {i: before[i] for i in ids if top(i) == i}

    before, after = texts["pii"]
    assert before.keys() == after.keys()
    for i, text in before.items():
        if not plain_spans(text):
            assert after[i] == text
        else:
            assert not [k for k, _, _ in plain_spans(after[i]) if k in ("email", "ip")] and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i])

    packed = held["packing"][1]
    assert packed.groupBy("doc_id").agg((F.sum("length") == F.first("doc_tokens")).alias("whole")).filter("not whole").count() == 0
    assert packed.select("doc_id").distinct().count() == len(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_check(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    found = QUERIES[name](spark, sf_dir)
    engine = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = engine.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, odd_documents, tmp_path, empty):
    """Nulls, repeated rows, clashing names and no rows at all go through every stage; other columns stay."""
    labels = [(i, int(i in (7, 9))) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents.limit(0) if empty else odd_documents
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            rows = docs.collect()
            assert len(rows) <= before and all(r.row in ("row", None) for r in rows)
            before = len(rows)
    if empty:
        assert docs.count() == 0
    else:
        # Every row that was kept is packed, also those without a text.
        assert docs.select("doc_id", "sequence_id").count() >= before > 0
