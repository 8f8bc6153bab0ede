"""Searches through the metric index against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.operators import vectorindex as X
from pictorium.operators import vectors as V

SCHEMA = "photo_id long, embedding array<double>"


def clusters(seed, centres, each, dim, spread):
    """Vectors around random directions, some of other lengths, with ties and zero vectors."""
    chosen = np.random.default_rng(seed)
    rows = []
    for c in chosen.normal(size=(centres, dim)):
        found = c / np.linalg.norm(c) + spread * chosen.normal(size=(each, dim))
        rows += list(found / np.linalg.norm(found, axis=1, keepdims=True))
    rows = [r * (1.0 if i % 50 else 0.9) for i, r in enumerate(rows)]
    return rows + [rows[0], rows[0], -rows[1], np.zeros(dim)]


def frame(spark, rows, name="photo_id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("threshold, max_broadcast", [(None, 4096), (0.3, 4096), (None, 0), (0.95, 0)])
def test_rows_equal_comparing_everything(spark, tmp_path, monkeypatch, threshold, max_broadcast):
    monkeypatch.setattr(V, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    rows = clusters(1, 20, 60, 12, 0.08)
    vectors = frame(spark, rows)
    queries = frame(spark, rows[::40] + clusters(2, 3, 1, 12, 0.5)[:3], "query_id")
    X.build(vectors.repartition(5), str(tmp_path / "index"))
    found = X.search(queries, spark, str(tmp_path / "index"), 15, threshold, max_broadcast)
    wanted = V.cosine_topk(queries, vectors, 15, threshold)
    order = ("query_id", "rank")
    assert found.rows.orderBy(*order).collect() == wanted.orderBy(*order).collect()
    # Lists far from a query are not read.
    assert 0 < found.share < 0.5


def test_only_wanted_lists_are_opened(spark, tmp_path):
    rows = clusters(3, 12, 50, 16, 0.02)
    path = str(tmp_path / "index")
    X.build(frame(spark, rows), path, lists=12)
    found = X.search(frame(spark, rows[:1], "query_id"), spark, path, 5, None)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert found.share < 0.3 and "PartitionFilters: [" in plan and "list" in plan
    lists = X.read_lists(spark, path)
    assert lists.n.sum() == len(rows) and (lists.far <= np.pi).all()


def test_bounds_hold_for_every_pair(spark, tmp_path):
    rows = np.array(clusters(5, 8, 40, 6, 0.6))
    path = str(tmp_path / "index")
    X.build(frame(spark, list(rows)), path, lists=9)
    queries = np.array(clusters(6, 5, 6, 6, 1.0))
    lists = X.read_lists(spark, path)
    bounds = lists.bounds(queries)
    stored = X._stored(spark, path, "array<double>").collect()
    column = {n: j for j, n in enumerate(lists.number.tolist())}
    for r in stored:
        assert (queries @ np.array(r["embedding"]) <= bounds[:, column[r["list"]]]).all()


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    X.build(empty, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    assert X.search(asked, spark, str(tmp_path / "none")).rows.collect() == []
    with_null = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], SCHEMA)
    X.build(with_null, str(tmp_path / "two"))
    for cap in (4096, 0):
        found = X.search(asked, spark, str(tmp_path / "two"), 5, None, cap).rows.orderBy("rank").collect()
        assert [(r.query_id, r.rank, r.photo_id, r.similarity) for r in found] == [(1, 1, 1, 1.0), (1, 2, 3, 0.0)]
    assert X.search(asked.limit(0), spark, str(tmp_path / "two")).rows.collect() == []
    assert X.search(asked.withColumn("embedding", F.array(F.lit(1.0))), spark, str(tmp_path / "two")).rows.collect() == []
    with pytest.raises(ValueError):
        X.build(with_null.union(spark.createDataFrame([(4, [1.0])], SCHEMA)), str(tmp_path / "bad"))
