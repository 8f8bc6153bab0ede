"""Registered queries against their check SQL. PICTORIUM_ALL=1 runs every one of them."""

import os

import pytest

from pictorium.plans import CHECKS, QUERIES

duckdb = pytest.importorskip("duckdb")

TABLES = ("documents", "labels", "embeddings", "events", "conversations", "benchmark")
SOME = (
    "hybrid_search", "keyword_search", "snippetN", "cosine_topk", "nearest_reference", "lexical_factor",
    "assign_unique_names", "repair_json", "best_candidate", "problematic_queries", "text_metadata", "select_files",
)
CHOSEN = tuple(CHECKS) if os.environ.get("PICTORIUM_ALL") else SOME


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    typed = [tuple(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return sorted(typed, key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_check(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = engine.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert comparable(found.columns, [tuple(r) for r in found.collect()]) == comparable(names, result.fetchall())


def test_selections_share_one_listing(spark, tmp_path):
    spark.sql("SELECT id AS doc_id, 'x' AS text, 'en' AS lang, 'src1' AS source, id AS n_chars FROM range(90)").write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.sql("SELECT id * 2 AS event_id, timestamp_seconds(id) AS ts FROM range(40)")
    # An id that comes twice, and one without an event.
    events.unionByName(events.limit(1)).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["select_files"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    oldest = [r.path_id for r in found.filter("method = 'oldest'").collect()]
    # Names that start with a dot (every 23rd) are not listed.
    dated = [i for i in range(0, 80, 2) if i % 23]
    undated = [i for i in range(1, 90, 2) if i % 23]
    assert sorted(oldest) == sorted((dated + undated)[:40])
