"""Search history: entries, recent searches, queries that keep doing badly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.operators.ordering import page

MIN_OCCURRENCES = 2  # fixed value
SCORE_THRESHOLD = 0.45  # fixed value
RECENT_SEARCHES = 100  # fixed value


def log_entries(
    summary: DataFrame, queries: DataFrame, phrases: DataFrame | None = None, logged_at=None,
    filters: dict[str, bool | None] | None = None, keep_empty: bool = False,
) -> DataFrame:
    """Log rows of a finished search batch.

    ``summary`` comes from ``search_summary``. Searches without results are only
    logged with ``keep_empty``. The phrases of a query, if given, are written
    into ``expanded_query``.
    """
    base = queries.select("query_id", "query").join(summary, "query_id", "left" if keep_empty else "inner")
    expanded = F.lit(None).cast("string")
    if phrases is not None:
        quoted = F.transform(
            F.array_sort(F.collect_list(F.struct("phrase_no", "phrase"))),
            lambda p: F.concat(F.lit("'"), p["phrase"], F.lit("'")),
        )
        listed = phrases.groupBy("query_id").agg(
            F.concat(F.lit("Multi-phrase: ["), F.array_join(quoted, ", "), F.lit("]")).alias("_expanded")
        )
        base = base.join(listed, "query_id", "left")
        expanded = F.nullif(F.col("_expanded"), F.col("query"))
    asked = {k: v for k, v in (filters or {}).items()}
    if any(v is not None for v in asked.values()):
        pairs = [x for k, v in asked.items() for x in (F.lit(k), F.lit(v).cast("boolean"))]
        used = F.create_map(*pairs)
    else:
        used = F.create_map().cast("map<string,boolean>")
    return base.select(
        (F.current_timestamp() if logged_at is None else logged_at).alias("timestamp"),
        "query",
        expanded.alias("expanded_query"),
        F.coalesce("results_count", F.lit(0)).cast("int").alias("results_count"),
        F.round("top_score", 4).alias("top_score"),
        F.round("top_3_avg", 4).alias("top_3_avg"),
        used.alias("filters"),
    )


def recent_searches(log: DataFrame, limit: int = RECENT_SEARCHES) -> DataFrame:
    """The last ``limit`` entries, in log order."""
    return page(log, [("seq", False)], limit).orderBy("seq")


def problematic_queries(
    log: DataFrame, min_occurrences: int = MIN_OCCURRENCES, score_threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """``query, count, avg_top_score, has_expansion``, worst first.

    Expansion is judged by the first entry of a query; the threshold applies
    to the average before it is rounded.
    """
    stats = log.groupBy("query").agg(
        F.count("*").alias("count"),
        F.avg("top_score").alias("_avg"),
        F.min_by(F.col("expanded_query").isNotNull(), "seq").alias("has_expansion"),
        F.min("seq").alias("_first"),
    )
    bad = stats.filter((F.col("count") >= min_occurrences) & (F.col("_avg") < score_threshold))
    return (
        bad.withColumn("avg_top_score", F.round("_avg", 4))
        .orderBy("avg_top_score", "_first")
        .select("query", "count", "avg_top_score", "has_expansion")
    )
