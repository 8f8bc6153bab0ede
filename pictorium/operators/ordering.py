"""Row numbers and pages over whole tables, without a single-partition window.

Rows are cut into ranges by bounds taken from a small sample. Numbers within a
range come from a window, and the counts of the earlier ranges are added. The
bounds only decide how the work is divided; the numbers are exact for any
bounds, so one group that holds most of the rows is numbered in many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
MAX_RANGES = 512
RANGE_ROWS = 50_000  # rows may be whole texts, and a range is a task
MAX_TOP_ROWS = 100_000

Order = list[tuple[str, bool]]  # (column, ascending)


def _sort_columns(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


def _after(order: Order, bound: dict) -> Column:
    """The row sorts after the bound; columns compare one after the other, NULLs last."""
    later, tied = F.lit(False), F.lit(True)
    for name, ascending in order:
        column, value = F.col(name), bound[name]
        if value is None:
            beyond, same = F.lit(False), column.isNull()
        else:
            beyond = column.isNull() | (column > F.lit(value) if ascending else column < F.lit(value))
            same = F.coalesce(column == F.lit(value), F.lit(False))
        later = later | (tied & F.coalesce(beyond, F.lit(False)))
        tied = tied & same
    return later


def _bounds(df: DataFrame, order: Order, rows: int, range_rows: int) -> list[dict]:
    """Range bounds from a sample of at most ``SAMPLE_ROWS`` rows."""
    ranges = min(MAX_RANGES, -(-rows // range_rows))
    if ranges <= 1:
        return []
    keys = df.select(*[c for c, _ in order])
    share = min(1.0, SAMPLE_ROWS / rows)
    sample = keys.sample(share, seed=7).limit(2 * SAMPLE_ROWS).orderBy(*_sort_columns(order)).collect()
    step = max(1, len(sample) // ranges)
    return [r.asDict() for r in sample[step::step]][: ranges - 1]


def _range_of(order: Order, bounds: list[dict], first: int = 0) -> Column:
    """Number of bounds that the row sorts after, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(_after(order, bounds[middle]), _range_of(order, bounds[middle + 1 :], first + middle + 1)).otherwise(
        _range_of(order, bounds[:middle], first)
    )


def running_sum(
    df: DataFrame,
    order: Order,
    value: str,
    within: tuple[str, ...] = (),
    name: str = "before",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows, over the table or within columns.

    ``order`` must not leave ties. A table of at most ``range_rows`` rows is one
    range; larger ones are summed range by range, and the totals of the earlier
    ranges are added.
    """
    bounds = _bounds(df, order, df.count(), range_rows)
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    if not bounds:
        window = W.partitionBy(*within).orderBy(*_sort_columns(order)) if within else W.orderBy(*_sort_columns(order))
        return df.withColumn(name, F.coalesce(F.sum(value).over(earlier(window)), F.lit(0)))
    ranged = df.withColumn("_range", _range_of(order, bounds))
    groups = [*within, "_range"]
    totals = ranged.groupBy(*groups).agg(F.sum(value).alias("_total"))
    ranges = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy("_range")
    starts = totals.select(*groups, F.coalesce(F.sum("_total").over(earlier(ranges)), F.lit(0)).alias("_start"))
    inside = earlier(W.partitionBy(*groups).orderBy(*_sort_columns(order)))
    rows = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups])
    return rows.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("_inside") + F.col("_start")).alias(name)
    )


def numbered(
    df: DataFrame,
    order: Order,
    within: tuple[str, ...] = (),
    name: str = "row_no",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``df`` with row numbers from 1 in ``order``, over the table or within the columns ``within``."""
    counted = running_sum(df.withColumn("_one", F.lit(1)), order, "_one", within, name, range_rows)
    return counted.drop("_one").withColumn(name, (F.col(name) + 1).cast("long"))


FILE_PLACE = ("_path", "_block", "_line")


def file_place() -> list[Column]:
    """File, split and running line of rows that come straight from a file scan (filters allowed)."""
    return [
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ]


def numbered_by_file(lines: DataFrame, name: str) -> DataFrame:
    """Rows of a scan numbered from 0 in file order, without moving them.

    Lines run on within a split, so a row's number is its distance from the
    first line of its split plus the rows of all earlier splits. Only the
    table of splits is sorted.
    """
    splits = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    in_file = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    files = splits.groupBy("_path").agg(F.sum("_n").alias("_rows"))
    files = running_sum(files, [("_path", True)], "_rows", name="_before").drop("_rows")
    starts = splits.withColumn("_start", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).join(files, "_path")
    place = F.col("_line") - F.col("_first") + F.col("_start") + F.col("_before")
    kept = [c for c in lines.columns if c not in FILE_PLACE]
    return lines.join(starts.drop("_n"), ["_path", "_block"]).select(*kept, place.alias(name))


def page(df: DataFrame, order: Order, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + limit`` in ``order``.

    Near the start a top-k is enough; deep pages go by row number, since a
    top-k would hold every row before the page.
    """
    if limit is not None and offset + limit <= MAX_TOP_ROWS:
        ordered = df.orderBy(*_sort_columns(order))
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    if limit is None and not offset:
        return df.orderBy(*_sort_columns(order))
    kept = numbered(df, order).filter(F.col("row_no") > offset)
    if limit is not None:
        kept = kept.filter(F.col("row_no") <= offset + limit)
    return kept.orderBy("row_no").drop("row_no")
