"""Text files of ``NAME.ext - Description: text`` entries; texts may run over several lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pictorium.functions import text as T
from pictorium.operators.ordering import file_place

# An entry's text follows this word; before it stand a name with a suffix, blanks and a hyphen.
# Blanks may hold line breaks, and a name holds neither a slash nor a line break.
TEXT_MARK = "Description:"
SUFFIX = r"(\.[a-zA-Z]{2,5})\z"
ENTRY_TEXT = " - Description: "
BLANKS = " \t\n\x0b\x0c\r"


def format_descriptions(described: DataFrame) -> DataFrame:
    """One ``value`` for each ``filename, description``."""
    return described.select(F.concat("filename", F.lit(ENTRY_TEXT), "description").alias("value"))


def write_descriptions(described: DataFrame, path: str) -> None:
    """Append entries as text files below ``path``."""
    format_descriptions(described).write.mode("append").text(path)


def _opening(piece: Column) -> Column:
    """What opens at the end of a piece: ``name``, ``later`` (it begins its line) and ``text``, the piece before it.

    Taken apart from the end, without a search: a hyphen between blanks, then the
    last line before it, of which the name is what follows the last slash.
    """
    dashed = F.rtrim(piece, F.lit(BLANKS))
    body = F.rtrim(F.left(dashed, F.length(dashed) - 1), F.lit(BLANKS))
    line = F.substring_index(body, "\n", -1)
    name = F.substring_index(line, "/", -1)
    suffix = F.length(F.regexp_extract(F.right(name, F.lit(6)), SUFFIX, 1))
    opens = dashed.endswith("-") & (suffix > 0) & (F.length(name) > suffix)
    later = opens & (F.length(name) == F.length(line)) & (F.length(line) < F.length(body))
    return F.struct(
        F.when(opens, name).otherwise("").alias("name"), later.alias("later"),
        F.left(body, F.length(body) - F.length(line) - 1).alias("text"),
    )


def _splits(pieces: DataFrame) -> DataFrame:
    """For each split of a file: entries that open before it, the line of the file's first opening, and the line that ends a file, with or without the mark.

    One row for each split of the scan, a list that Spark's driver holds anyway.
    The last piece of a file opens nothing, unless the file ends with the mark.
    """
    mark = len(TEXT_MARK)
    opens = F.col("o.name") != ""
    splits = pieces.groupBy("_path", "_block").agg(
        F.count_if("o.later").alias("n"), F.min(F.when(opens, F.struct("_line", "o.later"))).alias("first"), F.max("_line").alias("end"),
        F.max_by("o.later", "_line").alias("end_later"), F.sum(F.octet_length("value") + mark).alias("bytes"), F.max("_size").alias("size"),
    )
    file = W.partitionBy("_path")
    last_split, all_marked = F.col("_block") == F.max("_block").over(file), F.sum("bytes").over(file) == F.col("size")
    splits = splits.withColumns({
        "cut": last_split & ~all_marked, "marked": last_split & all_marked,
        "opening": F.min(F.when(F.col("first").isNotNull(), F.struct("_block", "first._line", "first.later"))).over(file),
    })
    here = F.col("opening._block") == F.col("_block")
    end = F.when(F.col("cut"), F.col("end"))
    last = F.coalesce(end == F.col("opening._line"), F.lit(False)) & here
    n = F.col("n") + F.coalesce(here & ~F.col("opening.later"), F.lit(False)).cast("int")
    n = n - (F.col("cut") & (F.col("end_later") | F.coalesce(last & ~F.col("opening.later"), F.lit(False)))).cast("int")
    earlier = file.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return splits.withColumn("n", n).select(
        "_path", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"),
        F.when(here, F.col("opening._line")).alias("_opening"), end.alias("_end"), F.when(F.col("marked"), F.col("end")).alias("_marked"),
    )


def parse_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``source_file, line_number, filename, description``; numbers count entries of a file from 1.

    The first entry of a file may open anywhere, so after a slash too; every
    later one opens at a line start. Files are cut at the mark between opening
    and text and read in splits: a piece ends with the opening of the entry
    whose text follows. A first pass counts openings for each split; the second
    numbers the entries within a split and adds the counts of the file's earlier
    splits, so neither a large file nor a long text is held by one task. The work
    is linear in the text. Entries with an empty text are dropped after numbering.
    """
    pieces = spark.read.text(path, lineSep=TEXT_MARK).select(
        "value", *file_place(), F.col("_metadata.file_size").alias("_size"), _opening(F.col("value")).alias("o")
    )
    pieces = pieces.join(F.broadcast(_splits(pieces)), ["_path", "_block"])
    allowed = (F.col("o.later") | F.coalesce(F.col("_line") == F.col("_opening"), F.lit(False))) & F.coalesce(F.col("_line") != F.col("_end"), F.lit(True))
    opens = (F.col("o.name") != "") & allowed
    pieces = pieces.select(
        F.col("_path").alias("source_file"), "_block", "_line", "_start", opens.cast("int").alias("_opens"), F.when(opens, F.col("o.name")).alias("_name"),
        F.when(opens, F.col("o.text")).when(F.col("_line") == F.col("_marked"), F.concat("value", F.lit(TEXT_MARK))).otherwise(F.col("value")).alias("value"),
    )
    # A piece that opens an entry is the last of the one before; its name belongs to the next.
    in_split = W.partitionBy("source_file", "_block").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn("_entry", F.col("_start") + F.coalesce(F.sum("_opens").over(in_split), F.lit(0)))
    # Both roles of a piece, so that pieces are read and numbered once.
    roles = F.array(
        F.when(F.col("_entry") > 0, F.struct(F.col("_entry").alias("line_number"), F.lit(None).cast("string").alias("name"), F.col("value"))),
        F.when(F.col("_opens") == 1, F.struct((F.col("_entry") + 1).alias("line_number"), F.col("_name").alias("name"), F.lit(None).cast("string").alias("value"))),
    )
    rows = placed.select("source_file", "_block", "_line", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    part = F.when(F.col("r.value").isNotNull(), F.struct("_block", "_line", F.col("r.value").alias("value")))
    return (
        rows.groupBy("source_file", F.col("r.line_number").alias("line_number"))
        .agg(F.max("r.name").alias("filename"), F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "source_file", "line_number", T.strip(F.col("filename")).alias("filename"),
            T.strip(F.array_join(F.transform("parts", lambda r: r["value"]), TEXT_MARK)).alias("description"),
        )
        .filter((F.col("filename") != "") & (F.col("description") != ""))
    )
