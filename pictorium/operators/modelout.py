"""Model answers: running a model over rows, reading and mending its JSON, choosing descriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from pictorium import schemas
from pictorium.functions import text as T
from pictorium.session import ship_package

EMPTY_FLAGS = (
    '{"has_characters":false,"characters":[],"has_dogs":false,"dogs":[],"has_cars":false,"cars":[]}'
)

# Words of the rules that a model is asked to follow.
HUMAN_WORDS = ("man", "woman", "child", "person", "hiker", "tourist")
DOG_WORDS = ("dog", "puppy", "canine")
CAR_WORDS = ("car", "vehicle", "sedan", "suv", "truck")


# ---------------------------------------------------------------- running a model


def run_model(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], Iterable]],
    outputs: str,
    keep: tuple[str, ...],
    batch: int = 32,
) -> DataFrame:
    """Apply a model over partitions: kept columns, the output columns, ``status``, ``error``.

    ``load`` runs once in each task and returns a function from a batch of rows
    to a data frame of outputs. A batch that fails is halved until the failing
    rows stand alone; those get NULL outputs and status ``error``, the rest goes on.
    """
    ship_package(df.sparkSession)
    produced = ST.StructType.fromDDL(outputs)
    kept = ST.StructType([df.schema[c] for c in keep])
    schema = ST.StructType(
        [*kept.fields, *produced.fields, ST.StructField("status", ST.StringType()), ST.StructField("error", ST.StringType())]
    )
    names = [f.name for f in produced.fields]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def attempt(rows: pd.DataFrame) -> pd.DataFrame:
            result = pd.DataFrame(model(rows))
            result = result[names].reset_index(drop=True)
            out = pd.concat([rows[list(keep)].reset_index(drop=True), result], axis=1)
            return out.assign(status="ok", error=None)

        def halved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                done = attempt(rows)
            except Exception as failure:
                if len(rows) > 1:
                    middle = len(rows) // 2
                    yield from halved(rows.iloc[:middle])
                    yield from halved(rows.iloc[middle:])
                    return
                nulls = {n: [None] for n in names}
                message = f"{type(failure).__name__}: {failure}"
                done = rows[list(keep)].reset_index(drop=True).assign(**nulls, status="error", error=message)
            yield done

        for frame in frames:
            for start in range(0, len(frame), batch):
                yield from halved(frame.iloc[start : start + batch])

    return df.mapInPandas(apply, schema)


# ---------------------------------------------------------------- JSON answers


def json_span(response: Column) -> Column:
    """From the first opening to the last closing brace; NULL when either is missing."""
    start = F.instr(response, "{")
    end = F.length(response) - F.instr(F.reverse(response), "}") + 1
    has_both = (start > 0) & F.contains(response, F.lit("}"))
    return F.when(has_both, F.substr(response, start, F.greatest(end - start + 1, F.lit(0))))


def parse_flags(text: Column) -> Column:
    """Flags of a complete JSON object, NULL for anything else."""
    valid = F.try_parse_json(text)
    return F.when(valid.isNotNull(), F.from_json(text, schemas.FLAGS))


def empty_flags() -> Column:
    return F.from_json(F.lit(EMPTY_FLAGS), schemas.FLAGS)


# Values of the fields that a cut answer may lack.
_ABSENT = {"has_cars": "false", "cars": "[]"}


def mended_json(response: Column) -> Column:
    """The answer from its first brace on; a cut one is closed and gets the fields it lacks, with empty values.

    An answer that says it has no cars can only lack what follows; one that was
    cut in its list of dogs lacks the end of the list and everything about cars.
    """
    partial = F.substr(response, F.instr(response, "{"))
    body = F.rtrim(partial, F.lit(T.WHITESPACE))
    holds = lambda piece: F.contains(partial, F.lit(piece))
    fields = lambda *names: F.lit("".join(f',"{n}":{_ABSENT[n]}' for n in names))

    cut = ~F.endswith(body, F.lit("}"))
    said_no_cars = holds('"has_cars": false') & cut
    listing_dogs = holds('"has_dogs": true') & holds('"dogs": [')
    silent_on_cars = listing_dogs & ~holds('"has_cars":')
    list_end = F.when(silent_on_cars & ~F.endswith(body, F.lit("]")), F.lit("]")).otherwise(F.lit(""))
    lacking = (
        F.when(silent_on_cars, fields("has_cars", "cars"))
        .when(said_no_cars & ~holds('"cars":'), fields("cars"))
        .otherwise(F.lit(""))
    )
    mend = said_no_cars | silent_on_cars | (listing_dogs & cut)
    return F.when(mend, F.concat(body, list_end, lacking, F.lit("}"))).otherwise(partial)


def extract_json(responses: DataFrame) -> DataFrame:
    """``photo_id, outcome, flags``: what parses as it stands; otherwise NULL flags or, without an object, empty ones.

    ``outcome``: ``parsed``, ``no_json`` or ``broken``.
    """
    span = json_span(F.col("response"))
    read = responses.select("photo_id", "response", span.alias("span")).withColumn("read", parse_flags(F.col("span")))
    outcome = F.when(F.col("span").isNull(), "no_json").when(F.col("read").isNotNull(), "parsed").otherwise("broken")
    flags = F.when(F.col("span").isNull(), empty_flags()).otherwise(F.col("read"))
    return read.select("photo_id", "response", outcome.alias("outcome"), flags.alias("flags"))


def repair_json(responses: DataFrame) -> DataFrame:
    """``photo_id, outcome, flags`` with cut answers mended where that works, else empty flags.

    ``outcome``: ``parsed``, ``no_json``, ``repaired`` or ``unreadable``.
    """
    read = extract_json(responses)
    broken = F.col("outcome") == "broken"
    fixed = F.when(broken, parse_flags(mended_json(F.col("response"))))
    tried = read.withColumn("fixed", fixed)
    outcome = (
        F.when(~broken, F.col("outcome")).when(F.col("fixed").isNotNull(), "repaired").otherwise("unreadable")
    )
    return tried.select(
        "photo_id", outcome.alias("outcome"), F.coalesce("flags", "fixed", empty_flags()).alias("flags")
    )


def rule_flags(library: DataFrame) -> DataFrame:
    """``photo_id`` and the three flags from the words of the text, in place of a model."""
    words = F.transform(T.words(F.col("description")), F.lower)

    def any_of(vocabulary: tuple[str, ...]) -> Column:
        return F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary])), F.lit(False))

    return library.select(
        "photo_id",
        any_of(HUMAN_WORDS).alias("has_characters"),
        any_of(DOG_WORDS).alias("has_dogs"),
        any_of(CAR_WORDS).alias("has_cars"),
    )


# ---------------------------------------------------------------- description tries


def best_candidate(candidates: DataFrame) -> DataFrame:
    """``photo_id, best, complete``: the first complete try, else the longest one, the earlier on ties.

    A running minimum over a sort key, so tries are combined before the shuffle.
    """
    tried = candidates.select("photo_id", "candidate_idx", T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    complete = ~T.is_incomplete(F.col("text"))
    length = F.length("text")
    key = F.struct(
        F.when(complete, 0).otherwise(1).alias("open"),
        F.when(complete, 0).otherwise(-length).alias("length"),
        F.col("candidate_idx").alias("idx"),
    )
    return tried.groupBy("photo_id").agg(F.min_by("text", key).alias("best")).withColumn(
        "complete", ~T.is_incomplete(F.col("best"))
    )


def continue_candidate(best: DataFrame, continuations: DataFrame) -> DataFrame:
    """``photo_id, description``: an open best try gives way to a longer continuation.

    ``continuations``: ``photo_id, continuation``, one for each photo.
    """
    met = best.join(continuations.select("photo_id", "continuation"), "photo_id", "left")
    longer = T.strip(F.col("continuation"))
    taken = ~F.col("complete") & (F.col("best") != "") & (F.length(longer) > F.length("best"))
    return met.select("photo_id", F.when(taken, longer).otherwise(F.col("best")).alias("description"))
