"""Repair of conversation structure with Four-Russians block tables.

The role initials of a repaired conversation are nothing, or an optional ``s``
and then ``ua`` once or more: an automaton of four states. A row is a symbol
(its initial, and whether it is fine, truncated or to be deleted), and a symbol
turns the vector of cheapest costs to the end, one for each state, into the
vector of the place before it. Vectors less their smallest cost are few, so
``tables`` lists them once, and for every block of ``BLOCK`` symbols it holds the
vector before the block and the cost that the block adds, for each vector
after it. A conversation is then solved from its end, block by block, with one
look-up each; blocks are expanded backward symbol by symbol only to trace, and
the trace goes forward and takes the least letter among the cheapest edits, so
of the cheapest repairs it gives the one whose letters are least.

Rows are ordered over the whole table and cut into segments of a bounded
number of rows. A segment is a function from the vector after it to the vector
before it, looked up for all vectors at once; the functions of a conversation
are composed in a stream from its end, segments are traced by themselves from
every state, and a stream from the start chooses among those. So a conversation
with a third of all rows is ordered, solved and traced in many tasks, and only
short rows for each segment meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Rows of the table between two cuts, and copies of a row that count as one.
SEGMENT = 1024
BLOCK = 4
WORD_CHAR = r"[^\x20\x09-\x0D]"
# States: nothing yet, after s, after u, after a. What an inserted or re-roled row leads to, and what rows may be kept.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
# Costs of the end: a missing answer, or a missing question and answer.
END = (0, 2 * INSERT, INSERT, 0)
# Symbol 0 is to be deleted; the others are an initial (any other one: "-") and whether the row is truncated.
INITIALS = "sua-"
SYMBOLS = 1 + 2 * len(INITIALS)
# Edits in the order of their letters; a code is an edit with the state that it leads to.
LETTERS = "DIKR"


@dataclass(frozen=True)
class Tables:
    """Vectors by number, what a symbol and a block make of them, and the edits of a symbol."""

    vectors: list[tuple[int, ...]]
    end: int
    step: np.ndarray  # vector after, symbol -> vector before
    add: np.ndarray
    block: np.ndarray  # vector after, symbols of the block as a number -> vector before
    block_add: np.ndarray
    edits: list  # vector after, symbol, state -> letters with states, state after

    def ending(self, state: int) -> str:
        """Edits after the last row."""
        found = ""
        while END[state]:
            state = NEXT[state]
            found += f"I{state}"
        return found


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cheapest costs before a symbol from those after it."""
    costs = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol:
            more = TRUNCATED * ((symbol - 1) % 2)
            ways.append(REROLE + more + after[NEXT[state]])
            kept = KEPT.get((INITIALS[(symbol - 1) // 2], state))
            if kept is not None:
                ways.append(KEEP + more + after[kept])
        costs.append(min(ways))
    # Rows inserted before the symbol; at most two lead through every state that inserting reaches.
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _edits(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """Edits up to and with that of the symbol: the least letter among the cheapest, again and again."""
    costs, found = before(after, symbol), ""
    more = TRUNCATED * ((symbol - 1) % 2) if symbol else 0
    while True:
        if costs[state] == DELETE + after[state]:
            return found + f"D{state}", state
        if costs[state] == INSERT + costs[NEXT[state]]:
            state = NEXT[state]
            found += f"I{state}"
            continue
        kept = KEPT.get((INITIALS[(symbol - 1) // 2], state)) if symbol else None
        if kept is not None and costs[state] == KEEP + more + after[kept]:
            return found + f"K{kept}", kept
        return found + f"R{NEXT[state]}", NEXT[state]


@cache
def tables() -> Tables:
    """All of it from the costs above: vectors reachable from the end, then blocks by doubling symbols."""
    vectors, steps = [END], {}
    for v in vectors:
        for symbol in range(SYMBOLS):
            costs = before(v, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in vectors:
                vectors.append(normal)
            steps[vectors.index(v), symbol] = vectors.index(normal), least
    step = np.array([[steps[v, s][0] for s in range(SYMBOLS)] for v in range(len(vectors))])
    add = np.array([[steps[v, s][1] for s in range(SYMBOLS)] for v in range(len(vectors))])
    block, block_add = step, add
    for _ in range(BLOCK - 1):
        # The first symbol of a block is its highest digit and is met last.
        block, block_add = (
            np.stack([step[block, s] for s in range(SYMBOLS)], 1).reshape(len(vectors), -1),
            np.stack([block_add + add[block, s] for s in range(SYMBOLS)], 1).reshape(len(vectors), -1),
        )
    edits = [[[_edits(v, s, state) for state in range(4)] for s in range(SYMBOLS)] for v in vectors]
    return Tables(vectors, 0, step, add, block, block_add, edits)


_PLACE = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks as numbers, and the symbols before the first of them."""
    lead = len(symbols) % BLOCK
    return symbols[lead:].reshape(-1, BLOCK).astype(np.int64) @ _PLACE, symbols[:lead]


def solve(symbols: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Vectors before the symbols and the cost added, for vectors after them; and the vectors after every block."""
    t = tables()
    numbers, lead = blocks(symbols)
    cost, borders = np.zeros(len(after), np.int64), []
    for number in numbers[::-1].tolist():
        borders.append(after)
        cost = cost + t.block_add[after, number]
        after = t.block[after, number]
    borders.append(after)
    for symbol in lead[::-1].tolist():
        cost = cost + t.add[after, symbol]
        after = t.step[after, symbol]
    return after, cost, borders[::-1]


def trace(symbols: np.ndarray, after: int, states: list[int]) -> list[tuple[list[str], int]]:
    """Edits of each symbol and the state after the last, from each of the states: blocks are expanded one by one."""
    t = tables()
    _, _, borders = solve(symbols, np.array([after]))
    lead = len(symbols) % BLOCK
    values = symbols.tolist()
    pieces = [values[:lead], *(values[i:i + BLOCK] for i in range(lead, len(values), BLOCK))]
    found = [([], s) for s in states]
    for piece, border in zip(pieces, borders):
        vector, expanded = int(border[0]), []
        for symbol in reversed(piece):
            expanded.append((vector, symbol))
            vector = int(t.step[vector, symbol])
        for k, (edits, state) in enumerate(found):
            for vector, symbol in reversed(expanded):
                letters, state = t.edits[vector][symbol][state]
                edits.append(letters)
            found[k] = edits, state
    return found


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes the marks that end sentences, 3
    repeats the row, 4 makes the user say it. A null counts as one space.
    """
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    rows = rows.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(_spaced("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times")
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class Placed:
    """Stored rows in order, and what is wrong with each."""

    rows: DataFrame  # conv_id, at, turn, role, text: equal rows are one
    faults: DataFrame  # conv_id, at, segment, turn, copies, initial, and the copies that are blank, duplicate, truncated


def place(rows: DataFrame) -> Placed:
    """Order conversations by id, and rows by turn (null turns first) and by the digest of role and text."""
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    merged = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    merged = merged.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("key", key)
    # A row with more copies than a segment has rows becomes several.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {SEGMENT}")))
    merged = merged.withColumn("chunk", chunk).withColumn("copies", F.least(F.lit(SEGMENT), F.expr(f"copies - chunk * {SEGMENT}")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key"), F.col("chunk")]
    ranged = merged.repartitionByRange(common.partitions(rows), *order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "copies", "key")
    placed = common.store(ranged, "conversation-rows")
    first = placed.groupBy("conv_id", "key").agg(F.min("at").alias("at")).select("at", F.lit(1).alias("new"))
    said = F.rtrim("text", F.lit(BLANKS))
    found = placed.select(
        "conv_id", "at", F.expr(f"at div {SEGMENT}").alias("segment"), "turn", "copies",
        # An empty role has a space for initial, which fits nowhere.
        F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"), F.substring(said, -1, 1).alias("last"),
    ).join(first, "at", "left")
    blank, new = F.col("last") == "", F.coalesce("new", F.lit(0))
    faults = found.select(
        "conv_id", "at", "segment", "turn", "copies", "initial", F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).otherwise(F.col("copies") - new).alias("duplicate"),
        F.when(~blank & (new == 1) & ~F.col("last").isin(".", "!", "?"), 1).otherwise(0).alias("truncated"),
    )
    return Placed(placed.select("conv_id", "at", "turn", "role", "text"), common.store(faults, "conversation-faults"))


LEGAL = ("su", "ua", "au")


def _segments(kind: pa.DataType):
    schema = pa.schema([
        ("conv_id", kind), ("place", pa.int64()), ("ats", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("symbols", pa.binary()), ("first", pa.string()),
        ("last", pa.string()), ("illegal", pa.int64()), ("before", pa.binary()), ("cost", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(tables().vectors))
        for batch in batches:
            columns = [[] for _ in schema]
            for conv, entries in zip(batch.column("conv_id").to_pylist(), batch.column("entries").to_pylist()):
                symbols, illegal, last = bytearray(), 0, None
                for e in entries:
                    gone = e["blank"] + e["duplicate"] == e["copies"]
                    initial = e["initial"]
                    symbols.append(0 if gone else 1 + 2 * (INITIALS.index(initial) if initial in INITIALS[:3] else 3) + e["truncated"])
                    symbols.extend(bytes(e["copies"] - 1))
                    illegal += e["copies"] - 1 + (last is not None and last + initial not in LEGAL)
                    last = initial
                front, cost, _ = solve(np.frombuffer(symbols, np.uint8), every)
                row = (
                    conv, entries[0]["at"], [e["at"] for e in entries], [e["copies"] for e in entries], bytes(symbols), entries[0]["initial"], last, illegal,
                    front.astype(np.uint8).tobytes(), cost.tobytes(),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_AFTER = pa.schema([("place", pa.int64()), ("after", pa.int32()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("total", pa.int64())])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector after each segment, from the last one of a conversation to the first; that one also has the whole cost."""
    vectors = tables().vectors
    held, conv, vector, cost = None, None, 0, 0
    for batch in batches:
        rows = []
        for now, place, front, added in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "before", "cost"))):
            closes = held is None or now != conv
            if closes:
                if held is not None:
                    rows.append((*held[:2], True, held[2], cost + vectors[vector][START]))
                conv, vector, cost = now, 0, 0
            else:
                rows.append((*held[:2], False, held[2], None))
            held = place, vector, closes
            cost += int(np.frombuffer(added, np.int64)[vector])
            vector = front[vector]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _AFTER)], schema=_AFTER)
    if held is not None:
        row = *held[:2], True, held[2], cost + vectors[vector][START]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _AFTER)], schema=_AFTER)


_TRACED = pa.schema([("place", pa.int64()), ("edits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each row of a segment, rows parted by bars, from each state in which it may begin."""
    for batch in batches:
        edits, ends = [], []
        for symbols, after, opens, closes, copies in zip(*(batch.column(c).to_pylist() for c in ("symbols", "after", "opens", "closes", "copies"))):
            found = trace(np.frombuffer(symbols, np.uint8), after, [START] if opens else list(range(4)))
            ways = []
            for letters, end in found:
                at, each = 0, []
                for n in copies:
                    each.append("".join(letters[at:at + n]))
                    at += n
                ways.append("|".join(each) + (tables().ending(end) if closes else ""))
            edits.append(ways)
            ends.append([end for _, end in found])
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(edits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], schema=_TRACED)


_CHOSEN = pa.schema([("place", pa.int64()), ("edits", pa.string()), ("border", pa.int64())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each segment from the state in which the one before it ended; ``border`` is 1 where the two meet illegally."""
    state, last = START, None
    for batch in batches:
        chosen, border = [], []
        for opens, edits, ends, first, final in zip(*(batch.column(c).to_pylist() for c in ("opens", "edits", "ends", "first", "last"))):
            way = 0 if opens else state
            chosen.append(edits[way])
            border.append(int(not opens and last + first not in LEGAL))
            state, last = ends[way], final
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(chosen), pa.array(border, pa.int64())], schema=_CHOSEN)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return rows.select("conv_id").limit(0).toArrow().schema.field("conv_id").type


@dataclass
class Repair:
    """Conversations as they are after the cheapest edits, and what was wrong with them."""

    rows: DataFrame
    summary: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair conversations ``conv_id, turn, role, text`` by the cheapest edits.

    ``summary`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``
    for every conversation with rows. ``rows`` has ``conv_id, at, turn, role,
    text, audit, repaired`` for every row, equal rows of a conversation and turn
    as one: ``at`` gives their order, ``audit`` the letters of the edits (Keep,
    Rerole, Delete, Insert before it, or after the last row), ``repaired`` the
    rows that stand there afterwards, an array of ``role, text``.

    A null role or text is one space, an empty role fits nowhere, null turns come
    first, rows of one turn are ordered by the digest of role and text, and rows
    whose ``conv_id`` is null are one conversation. Equal rows are duplicates of
    each other. An empty table gives empty results; other columns are not looked at.
    """
    placed = place(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    entry = F.struct("at", "copies", "initial", "blank", "duplicate", "truncated")
    grouped = placed.faults.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(entry)).alias("entries")).drop("segment")
    segments = common.store(common.map_batches(
        grouped, _segments(_arrow_type(rows)),
        f"conv_id {kind}, place long, ats array<long>, copies array<long>, symbols binary, first string, last string, illegal long, before binary, cost binary",
    ), "conversation-segments")
    parts = common.partitions(rows)
    ended = segments.select("conv_id", "place", "before", "cost").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("place").desc())
    after = common.store(common.map_batches(ended, _backward, "place long, after int, opens boolean, closes boolean, total long"), "conversation-costs")
    solved = segments.select("conv_id", "place", "symbols", "copies").join(after, "place")
    traced = common.map_batches(solved.select("place", "symbols", "after", "opens", "closes", "copies"), _traced, "place long, edits array<string>, ends array<int>")
    begun = traced.join(segments.select("conv_id", "place", "first", "last"), "place").join(after.select("place", "opens"), "place")
    begun = begun.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    chosen = common.store(common.map_batches(begun, _forward, "place long, edits string, border long"), "conversation-edits")

    each = segments.join(chosen.select("place", "edits"), "place").select(F.explode(F.arrays_zip("ats", F.split("edits", "\\|").alias("edits"))).alias("e"))
    edited = placed.rows.join(each.select(F.col("e.ats").alias("at"), F.col("e.edits").alias("edits")), "at")
    steps = F.filter(F.regexp_extract_all("edits", F.lit("[A-Z][0-9]"), F.lit(0)), lambda e: ~e.startswith("D"))
    said = F.transform(steps, lambda e: F.struct(
        F.when(e.startswith("K"), F.col("role")).when(e.endswith(str(AFTER_U)), ROLE[AFTER_U]).otherwise(ROLE[AFTER_A]).alias("role"),
        F.when(e.startswith("I"), "").otherwise(F.col("text")).alias("text"),
    ))
    edited = edited.select("conv_id", "at", "turn", "role", "text", F.regexp_replace("edits", "[0-9]", "").alias("audit"), said.alias("repaired"))

    wrong = placed.faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    costs = segments.select("conv_id", "place", "illegal").join(chosen.select("place", "border"), "place").join(after.select("place", "total"), "place")
    costs = costs.groupBy(F.col("conv_id").alias("own")).agg(F.sum(F.col("illegal") + F.col("border")).alias("illegal"), F.sum("total").alias("cost"))
    summary = wrong.join(costs, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    return Repair(edited, summary)


def _digests(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, audit, state, lines = False, None, [], sha256(), False
        for batch in batches:
            done = []
            for now, letters, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "body"))):
                if not open_ or now != conv:
                    if open_:
                        done.append((conv, "".join(audit), state.hexdigest()))
                    open_, conv, audit, state, lines = True, now, [], sha256(), False
                audit.append(letters)
                if body is not None:
                    state.update((b"\n" if lines else b"") + body.encode())
                    lines = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, "".join(audit), state.hexdigest()), schema)], schema=schema)

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` from repaired rows: all edits, and the digest of ``role:text`` lines.

    A digest of a whole conversation is read in order by its nature; its rows
    pass through a task one by one and are not gathered.
    """
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    body = F.when(F.size("repaired") > 0, F.array_join(lines, "\n"))
    ordered = repaired.select("conv_id", "at", "audit", body.alias("body")).repartition(common.partitions(repaired), "conv_id").sortWithinPartitions("conv_id", "at")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return common.map_batches(ordered.select("conv_id", "audit", "body"), _digests(_arrow_type(repaired)), f"conv_id {kind}, audit string, repaired_sha256 string")
