"""Repairs against a search over all edits, and the segments of long conversations."""

import heapq
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import conversations
from pictorium.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def key_of(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def cheapest(rows):
    """Cost, audit and repaired lines of ``role, text, fault`` rows: the first to arrive in order of cost and letters."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, said = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, [list(x) for x in said]
        if (i, last) in done:
            continue
        done.add((i, last))
        put = lambda add, letter, at, now, line: heapq.heappush(queue, (cost + add, audit + letter, at, now, said + ((line,) if line else ())))
        for role in ("user", "assistant"):
            if (last, role[0]) in FOLLOWS:
                put(3, "I", i, role[0], (role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            put(4, "D", i + 1, last, None)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role and (last, role[0]) in FOLLOWS:
                    put(more, "K", i + 1, role[0], (role, text))
                for new in ("user", "assistant"):
                    if (last, new[0]) in FOLLOWS:
                        put(3 + more, "R", i + 1, new[0], (new, text))
    raise AssertionError


def plain(rows):
    """Everything about one conversation of ``turn, role, text`` rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, key_of(r[1], r[2])))
    seen, judged = set(), []
    for turn, role, text in rows:
        end = text.strip(BLANKS)[-1:]
        judged.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] or " " for _, r, _ in rows]
    count = lambda f: sum(x[2] == f for x in judged)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, said = cheapest(judged)
    digest = sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        kind = crc32(f"{conv_text}:{turn_text}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "unit", "", None, "User"]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "cut off ", "Yes. \n", "", " \t", None, "é…", "漢字。", "a" * 3000 + "."]
SCHEMA = "conv_id long, turn long, role string, text string"


def made_up(seed, conversations_, most):
    chosen = random.Random(seed)
    rows = []
    for conv in conversations_:
        for turn in range(chosen.randint(0, most)):
            turn = None if chosen.random() < 0.1 else turn + chosen.randint(0, 2)
            rows.append((conv, turn, chosen.choice(ROLES), chosen.choice(TEXTS)))
    return rows


def got(repaired):
    said = {r.conv_id: (r.audit, r.repaired_sha256) for r in conversations.digests(repaired.rows).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *said[r.conv_id]) for r in repaired.summary.collect()}


def by_conversation(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, role, text))
    return found


def test_repairs_equal_a_search(spark):
    rows = made_up(1, [*range(250), None, -4], 11)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "copies": F.lit("x"), "edits": F.lit(None).cast("string")})
    found = got(conversations.repair(df.repartition(6)))
    wanted = {c: plain(r) for c, r in by_conversation(rows).items()}
    assert found == wanted


def test_long_conversations_cross_segments(spark):
    chosen = random.Random(7)
    rows = [(1, t, chosen.choice(ROLES), f"{t}{chosen.choice(['.', '!', '', ' '])}") for t in range(5000)]
    rows += [(2, 3, "user", "Again.")] * 3000 + [(2, 4, "assistant", "Once.")] + [(2, None, "system", "First.")]
    rows += [(3, t, "user", "The same.") for t in range(2500)]
    found = got(conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    for conv, own in by_conversation(rows).items():
        assert found[conv] == plain(own), conv


def test_repaired_rows_are_legal_and_stay_so(spark):
    rows = made_up(5, range(60), 9)
    repaired = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    said = {}
    for r in repaired.rows.orderBy("at").collect():
        said.setdefault(r.conv_id, []).extend((x.role, x.text) for x in r.repaired)
    for lines in said.values():
        initials = "".join(role[0] for role, _ in lines)
        assert initials == "" or initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1


def test_query_on_damaged_rows(spark, tmp_path):
    rows = made_up(3, [*range(120), None], 8)
    dropped = next(c for c in range(1000, 2000) if crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    left = by_conversation(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert found == {c: plain(left[c]) if c in left else nothing for c in by_conversation(rows)}
    assert found[dropped] == nothing


def test_empty_table(spark):
    repaired = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert repaired.summary.collect() == [] and conversations.digests(repaired.rows).collect() == []


def test_block_tables_equal_single_steps():
    t = conversations.tables()
    chosen = np.random.default_rng(3)
    for size in (0, 1, 3, 4, 5, 64, 1001):
        symbols = chosen.integers(0, conversations.SYMBOLS, size).astype(np.uint8)
        for after in range(len(t.vectors)):
            vector, cost = t.vectors[after], 0
            for symbol in symbols[::-1].tolist():
                vector = conversations.before(vector, symbol)
                cost, vector = cost + min(vector), tuple(v - min(vector) for v in vector)
            front, added, _ = conversations.solve(symbols, np.array([after]))
            assert t.vectors[front[0]] == vector and added[0] == cost
    with pytest.raises(IndexError):
        conversations.solve(np.array([conversations.SYMBOLS] * 4), np.array([len(t.vectors)]))
