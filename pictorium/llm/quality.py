"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: its measurement goes into a
column and its failure into one bit of ``fail_bits``. A policy is a named,
versioned mask; applying one, or comparing many, is an AND on a stored integer
and never reads a text again. Everything is built from DataFrame functions in
the row of the document: no shuffle takes part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` is its place in the ledger."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


def mask(*names: str) -> int:
    """Mask of the named rules."""
    bits = {r.name: r.mask for r in RULES}
    return sum(bits[n] for n in set(names))


# A policy never changes once published: a new version gets a new entry.
POLICIES = {
    "base/1": mask("few_words", "repeated_words"),
    "web/1": mask("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web/2": mask(*(r.name for r in RULES)),
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document: ``doc_id`` and ``MEASURES``.

    A null text has no words and no lines. A line counts when it holds a word;
    it is a duplicate when an earlier line of the same text is equal to it.
    A word is repeated when it lies in a five-word window that stands in the
    text more than once. Windows are told apart by a 64-bit hash of their words.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHAR))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), _bound(words, _of_words).alias("w"), _bound(lines, _of_lines).alias("l"),
    )
    return df.select("doc_id", *(F.col(c if c == "n_symbols" else f"{'l' if 'lines' in c else 'w'}.{c}").cast("long").alias(c) for c in MEASURES))


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value bound once, as the variable of a one-element transform.

    However filters move and projections merge, ``fn`` never repeats what makes the value.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def _of_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.try_element_at(words, i + j) for j in range(WINDOW))))
    windows = F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))
    return F.struct(
        F.size(words).alias("n_words"), F.char_length(F.array_join(words, "")).alias("word_chars"), _bound(windows, _covered).alias("n_repeat_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs more than once.

    Most texts repeat nothing, which one pass over a hash set tells. Otherwise
    windows are sorted by hash, those equal to a neighbour give their positions,
    and each position covers the words up to the next one, five at most.
    """
    sort = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(pairs: Column) -> Column:
        n = F.size(pairs)
        same = F.filter(
            pairs,
            lambda p, j: ((j > 0) & (p["h"] == F.get(pairs, j - 1)["h"])) | ((j < n - 1) & (p["h"] == F.get(pairs, j + 1)["h"])),
        )
        return F.array_sort(F.transform(same, lambda p: p["i"]))

    def count(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_bound(_bound(sort, places), count))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` (bit of every failed rule), one row for each row of ``docs``.

    Nulls count as empty texts, repeated rows are judged one by one, an empty
    table gives an empty ledger, and other columns are not looked at.
    """
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def judge(entries: DataFrame, policy: str = "web/2") -> DataFrame:
    """Ledger with ``kept``: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(entries: DataFrame, policy: str = "web/2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does: ``rule, n_fail, n_only`` (documents that fail it; that fail nothing else).

    ``n_only`` documents would come back if the rule were dropped. One
    aggregation over integers; the result has a row for each rule.
    """
    failed = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    used = [r for r in rules if r.mask & POLICIES[policy]]
    counts = entries.agg(*(
        F.struct(
            F.lit(r.name).alias("rule"),
            F.count_if(failed.bitwiseAND(F.lit(r.mask)) != 0).alias("n_fail"),
            F.count_if(failed == r.mask).alias("n_only"),
        ).alias(r.name) for r in used
    ))
    return counts.select(F.explode(F.array(*(F.col(r.name) for r in used))).alias("r")).select("r.*")
