"""Private data: patterns, and terms of the corpus that give protected values away.

Four kinds are found by pattern. Every value found so is a protected entity. A
term in a text with an entity may reveal it: the corpus tells how many texts hold
both and how many hold the term. The disclosure of an entity by a term is their
pointwise mutual information over the information content of the entity, with
the lower confidence bound of the share of the term's texts that hold the entity;
it nears 1 when many texts hold the term and all of them the entity. In all texts, also those
without the entity, terms over the higher threshold are removed, those over the
lower one are generalised. Everything is DataFrame functions; positions are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common

KINDS = ("email", "ip", "card", "phone")
# The patterns by kind, so written that Java neither backtracks nor recurses over long runs:
# a match can only start where a run of its first class starts, or at the end of the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Whole runs of 16 to 19 digits with single blanks or hyphens between them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[TERM]"

TERM = r"\p{L}{4,}"
MIN_CONTEXTS = 2
# Square of the normal quantile by which a rate is lowered: few contexts prove less than many.
DOUBT = 1.96**2
REMOVE = 0.95
GENERALISE = 0.85
_STEP = 64


def running_totals(steps: Column) -> Column:
    """Running sums of an array of integers, block by block so that long arrays stay cheap."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    last = F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / _STEP).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(steps, b * _STEP + 1, _STEP)))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return F.get(F.transform(F.array(before), lambda done: F.transform(
        steps, lambda _, i: F.get(done, F.floor(i / _STEP).cast("int")) + total(F.slice(steps, i - i % _STEP + 1, i % _STEP + 1))
    )), 0)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def hits(text: Column, pattern: Column) -> Column:
    """Matches of a pattern, leftmost and not overlapping: start, stop and value.

    What lies between the matches and the matches themselves, in turn, sum up to the positions.
    """
    def spans(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        steps = F.transform(found, lambda v, i: (F.char_length(F.get(gaps, i)) + F.char_length(v)).cast("long"))
        return _bind(running_totals(steps), lambda stops: F.transform(found, lambda v, i: F.struct(
            (F.get(stops, i) - F.char_length(v)).cast("long").alias("start"), F.get(stops, i).alias("stop"), v.alias("value"),
        )))

    return _bind(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Does the checksum of the digits hold?"""
    figures = F.reverse(F.split(_digits(value), ""))
    points = F.transform(figures, lambda c, i: F.when(i % 2 == 1, _doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(points, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _doubled(figure: Column) -> Column:
    return figure * 2 - F.when(figure > 4, 9).otherwise(0)


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & _luhn(value)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind in a text."""
    found = F.filter(hits(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"]))
    hint = _HINTS[kind]
    may = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    return F.when(may, found).otherwise(F.array().cast(_SPAN))


def _entity(kind: str, value: Column) -> Column:
    """One name for all spellings of a protected value."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def _each(kind: str, use) -> Column:
    """``use(kind, span)`` for the spans of one kind."""
    return F.transform(F.col(kind), lambda s: use(kind, s))


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows of ``docs`` as structs, their text, its key, and the spans of each kind."""
    df = common.boxed(docs, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    # Texts are told apart by length and two hashes; equal texts have equal spans.
    # Every row has a key, so that those without an entity are dealt out as well.
    df = df.withColumn("key", F.concat_ws(":", F.length("text"), F.xxhash64("text"), F.hash("text")))
    return df.withColumns({k: base_spans(F.col("text"), k) for k in KINDS})


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"({TERM})"), F.lit(1)))


def _named() -> Column:
    """The distinct entities of a text."""
    return F.array_distinct(F.concat(*(_each(k, lambda kind, s: _entity(kind, s["value"])) for k in KINDS)))


def _holds() -> Column:
    return reduce(lambda a, b: a | b, (F.size(k) > 0 for k in KINDS))


def disclosures(docs: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``entity, term, disclosure``: how far a term gives an entity away, from counts over all texts.

    Pairs are judged that stand together in ``min_contexts`` different texts,
    wherever in them: copies of one text are one context, and a term seen once
    reveals nothing reliably. The share of a term's texts that hold the entity is
    lowered to its confidence bound (Wilson) for as many contexts.
    """
    return _disclosures(_found(docs, text_col), min_contexts)


def _disclosures(df: DataFrame, min_contexts: int) -> DataFrame:
    # Equal texts are one row with their number, so that very many copies cost no more than one.
    held = df.filter(_holds()).select("key", _named().alias("entities"), _terms(F.col("text")).alias("terms"))
    held = common.store(held.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "pii-holders")
    named = held.select("key", "copies", F.explode("entities").alias("entity"))
    # An entity in fewer texts than contexts are needed has no pair to judge.
    repeated = named.groupBy("entity").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_contexts).select("entity")
    beside = named.join(repeated, "entity").join(held.select("key", "terms"), "key").select("entity", "copies", F.explode("terms").alias("term"))
    pairs = beside.groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.count("*").alias("contexts")).filter(F.col("contexts") >= min_contexts)
    places = df.select(F.explode(F.concat(*(_each(k, lambda kind, s: _entity(kind, s["value"])) for k in KINDS))).alias("entity"))
    entities = places.groupBy("entity").agg(F.count("*").alias("of_entity"))
    words = df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"({TERM})"), F.lit(1))).alias("term"))
    counts = df.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term"))
    total = words.agg(F.count("*").alias("total")).first()["total"] or 1
    judged = pairs.join(entities, "entity").join(counts, "term")
    share = F.least(F.lit(1.0), F.col("together") / F.col("of_term"))
    n = F.col("contexts") / share
    rate = (share + DOUBT / (2 * n) - F.sqrt(DOUBT * (share * (1 - share) / n + DOUBT / (4 * n * n)))) / (1 + DOUBT / n)
    prior = F.least(F.lit(0.5), F.col("of_entity") / F.lit(total))
    return judged.select("entity", "term", (F.log2(rate / prior) / -F.log2(prior)).alias("disclosure"))


def detect(docs: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with ``pii_spans``: all spans by kind, then start, each ``kind, start, stop, label``.

    Kinds are email, ip, card, phone and term. A null or empty text has no
    spans; repeated rows have the same ones; an empty table stays empty. A
    column ``pii_spans`` of the input is replaced, all others stay as they are.
    """
    return _detect(docs, text_col, min_contexts, remove, generalise).select(
        *(F.col(f"row.`{c}`") for c in docs.columns if c != "pii_spans"), "pii_spans"
    )


def _detect(docs: DataFrame, text_col: str, min_contexts: int = MIN_CONTEXTS, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    df = _found(docs, text_col)
    revealing = _disclosures(df, min_contexts).filter(F.col("disclosure") >= generalise)
    # Stored, so that Spark knows its size before it plans the join with the terms of all texts.
    revealing = common.store(revealing.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-revealing")
    terms = df.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(revealing, "term").distinct()
    terms = terms.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "disclosure")))).alias("terms"))
    df = df.join(terms, "key", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("terms"), "|"), F.lit(r")(?!\p{L})"))
    base = F.concat(*(_each(k, lambda kind, s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(LABELS[kind]).alias("label")
    )) for k in KINDS))
    df = df.withColumn("base", base)
    free = F.filter(hits(F.col("text"), pattern), lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    extra = F.transform(free, lambda s: F.struct(
        F.lit("term").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        F.when(F.try_element_at("terms", F.lower(s["value"])) >= remove, F.lit("")).otherwise(F.lit(GENERAL)).alias("label"),
    ))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", extra))
    return df.withColumn("pii_spans", spans).select("row", "text", "pii_spans")


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced by their labels; all other columns as they were.

    Of overlapping spans the one that starts first gives the label, and all of
    their characters go. A null text stays null.
    """
    found = _detect(docs, text_col, **options)
    text = F.col("text")
    inorder = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["label"].alias("label"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(
        inorder, start,
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
            s["stop"].alias("at"),
            F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["label"])).alias("out"),
        )),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))),
    )
    clean = F.when(F.size("pii_spans") > 0, done).otherwise(F.col(f"row.`{text_col}`").cast("string")).alias(text_col)
    return found.select(*(clean if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
