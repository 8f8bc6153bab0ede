"""URL filters: a rule list by host and path, then association rules mined from labels.

Tokens of a URL are its scheme, the labels of its host, the segments of its
path without figures, its query keys and its fragment. Tokens that stand in the
same labelled URLs make one class, since a rule may hold any of them for the
same counts; a URL holds a class when it holds one of its tokens. A class that
is unwanted by itself is a rule, and combinations with it are covered. FP-growth
mines combinations of the other classes from unwanted URLs only; how many
labelled URLs hold each is counted through the inverted index that matches rules
afterwards: each rule stands under its rarest class. Different token sets are looked up
once however many URLs share them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common

MIN_COUNT = 10
MIN_CONFIDENCE = 0.6
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """From the end of the host to ``?`` or ``#``; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL; a null URL, or one without ``://``, has none."""
    whole = F.coalesce(url, F.lit(""))
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))
    keys = F.transform(F.split(F.regexp_extract(whole, r"(?s)^[^#?]*\?([^#]*)", 1), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    found = F.concat(
        tagged("s:", F.array(F.lower(F.split_part(whole, F.lit("://"), F.lit(1))))),
        tagged("h:", F.split(host(url), r"\.")),
        tagged("p:", F.split(F.regexp_replace(path(url), "[0-9]+", "0"), "/")),
        tagged("q:", keys),
        tagged("f:", F.array(F.regexp_extract(whole, r"(?s)^[^#]*#(.*)$", 1))),
    )
    return F.when(F.contains(whole, F.lit("://")), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of a list: a struct ``rule, verdict``, or null.

    A rule ``(verdict, host, path)`` fits its host and all subdomains where the
    path starts with its path. Of equally long rules the longer host wins, then
    ``block`` before ``allow``. The list is written out in the expression.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    found = None
    for verdict, h, p in order:
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


@dataclass
class Rules:
    """Mined rules over classes of tokens."""

    rules: DataFrame  # classes (sorted), n (unwanted URLs), n_all (labelled URLs)
    classes: DataFrame  # token, class (its smallest token), n, n_all


def _classes(sets: DataFrame, least: int) -> DataFrame:
    """Tokens of at least ``least`` unwanted URLs with their class: those in the same labelled URLs, by two hashes of these."""
    marks = [F.sum(F.xxhash64("tokens", F.lit(seed)).cast("decimal(38,0)")).alias(f"mark{seed}") for seed in (0, 1)]
    held = sets.select(F.explode("tokens").alias("token"), "tokens", "n", "n_all").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.count("*").alias("sets"), *marks
    ).filter(F.col("n") >= least)
    same = ["sets", "mark0", "mark1"]
    return held.join(held.groupBy(*same).agg(F.min("token").alias("class")), same).select("token", "class", "n", "n_all")


def _of_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``tokens, held`` of the sets that hold some class; each set once."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(classes.select("token", "class"), "token")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set("class")).alias("held"))


def _holding(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``tokens, rule`` of sets ``tokens, held`` with the rules ``classes`` that they hold, by the rarest class of each rule."""
    count = classes.filter("token = class").select("class", "n_all")
    index = rules.select(F.col("classes").alias("rule"), F.explode("classes").alias("class")).join(count, "class")
    index = index.groupBy("rule").agg(F.min_by("class", F.struct("n_all", "class")).alias("class"))
    found = sets.select("tokens", "held", F.explode("held").alias("class")).join(index, "class")
    return found.filter(F.size(F.array_except("rule", "held")) == 0).select("tokens", "rule")


def mine(urls: DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id", label_col: str = "quality",
         bad: int = 0, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> Rules:
    """Rules: combinations of any number of classes whose labelled URLs are mostly unwanted.

    URLs and labels meet by id; an id is unwanted when any of its labels is
    ``bad``, null labels count for nothing. A rule needs ``min_count`` unwanted URLs at
    every size of the table, and their share among the labelled URLs that hold it must reach
    ``min_confidence``. Combinations with a class that is a rule by itself are left
    out: they change no verdict.
    """
    judged = labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{label_id}`").isNotNull()).groupBy(F.col(f"`{label_id}`").cast("long").alias("__id")).agg(
        F.bool_or(F.col(f"`{label_col}`") == bad).alias("__bad")
    )
    items = urls.select(F.col(f"`{id_col}`").cast("long").alias("__id"), tokens(F.col(f"`{url_col}`").cast("string")).alias("tokens"))
    sets = items.join(judged, "__id").groupBy("tokens").agg(F.count_if("__bad").alias("n"), F.count("*").alias("n_all"))
    sets = common.store(sets, "url-sets")
    classes = common.store(_classes(sets, min_count), "url-classes")
    own = classes.filter("token = class").withColumn("rule", F.col("n") >= min_confidence * F.col("n_all"))
    single = own.filter("rule").select(F.array("class").alias("classes"), "n", "n_all")
    held = common.store(_of_classes(sets, classes.join(own.filter("NOT rule").select("class"), "class", "left_semi")), "url-held")
    # A row for each unwanted URL.
    unwanted = held.join(sets.filter("n > 0"), "tokens").select("held", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    baskets = unwanted.count()
    if baskets < min_count:
        return Rules(single, classes)
    frequent = FPGrowth(itemsCol="held", minSupport=min_count / baskets).fit(unwanted).freqItemsets
    frequent = frequent.filter((F.size("items") > 1) & (F.col("freq") >= min_count))
    frequent = common.store(frequent.select(F.array_sort("items").alias("classes"), F.col("freq").alias("n")), "url-frequent")
    every = _holding(held, frequent, classes).join(sets.select("tokens", "n_all"), "tokens").groupBy("rule").agg(F.sum("n_all").alias("n_all"))
    several = frequent.join(every.withColumnRenamed("rule", "classes"), "classes").filter(F.col("n") >= min_confidence * F.col("n_all"))
    return Rules(common.store(single.unionByName(several), "url-rules"), classes)


def matches(token_sets: DataFrame, mined: Rules) -> DataFrame:
    """``tokens`` of the sets that hold all classes of some rule; each set once."""
    held = _of_classes(token_sets, mined.classes)
    return _holding(held, mined.rules, mined.classes).select("tokens").distinct()


def judge(urls: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id", **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every row of ``urls``.

    ``rule`` is the longest fitting rule of the list and gives the verdict; where
    none fits, ``mined`` (a mined rule holds) blocks and everything else is
    allowed. A null URL, or one without ``://``, has an empty host and path and
    is allowed. Repeated rows are judged one by one, an empty table gives an
    empty result, and without labels nothing is mined. Other columns are not
    looked at.
    """
    found = mine(urls, labels, url_col, id_col, **options)
    url = F.col(f"`{url_col}`").cast("string")
    rows = urls.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    hit = matches(rows.select("tokens").distinct(), found).withColumn("mined", F.lit(True))
    rows = rows.join(hit, "tokens", "left").withColumns({"mined": F.coalesce("mined", F.lit(False)), "listed": listed(F.col("host"), F.col("path"), rules)})
    return rows.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined",
    )
