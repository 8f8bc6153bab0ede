"""Toxicity by class-conditional Kneser-Ney language models of spelling.

Two models, of toxic and of ordinary labelled texts, give every word a
likelihood letter by letter: the letters of a word, its beginning and its end
follow each other with interpolated Kneser-Ney probabilities of up to ``ORDER``
letters. The highest order counts in how many texts of its class the words with
that string stand; each lower one counts how many different strings of the next order end in a
string. A string that one class lacks backs off there while the other class has
it, and the orders up to ``SHARED`` count both classes together, so letters of a
language say nothing and a rare expression is judged by the spelling that it
shares with others. No string is dropped, however rare.

A text is compared by the mean difference of the log-likelihoods of its words, and
by that of its ``TOP`` words with the largest difference. A logistic regression on
another fold turns both into a probability.

A word's difference does not depend on its neighbours. So probabilities are
found by joins for the different strings of the words of all texts, and texts sum
up differences of strings. The most frequent strings, a fixed number, are brought
into the tasks; a word with any other string is looked up by a join, with the same
score. Differences are whole multiples of 1 / ``UNIT``: sums are the same in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common, shingles

FOLDS = 5
HELD_OUT = 0
CALIBRATE = 4
DISCOUNT = 0.75
ORDER = 6
SHARED = 2
TOP = 4
UNIT = 1 << 20
# Strings that are brought into the tasks, 16 bytes each.
HEAD_STRINGS = 1 << 20
# Strings that the driver spells out at a time.
KEYS_TOGETHER = 20_000
# Words that a task remembers, 16 bytes each.
REMEMBERED = 400_000
# Bytes of text that a task splits into words together; some forty times as many are held for it.
SLICE = 512 << 10
# Rows of texts that a task gets together.
BATCH_ROWS = 1_000
# What stands before and after the letters of a word; no word holds them.
BEGIN, END = "\x02", "\x03"
_SPLIT = bytes(32 if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127) else c for c in range(256))


def words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of all texts (letters and figures), their 64-bit hashes, and the number of words of each text."""
    texts = [t.translate(_SPLIT) for t in texts]
    found, counts = shingles.words(texts)
    return b" ".join(texts).split(), found, counts


@dataclass
class Spelled:
    """Different words of a batch, and which of them each text has how often."""

    names: list[bytes]
    hashes: np.ndarray
    text: np.ndarray  # for each different word of each text
    word: np.ndarray
    times: np.ndarray
    counts: np.ndarray  # words of each text


def _distinct(texts: list[bytes]) -> Spelled:
    spelled, found, counts = words(texts)
    hashes, first, which = np.unique(found, return_index=True, return_inverse=True)
    size = max(1, len(hashes))
    pairs = np.sort(np.repeat(np.arange(len(texts)), counts) * size + which)
    start = np.flatnonzero(np.diff(pairs, prepend=-1))
    text, word = np.divmod(pairs[start], size)
    return Spelled([spelled[i] for i in first.tolist()], hashes, text, word, np.diff(start, append=len(pairs)), counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batches, some ``SLICE`` bytes of text at a time; what a batch held goes back to the system."""
    for batch in batches:
        common.give_back()
        yield from common.pieces(iter([batch]), "text", SLICE)


_WORDS = pa.schema([("key", pa.int64()), ("word", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])
_WORDS_DDL = "key long, word string, toxic long, ordinary long"


def _word_rows(texts: list[bytes], labels: np.ndarray) -> pa.RecordBatch:
    """In how many texts of each class a word stands; a text counts a word once."""
    d = _distinct(texts)
    toxic = np.bincount(d.word, labels[d.text], len(d.names)).astype(np.int64)
    every = np.bincount(d.word, minlength=len(d.names))
    names = [w.decode() for w in d.names]
    return pa.RecordBatch.from_arrays([pa.array(d.hashes.view(np.int64)), pa.array(names, pa.string()), pa.array(toxic), pa.array(every - toxic)], schema=_WORDS)


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            yield _word_rows([unpack(b) for b in part.column("body").to_pylist()], np.array(part.column("label").to_pylist(), np.int64))


def spelling(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words with what stands before and after them; of each string its word, last letter and 64-bit hash."""
    text = "".join(f"{BEGIN}{w}{END}" for w in b" ".join(spelled).decode().split(" ")) if spelled else ""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begins = letters == ord(BEGIN)
    word = np.cumsum(begins) - 1
    place = np.arange(len(letters)) - np.flatnonzero(begins)[word] if len(letters) else word
    last = np.flatnonzero(~begins)
    keys = np.zeros(len(last), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        there = place[last] >= back
        keys[there] = shingles.mix(keys[there] * np.uint64(0x9E3779B97F4A7C15) + letters[last[there] - back] + np.uint64(1))
    return letters, word[last], last, keys


def string_keys(strings_: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The hashes that ``spelling`` gives the strings, spelled out few at a time."""
    parts = (strings_.slice(at, KEYS_TOGETHER).to_pylist() for at in range(0, len(strings_), KEYS_TOGETHER))
    return np.concatenate([np.zeros(0, np.uint64), *map(_keys, parts)])


def _keys(strings_: list[str]) -> np.ndarray:
    size = max(map(len, strings_), default=0)
    keys = np.zeros(len(strings_), np.uint64)
    grid = np.array([[0] * (size - len(t)) + [ord(c) for c in t] for t in strings_], np.uint64).reshape(len(strings_), size)
    for column in grid.T:
        there = column > 0
        keys[there] = shingles.mix(keys[there] * np.uint64(0x9E3779B97F4A7C15) + column[there] + np.uint64(1))
    return keys


_STRINGS = pa.schema([("string", pa.string()), ("n", pa.int64())])


class Remembered:
    """Sorted hashes with a number each; emptied when it would hold more than ``REMEMBERED``."""

    def __init__(self):
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return _found(self.keys, hashes)[1]

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Sorted hashes that are not there yet."""
        if len(self.keys) + len(hashes) > REMEMBERED:
            self.__init__()
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.values = np.insert(self.keys, where, hashes), np.insert(self.values, where, values)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    where = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return where, table[where] == keys


def _all_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the words of all texts; ``n`` says roughly how many words have them, and only orders them.

    A task remembers words, a bounded number, whose strings it has given.
    """
    given = Remembered()
    for batch in _slices(batches):
        spelled, found, _ = words(common.utf8(batch.column("text")))
        hashes, first, times = np.unique(found, return_index=True, return_counts=True)
        new = ~given.has(hashes)
        if not new.any():
            continue
        given.add(hashes[new], times[new])
        first, times = first[new], times[new]
        letters, word, last, keys = spelling([spelled[i] for i in first.tolist()])
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(which, times[word], len(one)).astype(np.int64)
        # A string goes back to the beginning of its word at most.
        start = np.maximum(last[one] - ORDER + 1, np.flatnonzero(letters == ord(BEGIN))[word[one]]) if len(one) else one
        text = letters.tobytes().decode("utf-32-le")
        names = [text[a:b + 1] for a, b in zip(start.tolist(), last[one].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n)], schema=_STRINGS)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.first("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in _slices(batches):
        bodies = [packer.compress(t) for t in common.utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(bodies, pa.binary())], ["doc_id", "fold", "body"])


def strings(word: Column) -> Column:
    """For each letter of a word and its end the last ``ORDER`` letters up to it, back to the beginning at most."""
    letters = F.split(F.concat(F.lit(BEGIN), word, F.lit(END)), "")
    return F.get(F.transform(F.array(letters), lambda s: F.transform(
        F.sequence(F.lit(2), F.size(s)), lambda i: F.array_join(F.slice(s, F.greatest(F.lit(1), i - (ORDER - 1)), F.least(i, F.lit(ORDER))), "")
    )), 0)


def _cut(string: Column | str, order: int) -> Column:
    return F.right(string, F.lit(order))


def _context(string: Column | str) -> Column:
    column = F.col(string) if isinstance(string, str) else string
    return F.left(column, F.length(column) - 1)


_CLASSES = ("toxic", "ordinary")


@dataclass
class Order:
    """Counts of one order: of its strings, and of what follows each context."""

    strings: DataFrame  # string, toxic, ordinary
    contexts: DataFrame  # context, n_toxic, k_toxic, n_ordinary, k_ordinary


def _orders(counted: DataFrame) -> list[Order]:
    """Counts of all orders, the lowest first, from ``word, toxic, ordinary``."""
    table = counted.select(F.explode(strings(F.col("word"))).alias("string"), *_CLASSES).groupBy("string").agg(*(F.sum(c).alias(c) for c in _CLASSES))
    found = []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            kinds = [F.count_if(F.col(c) > 0) if order > SHARED else F.count("*") for c in _CLASSES]
            table = table.groupBy(_cut("string", order).alias("string")).agg(*(k.alias(c) for k, c in zip(kinds, _CLASSES)))
        table = common.store(table, "toxic-strings")
        contexts = table.groupBy(_context("string").alias("context")).agg(*(
            x for c in _CLASSES for x in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"k_{c}"))
        ))
        found.append(Order(table, common.store(contexts, "toxic-contexts")))
    return found[::-1]


def _probabilities(orders: list[Order], wanted: DataFrame) -> DataFrame:
    """``string, p_toxic, p_ordinary`` of the last letter of each wanted ``string`` after those before it."""
    needed = [wanted.distinct()]
    for order in range(ORDER - 1, 0, -1):
        needed.append(needed[-1].select(_cut("string", order).alias("string")).distinct())
    # Every letter that was ever seen, and all others as one.
    letters = orders[0].strings.count() + 1
    lower = None
    for order, (counts, strings_) in enumerate(zip(orders, reversed(needed)), 1):
        rows = strings_.withColumn("context", _context("string")).join(counts.strings, "string", "left").join(counts.contexts, "context", "left")
        if lower is None:
            rows = rows.withColumns({f"low_{c}": F.lit(1.0 / letters) for c in _CLASSES})
        else:
            shorter = lower.select(F.col("string").alias("shorter"), *(F.col(f"p_{c}").alias(f"low_{c}") for c in _CLASSES))
            rows = rows.withColumn("shorter", _cut("string", order - 1)).join(shorter, "shorter")
        lower = common.store(rows.select("string", *(
            F.when(F.col(f"n_{c}") > 0, (F.greatest(F.coalesce(c, F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"k_{c}") * F.col(f"low_{c}")) / F.col(f"n_{c}"))
            .otherwise(F.col(f"low_{c}")).alias(f"p_{c}") for c in _CLASSES
        )), "toxic-probabilities")
    return lower


def _string_differences(orders: list[Order], wanted: DataFrame) -> DataFrame:
    """``string, diff``: log-likelihood of the last letter in toxic words less that in ordinary ones."""
    return _probabilities(orders, wanted).select("string", F.round((F.log("p_toxic") - F.log("p_ordinary")) * UNIT).cast("long").alias("diff"))


_ROWS = pa.schema([
    ("id", pa.int64()), ("label", pa.int64()), ("words", pa.int64()), ("diff", pa.int64()), ("top", pa.list_(pa.int64())), ("key", pa.int64()), ("word", pa.string()), ("times", pa.int64()),
])
_ROWS_DDL = "id long, label long, words long, diff long, top array<long>, key long, word string, times long"


@dataclass
class Head:
    """Strings that tasks look up in place: sorted hashes with their differences."""

    key: np.ndarray
    diff: np.ndarray
    # Words that a task has looked up: twice their difference, and one more for those not known here.
    seen: Remembered = field(default_factory=Remembered)

    def remembered(self, hashes: np.ndarray, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``differences`` of the words with these sorted hashes; each is spelled once for a task."""
        new = np.flatnonzero(~self.seen.has(hashes))
        if len(self.seen.keys) + len(new) > REMEMBERED:
            self.seen, new = Remembered(), np.arange(len(hashes))
        total, known = self.differences([spelled[i] for i in new.tolist()])
        if len(hashes) > REMEMBERED:
            return total, known
        self.seen.add(hashes[new], 2 * total + ~known)
        values = self.seen.values[_found(self.seen.keys, hashes)[0]]
        return values >> 1, values % 2 == 0

    def differences(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Differences of words, and whether all their strings are known here."""
        _, word, _, keys = spelling(spelled)
        total, known = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), bool)
        if len(self.key) and len(keys):
            keys, which = np.unique(keys, return_inverse=True)
            where, there = _found(self.key, keys)
            there = there[which]
            known = np.bincount(word, ~there, len(spelled)) == 0
            np.add.at(total, word, np.where(there, self.diff[where][which], 0))
        return total, known

    def rows(self, texts: list[bytes], ids: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each text a row of its sums over the words that are known here, and a row for each other word."""
        d = _distinct(texts)
        text, times, counts = d.text, d.times, d.counts
        of_word, whole = self.remembered(d.hashes, d.names)
        known = whole[d.word]
        diff, of = of_word[d.word[known]], text[known]
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, of, diff * times[known])
        # Differences of a word are far below 2 ** 49 units, and a batch has a thousand texts.
        order = np.argsort(of * (1 << 50) - diff)
        starts = np.searchsorted(of[order], np.arange(len(texts) + 1))
        top = [diff[order[a:min(a + TOP, b)]].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        n = len(texts)
        none = lambda kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids), pa.array(labels), pa.array(counts.astype(np.int64)), pa.array(total), pa.array(top, pa.list_(pa.int64())), none(pa.int64()), none(pa.string()), none(pa.int64()),
        ], schema=_ROWS)
        rest = np.flatnonzero(~known)
        for i in range(0, len(rest), 100_000):
            part = rest[i:i + 100_000]
            n = len(part)
            names = [d.names[j].decode() for j in d.word[part].tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[text[part]]), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), pa.array(d.hashes[d.word[part]].view(np.int64)),
                pa.array(names, pa.string()), pa.array(times[part].astype(np.int64)),
            ], schema=_ROWS)


@dataclass
class Model:
    """Counts of all orders, differences of the strings of known texts, the head of those, and the calibration."""

    orders: list[Order] = field(default_factory=list)
    strings: DataFrame | None = None  # string, diff
    head: Head | None = None
    weights: np.ndarray | None = None
    shift: float = 0.0

    def differences(self, vocabulary: DataFrame) -> DataFrame:
        """``key, diff`` of words ``key, word``: log-likelihood as a toxic word less that as an ordinary one."""
        each = common.store(vocabulary.select("key", F.explode(strings(F.col("word"))).alias("string")), "toxic-spelling")
        known = self.strings
        new = each.select("string").distinct().join(known, "string", "left_anti")
        if not new.isEmpty():
            known = known.union(_string_differences(self.orders, new))
        return each.join(known, "string").groupBy("key").agg(F.sum("diff").alias("diff"))

    def features(self, texts: DataFrame) -> DataFrame:
        """``id, label, copies, values`` from ``id, label`` and ``text`` or packed ``body``; rows with one id have equal texts and labels.

        The values are the mean difference of all words and that of the ``TOP`` words with the largest one.
        """
        shipped = texts.sparkSession.sparkContext.broadcast(self.head)
        packed = "body" in texts.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for batch in batches if packed else _slices(batches):
                for at in range(0, len(batch), 500):
                    part = batch.slice(at, 500)
                    bodies = [unpack(b) for b in part.column("body").to_pylist()] if packed else common.utf8(part.column("text"))
                    yield from shipped.value.rows(bodies, *(part.column(c).to_numpy().astype(np.int64) for c in ("id", "label")))

        rows = common.store(common.map_batches(texts, run, _ROWS_DDL), "toxic-rows", BATCH_ROWS)
        # Copies of a text give the same rows.
        own = rows.filter(F.col("key").isNull()).groupBy("id").agg(*(F.first(c).alias(c) for c in ("label", "words", "diff", "top")), F.count("*").alias("copies"))
        rest = rows.filter(F.col("key").isNotNull()).groupBy("id", "key").agg(F.first("word").alias("word"), F.first("times").alias("times"))
        rest = common.store(rest, "toxic-rest")
        known = self.differences(rest.groupBy("key").agg(F.first("word").alias("word")))
        # The largest few of a text, so that no text gathers all of its words.
        most = F.slice(F.sort_array(F.collect_list("diff"), asc=False), 1, TOP)
        joined = rest.select("id", "key", "times").join(known, "key")
        sums = joined.groupBy("id").agg(F.sum(F.col("diff") * F.col("times")).alias("more"), most.alias("others"))
        found = own.join(sums, "id", "left")
        every = F.slice(F.sort_array(F.concat("top", F.coalesce("others", F.array().cast("array<long>"))), asc=False), 1, TOP)
        most = F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + x)
        mean = (F.col("diff") + F.coalesce("more", F.lit(0))) / (F.greatest("words", F.lit(1)) * F.lit(float(UNIT)))
        return found.select("id", "label", F.col("copies").cast("double").alias("copies"), F.array(mean, most / F.lit(float(TOP * UNIT))).alias("values"))

    def scores(self, docs: DataFrame) -> DataFrame:
        """``id, score`` for every different text of ``docs``, by its hash."""
        if self.weights is None:
            return docs.select(_text_id(F.col("text")).alias("id")).distinct().withColumn("score", F.lit(0.0))
        texts = docs.select(_text_id(F.col("text")).alias("id"), F.lit(0).alias("label"), _lower("text"))
        line = sum((F.col("values")[i] * float(w) for i, w in enumerate(self.weights)), F.lit(self.shift))
        return self.features(texts).select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))).alias("score"))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lower(name: str) -> Column:
    return F.lower(name).alias("text")


def _head(frequent: DataFrame, differences: DataFrame, head: int) -> Head:
    """The ``head`` most frequent strings."""
    table = frequent.orderBy(F.col("n").desc(), "string").limit(head).join(differences, "string").select("string", "diff").toArrow()
    keys, diff = string_keys(table.column("string")), table.column("diff").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    found = Head(keys[order], diff[order])
    # The driver goes on from stage to stage.
    del table, keys, diff, order
    common.give_back()
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
          head: int = HEAD_STRINGS) -> Model:
    """The two models and their calibration from all labelled rows outside the held-out fold.

    The fold of a row is the CRC-32 of its id as text modulo ``FOLDS``. Rows of
    the fold ``CALIBRATE`` fit the regression, the others are counted. Null
    labels and null ids are no labels; an id with several labels is toxic if one
    of them is 1. Without labelled rows of both classes the model scores 0.
    ``head`` only says how many strings are brought into the tasks.
    """
    fold = common.crc_fold(F.col("doc_id"), FOLDS)
    texts = common.id_and_text(docs, id_col, text_col).select("doc_id", _lower("text"))
    learnt = texts.filter(F.col("doc_id").isNotNull()).withColumn("fold", fold.cast("int")).filter(F.col("fold") != HELD_OUT)
    packed = common.map_batches(learnt.select("doc_id", "fold", "text"), _pack, "doc_id long, fold int, body binary")
    marks = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    # One way to join at every size: labels grow with the texts.
    rows = common.store(packed.join(marks.hint("merge"), "doc_id").select("doc_id", "fold", "body", F.when(F.col("label") == 1, 1).otherwise(0).alias("label")), "toxic-labelled", BATCH_ROWS)
    counted = common.map_batches(rows.filter(F.col("fold") != CALIBRATE).select("body", "label"), _labelled_words, _WORDS_DDL)
    counted = common.store(_summed(counted), "toxic-words", BATCH_ROWS)
    totals = counted.agg(*(F.sum(c) for c in _CLASSES)).first()
    if not all(totals):
        return Model()
    orders = _orders(counted)
    spelled = common.map_batches(texts.select("text"), _all_strings, "string string, n long").groupBy("string").agg(F.sum("n").alias("n"))
    spelled = common.store(spelled, "toxic-spelled", BATCH_ROWS)
    differences = common.store(_string_differences(orders, spelled.select("string")), "toxic-differences")
    model = Model(orders, differences, _head(spelled, differences, head))
    held = rows.filter(F.col("fold") == CALIBRATE).select(F.xxhash64("doc_id", "body", "label").alias("id"), "label", "body")
    held = common.store(model.features(held).select("label", "copies", "values"), "toxic-features")
    if held.select("label").distinct().count() == 2:
        given = held.select("label", "copies", array_to_vector("values").alias("vector"))
        fitted = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="copies", regParam=1e-4, maxIter=100).fit(given)
        model.weights, model.shift = np.array(fitted.coefficients.toArray()), float(fitted.intercept)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row from its text alone.

    ``score`` is between 0 and 1; ``predicted`` is 1 from 0.5 on. A null or empty
    text, or one without letters and figures, has the score of no evidence.
    Repeated rows have equal scores; an empty table gives an empty result; other
    columns are not looked at.
    """
    texts = common.id_and_text(docs, id_col, text_col)
    rows = texts.select("doc_id", _text_id(F.col("text")).alias("id"))
    found = rows.join(model.scores(texts), "id").select("doc_id", "score")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    toxic = common.store(model.scores(common.id_and_text(docs, id_col, text_col)).filter(F.col("score") >= 0.5).select("id"), "toxic-texts")
    rows = common.boxed(docs, id=_text_id(F.col(f"`{text_col}`").cast("string")))
    return rows.join(toxic, "id", "left_anti").select("row.*")
