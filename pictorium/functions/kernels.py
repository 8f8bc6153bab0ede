"""Numpy helpers that run inside tasks on Arrow batches of vectors.

Scores are found with one matrix product; rows that may be kept are then scored
again by summing in dimension order, so results do not depend on how rows were
batched and a retried task gives the same bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    import ahocorasick
except ImportError:  # the searches then look up the pieces of each word
    ahocorasick = None

SLACK = 1e-9  # far above the rounding error of a product of double vectors


def matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a double matrix; every row must have ``dim`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), dim)


def ordered_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed from the first dimension to the last."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(ordered_dots(rows, rows))


def round4(values: np.ndarray) -> np.ndarray:
    """Correctly rounded to four decimals."""
    return np.array([round(v, 4) for v in values.tolist()], dtype=np.float64)


MAX_CELLS = 4_000_000  # scores held at a time
MAX_PAIRS = 50_000  # pairs of vectors held at a time


def _offsets(column: pa.ListArray) -> np.ndarray:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)])


class WordEvidence:
    """What a table of queries asks of words, and the factors that follow for a batch of texts.

    ``asked[t, q]`` counts how often query ``q`` names term ``t``; ``total[q]``
    is its number of words. ``place[i]`` is the column of the query that the
    batches call ``i``.
    """

    def __init__(
        self, asked: np.ndarray, total: np.ndarray, place: np.ndarray, boost: float, scattered: float, missing: float
    ):
        self.place = place
        self.asked = asked.astype(np.float32)
        self.total = total.astype(np.int64)
        self.boost, self.scattered, self.missing = boost, scattered, missing

    def chunk_rows(self) -> int:
        return max(1, MAX_CELLS // max(1, *self.asked.shape))

    def batch(self, terms: pa.ListArray, phrases: pa.ListArray, grammatical: pa.ListArray | None):
        """A function from a row range to dense ``factor, phrase, words`` for all queries."""
        lists = {"terms": terms, "phrases": phrases}
        if grammatical is not None:
            lists["grammatical"] = grammatical
        offsets = {n: _offsets(c) for n, c in lists.items()}
        values = {n: c.flatten().to_numpy(zero_copy_only=False) for n, c in lists.items()}
        for name in lists.keys() - {"terms"}:
            values[name] = self.place[values[name]]

        def marks(name: str, lo: int, hi: int, width: int, dtype) -> np.ndarray:
            cells = np.zeros((hi - lo, width), dtype=dtype)
            at = offsets[name][lo : hi + 1]
            cells[np.repeat(np.arange(hi - lo), np.diff(at)), values[name][at[0] : at[-1]]] = 1
            return cells

        def dense(lo: int, hi: int):
            n_terms, n_queries = self.asked.shape
            words = (marks("terms", lo, hi, n_terms, np.float32) @ self.asked).astype(np.int32)
            phrase = marks("phrases", lo, hi, n_queries, bool)
            related = np.broadcast_to(self.total == 1, words.shape)
            if grammatical is not None:
                related = related | marks("grammatical", lo, hi, n_queries, bool)
            share = words / np.maximum(self.total, 1)
            factor = np.where((words > 0) & (self.total > 1), 1.0 - self.missing * (1.0 - share), 1.0)
            complete = (words == self.total) & (self.total > 0)
            factor = np.where(complete, np.where(related, self.boost, self.scattered), factor)
            return np.where(phrase, self.boost, factor), phrase, words

        return dense


class TopK:
    """Running best ``k`` rows for each of ``n`` queries over batches of one partition."""

    FIELDS = ("photo_id", "semantic", "similarity", "phrase", "words")

    def __init__(self, queries: np.ndarray, k: int, min_score: float | None, rounded: bool):
        self.queries = queries
        self.k = k
        self.min_score = min_score
        self.rounded = rounded
        self.kept: list[dict[str, np.ndarray] | None] = [None] * len(queries)
        self.scale = norms(queries) if len(queries) else np.zeros(0)

    def add(self, ids: np.ndarray, rows: np.ndarray, evidence=None, step: int | None = None) -> None:
        """Score one batch; ``evidence(lo, hi)`` gives dense factor, phrase and words of its rows."""
        if not len(self.queries):
            return
        step = step or max(1, MAX_CELLS // len(self.queries))
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            self._add(ids[lo:hi], rows[lo:hi], None if evidence is None else evidence(lo, hi))

    def _add(self, ids: np.ndarray, rows: np.ndarray, dense) -> None:
        rough = rows @ self.queries.T
        shape = rough.shape
        if dense is None:
            dense = np.ones(shape), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=np.int32)
        factor, phrase, words = dense
        slack = SLACK * (1.0 + norms(rows)[:, None] * self.scale[None, :])
        possible = np.ones(shape, dtype=bool) if self.min_score is None else rough >= self.min_score - slack
        final = np.where(possible, rough * factor, -np.inf)
        margin = slack + (1.01e-4 if self.rounded else 0.0)
        for q in range(len(self.queries)):
            column = final[:, q]
            reach = min(self.k, len(column))
            kth = np.partition(column, len(column) - reach)[len(column) - reach]
            held = self.kept[q]
            if held is not None and len(held["similarity"]) >= self.k:
                kth = max(kth, held["similarity"][-1])
            near = np.flatnonzero(possible[:, q] & (column >= kth - margin[:, q]))
            if not len(near):
                continue
            semantic = ordered_dots(rows[near], np.broadcast_to(self.queries[q], (len(near), rows.shape[1])))
            if self.min_score is not None:
                inside = semantic >= self.min_score
                near, semantic = near[inside], semantic[inside]
            score = semantic * factor[near, q]
            found = {
                "photo_id": ids[near],
                "semantic": semantic,
                "similarity": round4(score) if self.rounded else score,
                "phrase": phrase[near, q],
                "words": words[near, q],
            }
            if held is not None:
                found = {f: np.concatenate([held[f], found[f]]) for f in self.FIELDS}
            order = np.lexsort((found["photo_id"], -found["similarity"]))[: self.k]
            self.kept[q] = {f: found[f][order] for f in self.FIELDS}

    def result(self, query_ids: pa.Array) -> pa.RecordBatch:
        """The kept rows of all queries."""
        full = [(n, h) for n, h in enumerate(self.kept) if h is not None]
        counts = [len(h["photo_id"]) for _, h in full]

        def stack(field: str, dtype):
            return np.concatenate([h[field] for _, h in full]).astype(dtype) if full else np.zeros(0, dtype)

        positions = np.repeat(np.array([n for n, _ in full], dtype=np.int64), counts)
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(positions)),
                pa.array(stack("photo_id", np.int64)),
                pa.array(stack("semantic", np.float64)),
                pa.array(stack("similarity", np.float64)),
                pa.array(stack("phrase", bool)),
                pa.array(stack("words", np.int32)),
            ],
            names=["query_id", "photo_id", "semantic", "similarity", "phrase_matched", "word_matches"],
        )


def sparse_hits(column, query_ids: pa.Array):
    """Evidence of a batch from a list of structs for each row, as a function of a row range."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = _offsets(column)
    flat = column.flatten()
    known = pc.index_in(flat.field("query_id"), value_set=query_ids).fill_null(-1).to_numpy(zero_copy_only=False)
    factors, phrases, counts = (
        flat.field(n).to_numpy(zero_copy_only=False) for n in ("factor", "phrase_matched", "word_matches")
    )

    def dense(lo: int, hi: int):
        at = offsets[lo : hi + 1]
        part = slice(at[0], at[-1])
        keep = known[part] >= 0
        row, query = np.repeat(np.arange(hi - lo), np.diff(at))[keep], known[part][keep]
        shape = (hi - lo, len(query_ids))
        factor, phrase, words = np.ones(shape), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=np.int32)
        factor[row, query] = factors[part][keep]
        phrase[row, query] = phrases[part][keep]
        words[row, query] = counts[part][keep]
        return factor, phrase, words

    return dense


def term_finder(terms: list[str], phrases: list[tuple[str, list[int]]]):
    """A function from texts to list columns: numbers of the found terms, and of the queries whose phrase occurs.

    One pass over each text finds all terms and phrases at once, however many there are.
    """
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(term, (number, ()))
    for phrase, queries in phrases:
        automaton.add_word(phrase, (None, tuple(queries)))
    if len(automaton):
        automaton.make_automaton()

    def find(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        found_terms, found_queries = [], []
        for text in texts:
            hits = {hit for _, hit in automaton.iter(text)} if text and len(automaton) else ()
            found_terms.append([n for n, _ in hits if n is not None])
            found_queries.append([q for _, queries in hits for q in queries])
        return pa.array(found_terms, pa.list_(pa.int32())), pa.array(found_queries, pa.list_(pa.int32()))

    return find


def pairs_above(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, min_score: float):
    """``(query position, photo_id, score)`` of the pairs that reach ``min_score``, in parts.

    Rows are taken in steps, so that no more than ``MAX_CELLS`` scores are held at a time.
    """
    step = max(1, MAX_CELLS // max(1, len(queries)))
    scale = norms(queries).max(initial=0.0)
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        r, q = np.nonzero(part @ queries.T >= (min_score - SLACK * (1.0 + norms(part) * scale))[:, None])
        # Both sides of the pairs are spelled out, a row of numbers each.
        for lo in range(0, len(r), MAX_PAIRS):
            near, asked = r[lo:lo + MAX_PAIRS], q[lo:lo + MAX_PAIRS]
            score = ordered_dots(part[near], queries[asked])
            keep = score >= min_score
            yield asked[keep], ids[at + near[keep]], score[keep]


def nearest(rows: np.ndarray, refs: np.ndarray, numbers: np.ndarray):
    """For each row the reference at the smallest cosine distance, the first one on ties.

    ``refs`` are in the order of ``numbers``. Returns ``(ref_no, distance)``; the
    distance from or to a zero vector is infinite. Rows are taken in steps, so
    that no more than ``MAX_CELLS`` distances are held at a time.
    """
    ref_squares = ordered_dots(refs, refs)
    step = max(1, MAX_CELLS // max(1, len(refs)))
    found, distances = np.empty(len(rows), numbers.dtype), np.empty(len(rows))
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        scale = np.sqrt(ordered_dots(part, part)[:, None] * ref_squares[None, :])
        near = scale > 0
        rough = np.where(near, 1.0 - (part @ refs.T) / np.where(near, scale, 1.0), np.inf)
        r, c = np.nonzero(rough <= rough.min(axis=1, keepdims=True) + SLACK)
        exact = np.where(near[r, c], 1.0 - ordered_dots(part[r], refs[c]) / np.where(near[r, c], scale[r, c], 1.0), np.inf)
        order = np.lexsort((numbers[c], exact, r))
        _, first = np.unique(r[order], return_index=True)
        chosen = order[first]
        found[at:at + step], distances[at:at + step] = numbers[c[chosen]], exact[chosen]
    return found, distances
