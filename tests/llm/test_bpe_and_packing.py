import zlib
from array import array
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from tokenizers import Tokenizer

from .samples import noise
from pictorium.llm import bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Vocabulary(ranks, public_tokenizers.PATTERN), plain


def ids_of(numbers):
    return array("I", numbers).tobytes()


def test_ids_are_those_of_merging_by_rank(encoding):
    own, plain = encoding
    for seed in range(3000):
        text = noise(seed, seed % 30)
        assert own.encode(text) == ids_of(plain.encode_ordinary(text))
        assert own.decode(own.encode(text)) == text.encode()
    for text in ("a" * 20_000, "ab" * 5_000, "ß🙂" * 2_000):
        assert own.encode(text) == ids_of(plain.encode_ordinary(text))


def test_round_trip_of_a_table(odd_documents, encoding):
    _, plain = encoding
    found = bpe.round_trip(odd_documents, RANKS, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in odd_documents.collect()]
    expected = sorted((sha256(ids_of(plain.encode_ordinary(t))).hexdigest(), t.encode()) for t in texts)
    assert sorted((sha256(bytes(r.ids)).hexdigest(), bytes(r.decoded)) for r in found.collect()) == expected
    again = bpe.decode(found.select("doc_id", "ids"), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(t for _, t in expected)
    assert bpe.round_trip(odd_documents.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def packed(docs, window):
    return packing.pack_documents(docs, TOKENIZER, public_tokenizers.PATTERN, window=window, with_ids=True)


@pytest.mark.parametrize("window", [16, 2048])
def test_every_id_has_one_place(odd_documents, window):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = packed(odd_documents, window).collect()
    expected = sorted(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (1,) for r in odd_documents.collect())
    by_sequence, total = {}, 0
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, expected))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    sequences = packing.sequences(packed(odd_documents, window)).collect()
    assert sorted(s.n_tokens for s in sequences) == sorted(sum(n for _, n in p) for p in by_sequence.values())


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    texts = ["a text <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext| >", "  plain\n\n text ", "", *(noise(s, 40) for s in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = queries.op3_packing(spark, str(tmp_path)).collect()
    expected = [tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    assert sorted((r.doc_id, r.start, r.doc_tokens, r.ids_crc32) for r in found) == [(i, 0, len(e), zlib.crc32(ids_of(e))) for i, e in enumerate(expected)]


def test_empty_table_has_no_runs(odd_documents):
    assert packed(odd_documents.limit(0), 2048).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram_with_little_open(seed):
    chosen = np.random.default_rng(seed)
    window = 256
    histogram = np.zeros(window + 1, np.int64)
    lengths, counts = np.unique(np.minimum(chosen.geometric(1 / 60, 20_000), window), return_counts=True)
    histogram[lengths] = counts
    used = np.zeros_like(histogram)
    sequences = 0
    for combination, times in packing.plan(histogram, window):
        assert sum(combination) <= window and times > 0
        np.add.at(used, list(combination), times)
        sequences += times
    assert (used == histogram).all()
    assert sequences * window <= 1.01 * (histogram * np.arange(window + 1)).sum() + window


def test_least_squares_meet_a_histogram_that_pairs_exactly():
    window = 64
    histogram = np.zeros(window + 1, np.int64)
    histogram[[10, 54, 20, 44]] = [500, 500, 300, 300]
    used = packing.combinations(np.flatnonzero(histogram), window)
    counts = packing.repeat_counts(histogram, used)
    built = np.zeros(window + 1)
    for row, x in zip(used, counts):
        for n in row[row > 0]:
            built[n] += x
    assert np.abs(built - histogram).max() < 15


def test_texts_together_have_the_ids_of_the_tokenizer_and_words_are_cut_once():
    with open(TOKENIZER, "rb") as file:
        raw = file.read()
    words, plain = packing.Words(raw, public_tokenizers.PATTERN, True), Tokenizer.from_file(TOKENIZER)
    texts = [noise(seed, seed % 40) for seed in range(400)] + [None, "", " ", "one", " one", "one ", "a  b", "it's o'clock.\nNew\n line", "x <|endoftext|> y", "é\u00a0ü \u00a0z"]
    expected = [ids_of(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert words.encode_all(pa.array(texts, pa.string())) == expected
    assert words.encode_all(pa.array(["left out", *texts, "as well"], pa.string()).slice(1, len(texts))) == expected
    assert words.encode_all(pa.array([], pa.string())) == []
    cut, find = [], words.find
    words.find = lambda text: cut.append(text) or find(text)
    words.encode_all(pa.array(["same words again"] * 500, pa.string()))
    assert sum(t.count("again") for t in cut) == 1


def test_arrow_finds_the_texts_that_may_not_be_cut():
    texts = [f"a {chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["a ", " ", "", "a", "a \n", " a", "\n", "a  b", "a 🙂 b", "a \U000e0001"]
    found = pc.match_substring_regex(pa.array(texts), bpe.UNCUTTABLE).to_pylist()
    assert found == [not bpe.cuttable(t) for t in texts] and 20 < sum(found) < 40


def test_words_are_carried_over_in_one_string(monkeypatch):
    with open(TOKENIZER, "rb") as file:
        words = packing.Words(file.read(), public_tokenizers.PATTERN, True)
    joined, join = [], packing._joined
    monkeypatch.setattr(packing, "_joined", lambda values: joined.append(len(values)) or join(values))
    texts = ["one two three two", None, "two one", "four  blanks here", "x <|endoftext|> y"]
    plain = Tokenizer.from_file(TOKENIZER)
    assert words.encode_all(pa.array(texts)) == [ids_of(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert joined == [3]
