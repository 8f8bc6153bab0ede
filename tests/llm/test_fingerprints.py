"""Fingerprints against loops over bins and against true similarities."""

import random
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from pictorium.llm import fingerprints, shingles
from pictorium.llm.queries import QUERIES

from .samples import prose


def plain_print(found):
    """Bits of a set by loops: smallest hash of each bin, the first full bin in its order for an empty one."""
    if not len(found):
        return b""
    least = {}
    for h in map(int, found):
        least[h >> 54] = min(h, least.get(h >> 54, h))
    bits = 0
    for i in range(fingerprints.BINS):
        at = i if i in least else next(
            b for t in range(fingerprints.BINS) if (b := int(fingerprints.START[i] + t * fingerprints.STEP[i]) % fingerprints.BINS) in least
        )
        mixed = shingles.mix(np.array([least[at] ^ int(fingerprints._TURN[i])], np.uint64))
        bits |= (int(mixed[0]) & 3) << (2 * i)
    return bits.to_bytes(fingerprints.WIDTH, "little")


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bits_equal_loops():
    texts = [prose(i, n).encode() for i, n in enumerate([1, 3, 5, 6, 20, 60, 70, 80, 500, 5000])] + [b"", b" \n"]
    for text, got in zip(texts, fingerprints.prints(texts)):
        assert got == plain_print(shingles.sets([text.lower()])[0])


def test_likeness_is_unbiased_at_every_length():
    chosen = random.Random(4)
    for size, spread in ((12, 0.12), (60, 0.07), (400, 0.035), (4000, 0.03)):
        off = []
        for k in range(60):
            words = prose(1000 * size + k, size).split()
            other = list(words)
            for _ in range(chosen.randint(0, size // 8)):
                other[chosen.randrange(size)] = "changed%d" % chosen.randrange(10**6)
            a, b = " ".join(words), " ".join(other)
            (got,) = fingerprints.likeness(*([fingerprints.prints([t.encode()])[0]] for t in (a, b)))
            off.append(got - jaccard(a, b))
        assert abs(np.mean(off)) < spread / 4 and np.sqrt(np.mean(np.square(off))) < spread, (size, np.mean(off), np.std(off))


def test_odd_fingerprints():
    one, same, empty = fingerprints.prints([b"A b", b"a  B", b""])
    assert one == same and len(one) == fingerprints.WIDTH and empty == b""
    assert fingerprints.likeness([empty, empty, one, one], [empty, one, empty, same]) == [1.0, 0.0, 0.0, 1.0]
    assert fingerprints.likeness([], []) == []
    unlike = fingerprints.prints([t.encode() for t in (prose(1, 900), prose(2, 900))])
    assert fingerprints.likeness(unlike[:1], unlike[1:])[0] < 0.1


def plain_edits(rows):
    """Per id, in descending order: code points, digest of the edited text, and both texts' neighbours."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = {}
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        found[doc] = len(text), sha256(changed.encode()).hexdigest(), text, changed, following
    return found


def test_edits_equal_plain_ones(spark, documents, tmp_path):
    rows = [(i, prose(i, random.Random(i).choice([0, 1, 4, 30, 300]))) for i in range(0, 120, 2)]
    rows += [(1, None), (3, "漢字🙂é" * 7), (5, rows[10][1]), (None, "the last of all of them"), (501, prose(9, 60_000)), (-7, " \n ")]
    chosen = random.Random(1)
    chosen.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        documents(*rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
        found = QUERIES["op12_fingerprints"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len(rows)
    wanted = plain_edits(rows)
    prints = lambda t: fingerprints.prints([t.encode()])[0].hex()
    for r in found:
        n, digest, text, changed, following = wanted[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, digest, prints(text), prints(changed))
        assert abs(r.near_edited - jaccard(text, changed)) < 0.2 and abs(r.near_next - jaccard(text, following)) < 0.2


def test_ties_repeats_and_lone_rows(spark, documents, odd_documents):
    found = fingerprints.edited(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in odd_documents.collect())
    # Repeated rows: all but the last of them are followed by their own text.
    many = documents(*[(4, "one two three four five six seven")] * 40, (3, "else"))
    got = fingerprints.edited(many.repartition(3)).collect()
    assert sum(r.near_next == 1.0 for r in got) == 39 and len(got) == 41
    (alone,) = fingerprints.edited(documents((9, "abcdef"))).collect()
    assert alone.edited_sha256 == sha256(b"abcdab").hexdigest() and alone.near_next == 1.0
    assert fingerprints.edited(many.limit(0)).collect() == []


def test_fingerprints_of_rows(odd_documents):
    found = fingerprints.fingerprints(odd_documents).groupBy("fingerprint").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == odd_documents.count()
    # Equal sets: the prose of five rows and its upper-case form; null, empty and blank texts.
    assert sorted(r.n for r in found)[-2:] == [4, 5] and {len(r.fingerprint) for r in found} == {0, fingerprints.WIDTH}
