import hashlib
from collections import Counter

import numpy as np
import pytest

from pictorium.llm import suffix_dedup

from .samples import noise, prose


def plain(rows, length):
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 1])
def test_removed_bytes_equal_a_plain_count(documents, odd_documents, block):
    passage, line = prose(50, 90), prose(51, 12)
    rows = [(20 + i, prose(i, 40) + " " + passage[i:] + "\n" + line + "\n" + prose(100 + i, 30) + line) for i in range(12)]
    rows += [(60, "ab" * 400), (61, "x" * 250), (62, "é🙂" * 120), (63, noise(5, 300) * 2), (64, passage[:230] + passage[30:])]
    rows += [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id != 7]
    found = suffix_dedup.remove_repeats(documents(*rows), block=block)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, suffix_dedup.LENGTH)


def test_spans_and_kept_bytes_fit(documents):
    passage = prose(7, 80)
    found = suffix_dedup.remove_repeats(documents((1, "begin " + passage), (2, passage + " end")), with_bytes=True).collect()
    for r in found:
        text = {1: "begin " + passage, 2: passage + " end"}[r.doc_id].encode()
        for s in reversed(r.spans):
            text = text[:s.start] + text[s.stop:]
        assert bytes(r.kept) == text and r.n_spans == 1


def test_empty_table_and_bad_length(odd_documents):
    assert suffix_dedup.remove_repeats(odd_documents.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd_documents, length=20)


def test_radix_passes_find_equal_windows():
    chosen = np.random.default_rng(1)
    data = chosen.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(len(data) - 99)
    found = suffix_dedup.radix_groups(data, starts, np.zeros(len(starts), np.int64), 12)
    windows = [data[s:s + 12].tobytes() for s in starts]
    seen = Counter(windows)
    assert sorted(found.tolist()) == [s for s, w in zip(starts.tolist(), windows) if seen[w] > 1]
