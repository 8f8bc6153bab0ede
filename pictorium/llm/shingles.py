"""Word shingles of whole texts as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

SIZE = 5
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_random = np.random.default_rng(20240601)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(1, 1 << 63, SIZE + 1, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    power = np.full(int(lengths.max()), _POWER)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    found = np.add.reduceat(_BYTE[data[inside]] * power[place], first)
    return mix(found ^ lengths.astype(np.uint64) * _PLACE[SIZE]), counts


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one shingle where there are fewer than ``SIZE``."""
    found, counts = words(texts)
    spans = max(0, len(found) - SIZE + 1)
    grams = np.full(spans, SIZE, np.uint64)
    for j in range(SIZE):
        grams += found[j:j + spans] * _PLACE[j]
    grams = mix(grams)
    out, start = [], 0
    for n in counts.tolist():
        if n >= SIZE:
            out.append(np.unique(grams[start:start + n - SIZE + 1]))
        elif n:
            out.append(mix((found[start:start + n] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out
