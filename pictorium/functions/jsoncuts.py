"""Cutting JSON documents at arbitrary places: an automaton over (inside a string, depth).

What a piece of a document does to the state follows from its bytes alone, once
for either start, inside or outside a string; so pieces are looked at in any
order, and their effects are added up afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

QUOTE, BACKSLASH, OPEN_BRACE, CLOSE_BRACE, OPEN_LIST, CLOSE_LIST = b'"\\{}[]'
# Depths: 1 within the document, 2 within its list, 3 within an object of the list.
DOCUMENT, LIST, OBJECT = 1, 2, 3


def list_opening(key: str) -> re.Pattern:
    """The key of a list with its opening bracket; no string holds that, since its quotes would be escaped."""
    return re.compile(rb'"%s"\s*:\s*\[' % re.escape(key).encode())


@dataclass
class Marks:
    """Brackets of some bytes, for one start: where they stand, what they are, and the depth after each, from 0 at the start."""

    at: np.ndarray
    kind: np.ndarray
    depth: np.ndarray
    inside: bool  # a string is open at the end

    @property
    def rise(self) -> int:
        return int(self.depth[-1]) if len(self.depth) else 0


def quotes_and_brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that open or close strings, and places and kinds of all brackets, in strings as well."""
    b = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(b == QUOTE)
    slash = b == BACKSLASH
    if len(quote) and slash.any():
        # A quote is escaped after an odd run of backslashes.
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
        before = np.where(quote > 0, plain[quote - 1], quote - 1)
        quote = quote[(quote - 1 - before) % 2 == 0]
    bracket = np.flatnonzero((b == OPEN_BRACE) | (b == CLOSE_BRACE) | (b == OPEN_LIST) | (b == CLOSE_LIST))
    return quote, bracket, b[bracket]


def marks(found: tuple[np.ndarray, np.ndarray, np.ndarray], inside: bool) -> Marks:
    """The brackets that are not in strings, for a start inside or outside of one."""
    quote, bracket, kind = found
    outside = (np.searchsorted(quote, bracket) + inside) % 2 == 0
    at, kind = bracket[outside], kind[outside]
    up = (kind == OPEN_BRACE) | (kind == OPEN_LIST)
    return Marks(at, kind, np.cumsum(np.where(up, 1, -1)), bool((len(quote) + inside) % 2))


class Effect:
    """What the bytes seen so far do to the state, for a start outside (0) and inside (1) of a string.

    ``lists`` has for every opening of the wanted list its depth and the lowest
    depth after it, so that both are known once the depth at the start is.
    """

    def __init__(self, opening: re.Pattern):
        self.opening, self.inside, self.depth, self.least = opening, [False, True], [0, 0], [0, 0]
        self.lists: list[list[tuple[int, int]]] = [[], []]

    def add(self, data: bytes) -> None:
        found = quotes_and_brackets(data)
        starts = np.array([m.end() - 1 for m in self.opening.finditer(data)], np.int64)
        for way in (0, 1):
            m = marks(found, self.inside[way])
            base = self.depth[way]
            lowest = base + int(m.depth.min()) if len(m.depth) else base
            self.lists[way] = [(d, min(least, lowest)) for d, least in self.lists[way]]
            where = np.searchsorted(m.at, starts)
            for i in where[(where < len(m.at)) & (m.at[np.minimum(where, len(m.at) - 1)] == starts)] if len(m.at) and len(starts) else ():
                self.lists[way].append((base + int(m.depth[i]), base + int(m.depth[i:].min())))
            self.least[way] = min(self.least[way], lowest)
            self.depth[way] = base + m.rise
            self.inside[way] = m.inside


class Cutter:
    """Objects of the wanted list in bytes that come one piece after the other, from a known state.

    ``cut`` gives ``(number, whole, bytes)``: objects are numbered from 0 in order of
    their opening; the rest of an object that opened earlier has -1. What does
    not open and close here is not whole.
    """

    def __init__(self, opening: re.Pattern, inside: bool, depth: int, listed: bool):
        self.opening, self.inside, self.depth, self.listed = opening, inside, depth, listed
        self.number, self.held, self.begun_here = -1, [] if listed and depth >= OBJECT else None, False

    def cut(self, data: bytes):
        m = marks(quotes_and_brackets(data), self.inside)
        depth = m.depth + self.depth
        lists = {x.end() - 1 for x in self.opening.finditer(data)}
        turns = np.flatnonzero(
            ((m.kind == OPEN_BRACE) & (depth == OBJECT)) | ((m.kind == CLOSE_BRACE) & (depth == LIST))
            | ((m.kind == OPEN_LIST) & (depth == LIST)) | ((m.kind == CLOSE_LIST) & (depth == DOCUMENT))
        )
        begin = 0
        for at, kind in zip(m.at[turns].tolist(), m.kind[turns].tolist()):
            if kind == OPEN_LIST:
                self.listed = at in lists
            elif kind == CLOSE_LIST:
                self.listed = False
            elif self.listed and kind == OPEN_BRACE:
                self.number, self.held, self.begun_here, begin = self.number + 1, [], True, at
            elif self.held is not None:
                self.held.append(data[begin:at + 1])
                yield self._out(True)
        if self.held is not None:
            self.held.append(data[begin:])
        self.inside, self.depth = m.inside, self.depth + m.rise

    def _out(self, closed: bool) -> tuple[int, bool, bytes]:
        found = self.number if self.begun_here else -1, closed and self.begun_here, b"".join(self.held)
        self.held = None
        return found

    def rest(self):
        """What is open at the end."""
        if self.held is not None:
            yield self._out(False)
