"""Boolean trigram queries from regular expressions, and an inverted index that answers them.

The index is over texts with A-Z lower-cased, and so are the queries: they let
through every text that can match, whatever the case, and the expression itself
decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as C
from re import _parser

import numpy as np

#: ALL: no trigram is mandatory.  Else a trigram (bytes), or ("and" | "or", frozenset of queries).
ALL = ("all",)
#: Literal strings that one part of an expression may stand for before they are turned into trigrams.
MOST_STRINGS = 64


def lower(text: bytes) -> bytes:
    return text.lower()  # bytes: A-Z only


def _folds(c: str, flags: int) -> bool:
    """Whether a character of an expression may match others than itself and, for A-Z, its other case.

    Without ASCII, letters of other scripts have cases of their own, and a few of
    them (a long s, the Kelvin sign, dotted and dotless i) match ASCII letters.
    """
    if not flags & re.IGNORECASE or flags & re.ASCII and c.isascii():
        return False
    return not c.isascii() or c in "iIkKsS"


def _join(kind: str, parts: Iterable) -> tuple | bytes:
    found = set()
    for p in parts:
        if p == ALL:
            if kind == "or":
                return ALL
        elif isinstance(p, tuple) and p[0] == kind:
            found |= p[1]
        else:
            found.add(p)
    if not found:
        return ALL
    return found.pop() if len(found) == 1 else (kind, frozenset(found))


def _of_string(s: str) -> tuple | bytes:
    b = lower(s.encode("utf-8"))
    return _join("and", [b[i : i + 3] for i in range(len(b) - 2)])


def _of_strings(strings: set[str]) -> tuple | bytes:
    return _join("or", [_of_string(s) for s in strings])


def _sequence(nodes, flags: int) -> tuple[set[str] | None, tuple | bytes]:
    """(the strings it can stand for, or None; what any match must hold)."""
    run: set[str] | None = {""}
    whole, needs = True, []
    for op, arg in nodes:
        strings, query = _node(op, arg, flags)
        if strings is not None and run is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        needs += [_of_strings(run or {""}), query]
        run = strings if strings is not None else {""}
    if whole:
        return run, _of_strings(run)
    return None, _join("and", [*needs, _of_strings(run)])


def _node(op, arg, flags: int) -> tuple[set[str] | None, tuple | bytes]:
    if op is C.LITERAL:
        return (None, ALL) if _folds(chr(arg), flags) else ({chr(arg)}, ALL)
    if op is C.IN:
        if flags & re.IGNORECASE and not flags & re.ASCII:
            return None, ALL
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is C.BRANCH:
        found = [_sequence(x, flags) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), ALL
        return None, _join("or", [_of_strings(s) if s is not None else q for s, q in found])
    if op is C.SUBPATTERN:
        return _sequence(arg[3], (flags | arg[1]) & ~arg[2])
    if op is C.ATOMIC_GROUP:
        return _sequence(arg, flags)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, query = _sequence(body, flags)
        if strings is not None and high == low and len(strings) == 1 and low <= MOST_STRINGS:
            return {next(iter(strings)) * low}, ALL
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ALL
        return None, (ALL if low == 0 else _of_strings(strings) if strings is not None else query)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def query(pattern: str, flags: int = 0) -> tuple | bytes:
    """The Boolean trigram query of an expression: every text with a match satisfies it."""
    parsed = _parser.parse(pattern, flags)
    strings, needs = _sequence(parsed, parsed.state.flags)
    return _of_strings(strings) if strings is not None else needs


def vocabulary(q: tuple | bytes) -> set[bytes]:
    if isinstance(q, bytes):
        return {q}
    return set().union(*map(vocabulary, q[1])) if q != ALL else set()


class TrigramIndex:
    """Postings of one shard of texts, over the trigrams that the rules' queries hold."""

    def __init__(self, trigrams: Iterable[bytes]) -> None:
        self.trigrams = sorted(trigrams)
        codes = np.array([int.from_bytes(t, "big") for t in self.trigrams], np.int64)
        self.number = np.zeros(1 << 24, np.uint16)
        self.number[codes] = np.arange(1, len(codes) + 1)
        self.postings: dict[bytes, np.ndarray] = {}
        self.size = 0

    def fill(self, blobs: list[bytes]) -> None:
        """Index a shard: which of its texts hold each trigram."""
        self.size, self.postings = len(blobs), {}
        joined = np.frombuffer(lower(b"\0\0".join(blobs)) + b"\0\0", np.uint8)
        ends = np.cumsum([len(b) + 2 for b in blobs])
        code = joined[:-2].astype(np.int32) << 16
        code |= joined[1:-1].astype(np.int32) << 8
        code |= joined[2:]
        found = self.number[code]
        at = np.nonzero(found)[0]
        pairs = np.unique(found[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        which, docs = pairs >> 32, pairs & 0xFFFFFFFF
        edges = np.searchsorted(which, np.arange(1, len(self.trigrams) + 2))
        for k, t in enumerate(self.trigrams):
            self.postings[t] = docs[edges[k] : edges[k + 1]]

    def candidates(self, q: tuple | bytes) -> np.ndarray:
        """The texts that satisfy a query, by intersecting and uniting postings."""
        if q == ALL:
            return np.arange(self.size)
        if isinstance(q, bytes):
            return self.postings[q]
        parts = sorted((self.candidates(p) for p in q[1]), key=len)
        if q[0] == "or":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)
