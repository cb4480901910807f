"""A bounded cache from pieces of text to their encodings."""

from __future__ import annotations

from collections.abc import Callable

#: Entries in each of the two generations of a cache.
GENERATION = 200_000
#: Longer pieces are worked out anew each time, so that entries stay small.
LONGEST = 64


class PieceCache(dict):
    """Two generations: entries used since the last turn survive the next one.

    ``cache[piece]`` calls `make(piece)` for what it does not hold.  Memory is
    bounded by 2 * `size` entries of at most `longest` characters each; the
    bound changes speed only, never a result.
    """

    def __init__(self, make: Callable, size: int = GENERATION, longest: int = LONGEST) -> None:
        super().__init__()
        self.make, self.size, self.left, self.longest, self.old = make, size, size, longest, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
            if len(piece) > self.longest:
                return found
        self[piece] = found
        self.left -= 1
        if not self.left:
            self.old, self.left = dict(self), self.size
            self.clear()
        return found
