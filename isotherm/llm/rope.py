"""A rope: a text as a tree whose leaves cache how many units and code points they hold.

Trees are never changed; splitting and joining share what stays whole.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: units of a leaf
LEAF = 512


class Rope(NamedTuple):
    """A leaf (``text``), or two ropes one after the other."""

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, "")


class Units:
    """Units of a text: code points, or what starts at each match of a pattern (anything before the first belongs to it)."""

    def __init__(self, pattern: str | None = None):
        self.pattern = re.compile(pattern) if pattern else None

    def starts(self, text: str) -> list[int] | range:
        if self.pattern is None:
            return range(len(text))
        found = [m.start() for m in self.pattern.finditer(text) if m.end() > m.start()] or [0]
        return [0, *found[1:]] if text else []

    def leaf(self, text: str) -> Rope:
        return Rope(len(self.starts(text)), len(text), text)

    def build(self, text: str) -> Rope:
        """Leaves of ``LEAF`` units under a balanced tree."""
        starts = self.starts(text)
        ends = [*starts[LEAF::LEAF], len(text)]
        level = [Rope(min(LEAF, len(starts) - i * LEAF), b - starts[i * LEAF], text[starts[i * LEAF] : b]) for i, b in enumerate(ends)] if text else [EMPTY]
        while len(level) > 1:
            level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    def split(self, rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """What comes before the ``rank``-th unit (or code point, ``by="chars"``), and the rest; only the path to the cut is made anew."""
        if rank <= 0:
            return EMPTY, rope
        if rank >= getattr(rope, by):
            return rope, EMPTY
        if rope.text is not None:
            if by == "units" and self.pattern is not None:
                at = self.starts(rope.text)[rank]
                return Rope(rank, at, rope.text[:at]), Rope(rope.units - rank, rope.chars - at, rope.text[at:])
            return self.leaf(rope.text[:rank]), self.leaf(rope.text[rank:])
        size = getattr(rope.left, by)
        if rank < size:
            a, b = self.split(rope.left, rank, by)
            return a, join(b, rope.right)
        a, b = self.split(rope.right, rank - size, by)
        return join(rope.left, a), b


def join(*ropes: Rope) -> Rope:
    whole = EMPTY
    for r in ropes:
        if whole.chars == 0 or r.chars == 0:
            whole = r if whole.chars == 0 else whole
        else:
            whole = Rope(whole.units + r.units, whole.chars + r.chars, None, whole, r)
    return whole


def text_of(rope: Rope) -> str:
    out, left = [], [rope]
    while left:
        r = left.pop()
        if r.text is None:
            left += [r.right, r.left]
        else:
            out.append(r.text)
    return "".join(out)
