"""Spans of several kinds in a text, and their digests."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

Span = tuple[int, int, str]


def joined(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by the order of ``kinds``, then by end, with commas between."""
    order = {k: i for i, k in enumerate(kinds)}
    inside = sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in inside)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def matches(pattern: re.Pattern, text: str, kind: str, holds: Callable[[re.Match], bool]) -> list[Span]:
    """Leftmost non-overlapping matches that hold; one that fails is dropped without another try."""
    return [(m.start(), m.end(), kind) for m in pattern.finditer(text) if holds(m)]


class Covered:
    """The characters that some spans cover, for asking whether another one touches them."""

    def __init__(self, spans: Iterable[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start
