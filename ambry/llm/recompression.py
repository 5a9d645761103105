"""A run-length grammar of a sequence by recompression, and longest common extensions on it.

Two steps alternate until no symbol occurs twice. Block compression gives every
maximal block of one symbol a symbol of its own. Pair compression splits the
symbols in two sides and gives every pair of a left and a right one a symbol.
Both decide where to cut by nothing but the two symbols beside the cut, so
equal stretches are cut alike but for the symbols at their ends, and two
places of the sequence can be compared by whole symbols of the highest level
on which they are cut alike.

The levels are arrays, so any number of questions is answered together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = 0x9E3779B97F4A7C15


@dataclass
class Level:
    """A sequence of symbols, and how the next level is made of it.

    ``sizes`` are expanded lengths; ``parent`` is the place of a symbol's parent in
    the next level, ``child`` and ``count`` are the first symbol of each parent and
    how many it has. ``blocks`` says which of the two steps made the next level.
    """

    symbols: np.ndarray
    sizes: np.ndarray
    blocks: bool = False
    parent: np.ndarray | None = None
    child: np.ndarray | None = None
    count: np.ndarray | None = None

    def mirrored(self) -> Level:
        """The level read from its end."""
        if self.parent is None:
            return Level(self.symbols[::-1], self.sizes[::-1])
        last = self.child[::-1] + self.count[::-1] - 1
        return Level(
            self.symbols[::-1], self.sizes[::-1], self.blocks, (len(self.count) - 1 - self.parent)[::-1],
            len(self.symbols) - 1 - last, self.count[::-1],
        )


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """The side of each symbol, the same wherever it stands: one bit of a hash."""
    mixed = (symbols.astype(np.uint64) + np.uint64((turn + 1) * _ODD % 2**64)) * np.uint64(_ODD)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_ODD)
    return (mixed >> np.uint64(63)).astype(bool)


class Grammar:
    """The levels over ``codes``, numbers from 0; the first and the last must occur nowhere else."""

    def __init__(self, codes: np.ndarray):
        self.levels = [Level(codes.astype(np.int64), np.ones(len(codes), np.int32))]
        self.names = int(codes.max()) + 1
        turn = 0
        while np.bincount(self.levels[-1].symbols).max() > 1:
            self._compress_blocks()
            self._compress_pairs(turn)
            turn += 1
        self._backward: list[Level] | None = None

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New symbols, equal where the keys are."""
        found, at = np.unique(keys, return_inverse=True)
        self.names += len(found)
        return at + (self.names - len(found))

    def _add(self, first: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        below = self.levels[-1]
        child = np.flatnonzero(first).astype(np.int32)
        below.blocks = blocks
        below.parent = (np.cumsum(first) - 1).astype(np.int32)
        below.child = child
        below.count = np.diff(np.append(child, len(first))).astype(np.int32)
        self.levels.append(Level(symbols, np.add.reduceat(below.sizes, child)))

    def _compress_blocks(self) -> None:
        symbols = self.levels[-1].symbols
        first = np.append(True, symbols[1:] != symbols[:-1])
        if first.all():
            return
        heads = np.flatnonzero(first)
        count = np.diff(np.append(heads, len(symbols)))
        above = symbols[heads]
        long = count > 1
        # a block's number of copies is at most the length of the sequence
        above[long] = self._named(above[long] * (len(symbols) + 1) + count[long])
        self._add(first, above, True)

    def _compress_pairs(self, turn: int) -> None:
        symbols = self.levels[-1].symbols
        left = ~_sides(symbols, turn)
        pair = left[:-1] & ~left[1:]
        other = ~left[:-1] & left[1:]
        if np.count_nonzero(other) > np.count_nonzero(pair):
            pair = other
        if not pair.any():
            return
        heads = np.flatnonzero(pair)
        above = symbols.copy()
        above[heads] = self._named(symbols[heads] * np.int64(self.names) + symbols[heads + 1])
        first = np.append(True, ~pair)
        self._add(first, above[first], False)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on, for arrays of places; a and b differ."""
        return _common(self.levels, a, b)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to and with ``a`` equal those up to and with ``b``."""
        if self._backward is None:
            self._backward = [x.mirrored() for x in self.levels]
        last = len(self.levels[0].symbols) - 1
        return _common(self._backward, last - a, last - b)


def _step(level: Level, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Places to go on where symbols are equal: one of a pair, or all that two blocks have in common."""
    if not level.blocks:
        return equal.astype(np.int64)
    left = [level.child[level.parent[x]] + level.count[level.parent[x]] - x for x in (a, b)]
    return np.where(equal, np.minimum(*left), 0)


def _common(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a), np.int64)
    who = np.arange(len(a))
    stopped: list[tuple[np.ndarray, ...]] = []
    for level in levels:
        equal = level.symbols[a] == level.symbols[b]
        if level.parent is None:  # no symbol occurs twice here
            stopped.append((who, a, b))
            break
        # both begin a symbol of the next level, or they go on to where they do
        begin = (level.child[level.parent[a]] == a) & (level.child[level.parent[b]] == b)
        step = np.where(begin, 0, _step(level, a, b, equal))
        total[who] += step * level.sizes[a]
        a, b = a + step, b + step
        alike = level.symbols[a] == level.symbols[b]
        stopped.append((who[~alike], a[~alike], b[~alike]))
        who, a, b = who[alike], level.parent[a[alike]], level.parent[b[alike]]
        if not len(who):
            break
    # symbols differ here, and below them is where: whole equal children first
    who, a, b = stopped.pop()
    while stopped:
        level = levels[len(stopped) - 1]
        a, b = level.child[a], level.child[b]
        step = _step(level, a, b, level.symbols[a] == level.symbols[b])
        total[who] += step * level.sizes[a]
        more = stopped.pop()
        who, a, b = (np.concatenate(x) for x in zip((who, a + step, b + step), more, strict=True))
    return total
