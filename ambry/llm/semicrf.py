"""A semi-Markov conditional random field over short windows of tokens.

A window is cut into segments; a segment is one outside token, or up to
``longest`` tokens that are an entity of one kind. A segmentation's score is
the sum of its segments' weights, each over features of the whole span, so
"sixteen digits that pass the checksum" is one feature and not sixteen. Every
position looks back over at most ``longest`` tokens, and over the kinds, so the
work is linear in the window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

OUTSIDE = "-"
#: (start, end, kind, features) in tokens
Candidate = tuple[int, int, str, tuple[str, ...]]


@dataclass
class Lattice:
    """A window's candidate segments by their ends, with features as numbers."""

    size: int
    starts: list[int]
    ends: list[int]
    kinds: list[str]
    #: features of all candidates, one after the other, and whose each is
    features: np.ndarray
    owner: np.ndarray


def lattice(size: int, candidates: list[Candidate], number: Callable[[str], int | None]) -> Lattice:
    rows = sorted(candidates, key=lambda c: (c[1], c[0], c[2]))
    features: list[int] = []
    owner: list[int] = []
    for k, (_, _, kind, names) in enumerate(rows):
        for name in names:
            feature = number(f"{kind}|{name}")
            if feature is not None:
                features.append(feature)
                owner.append(k)
    return Lattice(
        size, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows],
        np.array(features, np.int64), np.array(owner, np.int64),
    )


def _scores(x: Lattice, weights: np.ndarray) -> list[float]:
    return np.bincount(x.owner, weights[x.features], len(x.starts)).tolist()


def best(x: Lattice, weights: np.ndarray) -> list[int]:
    """The candidates of the best segmentation; the shortest, first-named of equals."""
    scores = _scores(x, weights)
    gain = [-math.inf] * (x.size + 1)
    gain[0] = 0.0
    back = [-1] * (x.size + 1)
    for k, (start, end, score) in enumerate(zip(x.starts, x.ends, scores, strict=True)):
        if gain[start] + score > gain[end]:
            gain[end], back[end] = gain[start] + score, k
    out = []
    end = x.size
    while end > 0:
        out.append(back[end])
        end = x.starts[back[end]]
    return out[::-1]


def _add(a: float, b: float) -> float:
    """ln(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _chances(x: Lattice, weights: np.ndarray) -> np.ndarray:
    """The chance of each candidate over all segmentations."""
    scores = _scores(x, weights)
    forward = [-math.inf] * (x.size + 1)
    backward = [-math.inf] * (x.size + 1)
    forward[0] = backward[x.size] = 0.0
    rows = list(zip(x.starts, x.ends, scores, strict=True))
    for start, end, score in rows:
        forward[end] = _add(forward[end], forward[start] + score)
    # by ends, so all that start at a place come after all that end there
    for start, end, score in sorted(rows, key=lambda r: -r[0]):
        backward[start] = _add(backward[start], backward[end] + score)
    total = forward[x.size]
    return np.array([math.exp(min(0.0, forward[s] + v + backward[e] - total)) for s, e, v in rows])


def fit(windows: list[tuple[Lattice, list[int]]], n_features: int, rounds: int = 40, ridge: float = 0.05) -> np.ndarray:
    """Weights of the greatest likelihood, less a ridge, by steps along the gradient that each feature scales itself.

    ``windows`` are lattices with the candidates of their right segmentation.
    """
    weights = np.zeros(n_features)
    squares = np.full(n_features, 1e-6)
    right = np.zeros(n_features)
    for x, chosen in windows:
        right += np.bincount(x.features[np.isin(x.owner, chosen)], minlength=n_features)
    for _ in range(rounds):
        slope = right - ridge * weights
        for x, _ in windows:
            slope -= np.bincount(x.features, _chances(x, weights)[x.owner], n_features)
        squares += slope**2
        weights += 0.7 * slope / np.sqrt(squares)
    return weights
