"""Runs of words in texts: stretches that repeat themselves with some period.

A run at least three periods long holds three neighbours of every grid whose
mesh is its period, so for each period the places of its grid are candidates,
in all a harmonic sum of them. Candidates at which a few words agree with those
a period later are extended exactly, to both sides, by common extensions on a
grammar of the words (``recompression``). Neither suffix arrays nor hashes that
could agree by chance are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ambry.llm.batches import map_columns
from ambry.llm.recompression import Grammar

LEAST = 24
REPEATS = 3
#: texts of more words have their grid made in parts of about this many places
PLACES = 300_000
_LOOK = 5
_CHARS = 1_000_000


def mesh(period: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The widest multiple of a period of which three fit into its shortest run."""
    return period * np.maximum(1, least // REPEATS // period)


def grid(n: int, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) for a text of ``n`` words, in parts of bounded size."""
    low = 1
    while low <= n // REPEATS:
        periods = np.arange(low, n // REPEATS + 1)
        counts = (n - periods - 1) // mesh(periods, least) + 1
        taken = max(1, int(np.searchsorted(np.cumsum(counts), PLACES, "right")))
        periods, counts = periods[:taken], counts[:taken]
        each = np.repeat(periods, counts)
        within = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield (within * np.repeat(mesh(periods, least), counts)).astype(np.int32), each.astype(np.int32)
        low += taken


class Grids:
    """Grids of texts up to some length, made once: a prefix of a table sorted by the place a period later."""

    def __init__(self, longest: int, least: int = LEAST):
        parts = list(grid(longest, least))
        places, periods = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(places + periods, kind="stable")
        self.places, self.periods = places[order], periods[order]
        self.ends = np.searchsorted((places + periods)[order], np.arange(longest + 1))
        self.longest, self.least = longest, least

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n > self.longest:
            yield from grid(n, self.least)
            return
        periods = self.periods[:self.ends[n]]
        short = periods <= n // REPEATS
        yield self.places[:self.ends[n]][short], periods[short]


def _candidates(codes: np.ndarray, grids: Grids) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the grid at which ``_LOOK`` words are those a period later. A shortest run has more of them."""
    n = len(codes)
    for place, period in grids.of(n):
        for ahead in range(_LOOK):
            there = place + period + ahead
            good = there < n
            good[good] = codes[place[good] + ahead] == codes[there[good]]
            place, period = place[good], period[good]
        if len(place):
            yield place.astype(np.int64), period.astype(np.int64)


def runs_of(texts: list[np.ndarray], grids: Grids) -> list[np.ndarray]:
    """For each sequence of word numbers its runs as rows (start, length, period), by start and period."""
    least = grids.least
    found: list[list[np.ndarray]] = [[] for _ in texts]
    # all sequences in one, with a symbol of its own before each and after the last
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    whole = np.empty(begins[-1], np.int64)
    whole[begins - 1] = top + np.arange(len(begins))
    for begin, codes in zip(begins, texts, strict=False):
        whole[begin:begin + len(codes)] = codes
    grammar = None
    for number, codes in enumerate(texts):
        if len(codes) < least:
            continue
        for place, period in _candidates(codes, grids):
            grammar = grammar or Grammar(whole)
            at = place + begins[number]
            before = grammar.backward(at - 1, at + period - 1)
            length = period + before + grammar.forward(at, at + period)
            good = length >= np.maximum(least, REPEATS * period)
            rows = np.stack([place - before, length, period], 1)[good]
            found[number].append(np.unique(rows, axis=0))
    out = []
    for rows in found:
        if not rows:
            out.append(np.zeros((0, 3), np.int64))
            continue
        rows = np.unique(np.concatenate(rows), axis=0)
        # the same stretch is found again by multiples of its period
        other = np.ones(len(rows), bool)
        other[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        out.append(rows[other])
    return [rows[np.lexsort((rows[:, 2], rows[:, 0]))] for rows in out]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    Words are what spaces, tabs, line feeds, vertical tabs, form feeds and
    carriage returns leave. ``runs`` are (start, length, period) in words, by
    start and period: stretches of at least ``least`` words and three times
    their smallest period that no word beside them continues. ``collapsed`` is
    the text without the words that lie in a run behind its first period, one
    space between words. Runs may overlap. A null or empty text has no words
    and collapses to the empty one. Rows are looked at one by one, so repeated
    rows repeat their answer; columns besides doc_id and text are left out; an
    empty table gives no rows. Memory grows with the longest text, by some hundred bytes a word.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def make():
        grids = Grids(8_192, least)
        keys = ("start", "length", "period")

        def apply(ids, texts):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            number: dict[bytes, int] = {}
            coded = [
                np.fromiter((number.setdefault(w, len(number)) for w in row), np.int64, len(row)) for row in words
            ]
            out = {"doc_id": ids, "n_words": [len(row) for row in words], "runs": [], "collapsed": []}
            for row, runs in zip(words, runs_of(coded, grids), strict=True):
                if len(runs):
                    row = [w for w, gone in zip(row, dropped(len(row), runs).tolist(), strict=True) if not gone]
                out["runs"].append([dict(zip(keys, r, strict=True)) for r in runs.tolist()])
                out["collapsed"].append(b" ".join(row).decode("utf-8", "surrogatepass"))
            return out

        return apply

    return map_columns(docs.select("doc_id", "text"), make, schema, text="text", chars=_CHARS)
