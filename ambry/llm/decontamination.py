"""Passages of a benchmark in documents, by the q-gram lemma and banded alignment.

A text region within ``k`` edits of a pattern of ``m`` characters shares at
least ``m + 1 - q (k + 1)`` q-grams with it, all on diagonals at most ``k``
apart. Shared q-grams are counted in overlapping bands of diagonals, bands
that reach the bound are kept, and a banded alignment verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import filter_rows, map_columns

Q = 8
ERROR = 0.1
#: patterns longer than this are looked for in overlapping windows of this many characters
WINDOW = 512
#: characters of a benchmark that are held at a time
BLOCK = 8_000_000
_SPACE = 32
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point: its small form if it is a letter or digit, else a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        mark = chr(code)
        if mark.isalnum():
            low = mark.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(characters, places): small letters and digits with one space between words.

    ``places`` says where each character stands in the text.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _folded()[codes]
    blank = codes == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    codes = codes[at]
    if codes.size and codes[-1] == _SPACE:
        codes, at = codes[:-1], at[:-1]
    return codes, at


def grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams as 64-bit numbers: eight low bytes. Equal q-grams are equal numbers."""
    n = codes.size - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    low = (codes & 0xFF).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out |= low[k:k + n] << np.uint64(8 * k)
    return out


def edits(pattern: np.ndarray, region: np.ndarray, slack: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``region`` nearest to ``pattern``, if within ``most``.

    Only diagonals up to ``slack`` are filled: the part may start anywhere in
    the first ``slack + 1`` characters.
    """
    same = region.tobytes().find(pattern.tobytes())
    if same >= 0 and same % 4 == 0 and same // 4 <= slack:
        return 0, same // 4, same // 4 + pattern.size
    far = most + 1
    width = slack + 2 * most + 1
    # column j stands for region position i + j - most after i pattern characters
    offset = np.arange(width) - most
    start = np.where(offset >= 0, offset, 0)
    cost = np.where((offset >= 0) & (offset <= slack), 0, far)
    cost = np.where(offset < 0, far, cost)
    n = region.size
    padded = np.concatenate([np.full(most + 1, 0xFFFFFFFF, np.uint32), region, np.full(width + pattern.size, 0xFFFFFFFF, np.uint32)])
    ramp = np.arange(width)
    for i in range(1, pattern.size + 1):
        seen = padded[i: i + width]  # region character i + j - most - 1
        here = i + offset
        step = cost + (seen != pattern[i - 1])
        up = np.append(cost[1:], far) + 1  # pattern character left out
        origin = np.where(up < step, np.append(start[1:], 0), start)
        best = np.minimum(step, up)
        best = np.where((here < 0) | (here > n), far + ramp[-1] + 1, best)
        # region character left out: a running minimum along the row
        key = (best - ramp) * (width + 1) * 4 + (width - ramp)
        low = np.minimum.accumulate(key)
        source = width - (low % ((width + 1) * 4))
        cost = np.minimum(best, best[source] + ramp - source)
        start = np.where(cost < best, origin[source], origin)
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    if cost[k] > most:
        return None
    end = pattern.size + int(offset[k])
    return int(cost[k]), int(start[k]), end


@dataclass
class Index:
    """All q-grams of some patterns, sorted, with a bit table in front."""

    items: list[int]
    patterns: list[np.ndarray]
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    most: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Index:
        items: list[int] = []
        patterns: list[np.ndarray] = []
        for item, text in rows:
            codes, _ = normalised(text)
            for window in windows(codes):
                items.append(item)
                patterns.append(window)
        all_keys = [grams(p) for p in patterns]
        keys = np.concatenate([*all_keys, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(patterns)), [k.size for k in all_keys])
        place = np.concatenate([*[np.arange(k.size) for k in all_keys], np.zeros(0, int)])
        order = np.argsort(keys, kind="stable")
        table = np.zeros(1 << _BITS, bool)
        table[_slot(keys)] = True
        sizes = np.array([p.size for p in patterns], np.int64)
        most = np.array([budget(n) for n in sizes.tolist()], np.int64)
        return cls(items, patterns, keys[order], owner[order], place[order], table, most, sizes + 1 - Q * (most + 1))

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each region of a text within the budget of a pattern."""
        codes, at = normalised(text)
        found = grams(codes)
        if not found.size or not self.keys.size:
            return []
        where = np.flatnonzero(self.table[_slot(found)])
        if not where.size:
            return []
        first = np.searchsorted(self.keys, found[where], "left")
        times = np.searchsorted(self.keys, found[where], "right") - first
        total = int(times.sum())
        if not total:
            return []
        entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(total)
        owner = self.owner[entry]
        place = self.place[entry]
        diagonal = np.repeat(where, times) - place + WINDOW
        return self._regions(codes, at, owner, place, diagonal)

    def _regions(self, codes, at, owner, place, diagonal) -> list[tuple[int, int, int, int]]:
        # bands of 2 (k + 1) diagonals, each overlapping the next by half: any k + 1 lie in one
        half = self.most + 1
        band = diagonal // half[owner]
        step = int(band.max()) + 2
        key = owner * step + band
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys, counted = key[first], np.diff(np.append(first, key.size))
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        both = counted + np.where(follows, np.append(counted[1:], 0), 0)
        dense = np.flatnonzero(both >= self.least[keys // step])
        out: list[tuple[int, int, int, int]] = []
        last, hits = -1, []
        for k in [*dense.tolist(), -1]:
            pattern, b = divmod(int(keys[k]), step) if k >= 0 else (-1, 0)
            if pattern != last:
                out += [(self.items[last], cost, int(at[start]), int(at[end - 1]) + 1) for cost, start, end in hits]
                last, hits = pattern, []
            if k < 0:
                break
            # a text that repeats itself meets the same few q-grams of the pattern again and again
            if np.unique(place[order[first[k]:first[k] + both[k]]]).size < self.least[pattern]:
                continue
            size, most, wide = self.patterns[pattern].size, int(self.most[pattern]), int(half[pattern])
            begin = max(0, b * wide - WINDOW - most)
            region = codes[begin:max(begin, (b + 2) * wide - WINDOW + size + most)]
            hit = edits(self.patterns[pattern], region, min(2 * wide + most, region.size), most)
            if hit is None:
                continue
            found = [hit[0], begin + hit[1], min(begin + hit[2], codes.size)]
            if hits and found[1] < hits[-1][2]:  # the same region, seen in two bands
                hits[-1] = min(hits[-1], found)
            else:
                hits.append(found)
        return out


def budget(size: int) -> int:
    """Edits that a pattern of ``size`` characters may have, so that the bound stays above zero."""
    return max(0, min(int(size * ERROR), (size - Q) // Q - 1))


def windows(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A pattern as it is, or in overlapping windows; none where it is shorter than two q-grams."""
    if codes.size <= WINDOW:
        if codes.size >= 2 * Q:
            yield codes
        return
    for start in range(0, codes.size - WINDOW // 2, WINDOW // 2):
        yield codes[start:start + WINDOW]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _SPREAD >> np.uint64(64 - _BITS)).astype(np.int64)


def blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[Index]:
    """Indexes of the benchmark (item_id, text), each of about ``limit`` characters.

    The whole size is added up first; a benchmark of any size is taken in that
    many blocks, of which one at a time is on the driver.
    """
    texts = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    for part in range(parts):
        mine = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]
        if rows:
            yield Index.of(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): benchmark passages found in documents.

    Letters and digits are compared, in either case, with words one space
    apart; start and end are code points of the text as it is. A passage of a
    long item counts by each of its windows. Null and empty texts, and items
    shorter than 16 characters, match nothing; each repeated document is
    matched again. Without a benchmark there are no rows.
    """
    schema = "doc_id long, item_id long, edits int, start int, end int"
    out = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            find = shared.value.find

            def apply(ids, texts):
                out = {k: [] for k in ("doc_id", "item_id", "edits", "start", "end")}
                for doc_id, text in zip(ids, texts, strict=True):
                    for hit in find(text):
                        for column, value in zip(out.values(), (doc_id, *hit), strict=True):
                            column.append(value)
                return out

            return apply

        found = map_columns(docs.select("doc_id", "text"), make, schema, text="text")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no passage of the benchmark is found; all columns stay."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            find = shared.value.find
            return lambda texts: [not find(t) for t in texts]

        docs = filter_rows(docs, make)
    return docs
