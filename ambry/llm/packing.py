"""Packing documents into sequences of a fixed number of tokens.

The linear grouping scheme: large lengths are sorted and cut into groups of
equal cardinality, each rounded up to its longest; the few sizes that remain
are packed by an optimised mix of configurations (column generation over a
knapsack); actual pieces then take the places of the rounded ones, and small
pieces go into the gaps by best fit.

Only the histogram of lengths, at most ``capacity`` numbers, reaches the
driver. The plan it makes there names runs of equal sequences; pieces find
their place in it by their rank in the order of lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import map_columns
from ambry.llm.tokens import encoder, vocabulary
from ambry.operators.ordering import with_position
from ambry.session import cut

CAPACITY = 2048
GROUPS = 128
SMALL = 1 / 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids, longer ones cut.

    A null or empty text is the end id alone; a null doc_id is kept as null.
    """
    path = path or vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def make():
        encode = encoder(path).encode
        width = 4 * capacity

        def apply(ids, texts):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, data in zip(ids, encode(texts), strict=True):
                data += end
                for number, at in enumerate(range(0, len(data), width)):
                    part = data[at:at + width]
                    row = (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            return out

        return apply

    return map_columns(docs.select("doc_id", "text"), make, PIECES, text="text")


@dataclass
class Run:
    """``count`` sequences that each hold pieces of the same lengths."""

    count: int
    lengths: tuple[int, ...]
    gap: int


def grouped(lengths: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Longest first, in groups of equal cardinality: (longest, [[length, count], ...])."""
    total = sum(lengths.values())
    size = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            taken = min(room, left)
            out[-1][1].append([length, taken])
            room -= taken
            left -= taken
    return out


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    chosen: list[np.ndarray] = []
    for _ in range(capacity // min(sizes)):
        better, by = best.copy(), np.full(capacity + 1, -1)
        for k, (size, value) in enumerate(zip(sizes, values, strict=True)):
            if value > 0 and size <= capacity:
                with_it = best[: capacity + 1 - size] + value
                gain = with_it > better[size:] + 1e-12
                better[size:][gain] = with_it[gain]
                by[size:][gain] = k
        chosen.append(by)
        if (by < 0).all():
            break
        best = better
    pattern = np.zeros(len(sizes), int)
    at = capacity
    for by in reversed(chosen):
        if by[at] >= 0:
            pattern[by[at]] += 1
            at -= sizes[by[at]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern): whole copies of an optimal fractional mix of patterns.

    The simplex method over patterns, each new one found by a knapsack. The
    mix meets the demand but for a few pieces that rounding down leaves over.
    """
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    amount = need / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(n))
        value, pattern = best_pattern(sizes, dual, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-12, amount / np.where(step > 1e-12, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        amount = np.maximum(0, amount - ratio[leaves] * step)
        amount[leaves] = ratio[leaves]
        basis[:, leaves] = pattern
    return [(int(a + 1e-9), basis[:, k].astype(int)) for k, a in enumerate(amount) if a >= 1 - 1e-9]


def _take(stock: list[list[int]], wanted: int) -> list[tuple[int, int]]:
    """Actual lengths for ``wanted`` places of a group, longest first; 0 where it has run out."""
    out = []
    while wanted and stock:
        taken = min(wanted, stock[0][1])
        out.append((stock[0][0], taken))
        stock[0][1] -= taken
        wanted -= taken
        if not stock[0][1]:
            stock.pop(0)
    return [*out, (0, wanted)] if wanted else out


def _side_by_side(columns: list[list[tuple[int, int]]], copies: int, capacity: int) -> list[Run]:
    """Runs of equal sequences from one list of (length, count) per place."""
    out: list[Run] = []
    at = [0] * len(columns)
    used = [0] * len(columns)
    left = copies
    while left:
        span = min(columns[k][at[k]][1] - used[k] for k in range(len(columns)))
        lengths = tuple(columns[k][at[k]][0] for k in range(len(columns)) if columns[k][at[k]][0])
        out.append(Run(span, lengths, capacity - sum(lengths)))
        for k in range(len(columns)):
            used[k] += span
            if used[k] == columns[k][at[k]][1]:
                at[k], used[k] = at[k] + 1, 0
        left -= span
    return out


def best_fit(runs: list[Run], lengths: dict[int, int], capacity: int) -> list[Run]:
    """Puts pieces, longest first, each into the smallest gap that takes it."""
    by_gap: dict[int, list[Run]] = {}
    gaps: list[int] = []

    def add(run: Run) -> None:
        if run.gap not in by_gap:
            by_gap[run.gap] = []
            insort(gaps, run.gap)
        by_gap[run.gap].append(run)

    for run in runs:
        add(run)
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = min(left, capacity // length)
                count = left // each
                add(Run(count, (length,) * each, capacity - each * length))
                left -= count * each
                continue
            run = by_gap[gaps[k]].pop()
            if not by_gap[run.gap]:
                del by_gap[run.gap]
                gaps.pop(k)
            taken = min(left, run.count)
            if taken < run.count:
                add(Run(run.count - taken, run.lengths, run.gap))
            add(Run(taken, (*run.lengths, length), run.gap - length))
            left -= taken
    return [run for same in by_gap.values() for run in same]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs of sequences that hold exactly the pieces of the histogram."""
    large = {k: n for k, n in histogram.items() if small * capacity < k < capacity}
    runs = [Run(histogram[capacity], (capacity,), 0)] if histogram.get(capacity) else []
    rest = {k: n for k, n in histogram.items() if k <= small * capacity and n}
    if large:
        stock = grouped(large, groups)
        mix = configurations([s for s, _ in stock], [sum(n for _, n in g) for _, g in stock], capacity)
        for copies, pattern in mix:
            places = [k for k, times in enumerate(pattern) for _ in range(times)]
            runs += _side_by_side([_take(stock[k][1], copies) for k in places], copies, capacity)
        for _, group in stock:
            for length, count in group:
                rest[length] = rest.get(length, 0) + count
    return best_fit([r for r in runs if r.lengths], rest, capacity)


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """Where pieces go, by their position in the order of lengths.

    The pieces at positions ``at`` up to the next row's go to the sequences from
    ``sequence`` on, one each, at ``offset``. Rows grow with the capacity and
    with what the plan splits, not with the number of pieces.
    """
    rows = []
    sequence = 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rows.append((length, sequence, offset, run.count))
            offset += length
        sequence += run.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    count = table[:, 3]
    return {"at": np.cumsum(count) - count, "sequence": table[:, 1], "offset": table[:, 2]}


def pack(cut_up: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    Needs doc_id, piece, start and length; other columns stay. Sequences have
    no gap before their end. Equal pieces may trade places; an empty table
    packs into none. The placed rows are checkpointed before they are
    counted, so places stay the same when work is repeated.
    """
    held = with_position(cut_up, "length", "doc_id", "piece", "start")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(histogram, capacity, groups, small))
    context = cut_up.sparkSession.sparkContext
    shared = context.broadcast(table)

    def make():
        at, sequence, offset = (shared.value[k] for k in ("at", "sequence", "offset"))

        def apply(*columns):
            position = np.array(columns[-1], np.int64)
            row = np.searchsorted(at, position, "right") - 1
            out = dict(zip(names, columns, strict=False))
            out["sequence_id"] = sequence[row] + position - at[row]
            out["offset"] = offset[row]
            return out

        return apply

    names = cut_up.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema)
    return map_columns(held.drop("_block"), make, f"{fields}, sequence_id long, offset long", rows=20_000)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of documents with their place in sequences of ``capacity`` tokens."""
    return pack(cut(pieces(docs, capacity, path, end_id)), capacity)
