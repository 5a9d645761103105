"""Packing by shallow combinations of lengths: non-negative least squares.

All combinations of at most three lengths that fill a sequence exactly are
enumerated, and how often each is to be used is the non-negative
least-squares solution against the histogram of lengths. The counts are
rounded to what is there, and what is left over is packed greedily, longest
first. There a piece may be cut where nothing fits a gap, and the rest of the
last sequence is cut into powers of two, which need no padding, so none is
padded at all.

Only the histogram reaches the driver. The plan made of it names ranks in the
order of lengths; pieces find their places by their rank.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import map_columns
from ambry.llm.byte_tokens import BYTE_BPE, encoder
from ambry.llm.storage import stored
from ambry.llm.tokens import vocabulary
from ambry.operators.ordering import with_position

CAPACITY = 2048
#: columns that enter the solution together, and how often some may
WAVE = 256
ROUNDS = 40
#: steps of a least-squares solution
STEPS = 100
#: relative size of what is left unexplained at which the solution is good enough
CLOSE = 1e-3
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths from ``present``, 0 for none, that add up to ``capacity``; longest first."""
    held = np.zeros(capacity + 1, bool)
    held[present] = True
    out = [np.array([[capacity, 0, 0]], np.int64)] if held[capacity] else []
    half = present[(2 * present >= capacity) & (present < capacity)]
    half = half[held[capacity - half]]
    out.append(np.stack([half, capacity - half, np.zeros_like(half)], 1))
    for longest in present.tolist():
        rest = capacity - longest
        second = present[(present <= longest) & (2 * present >= rest) & (present < rest)]
        second = second[held[rest - second]]
        if second.size:
            out.append(np.stack([np.full_like(second, longest), second, rest - second], 1))
    return np.concatenate(out)


def _disjoint(columns: np.ndarray, most: int) -> list[int]:
    """The first columns that share no length with those taken before them."""
    used: set[int] = {0}
    out = []
    for k, column in enumerate(columns.tolist()):
        new = set(column) - {0}
        if not new & used:
            used |= new
            out.append(k)
            if len(out) == most:
                break
    return out


def _totals(columns: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """How many pieces of each length so many repeats of the columns hold."""
    out = np.bincount(columns.ravel(), np.repeat(times, 3), size)
    out[0] = 0
    return out


def _least_squares(columns: np.ndarray, times: np.ndarray, demand: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The times, of either sign, that come nearest to ``demand``: conjugate gradients from ``times`` on.

    A column has three entries, so nothing but the columns is ever stored.
    """
    def along(short):
        return (square * short)[columns].sum(axis=1)

    scale = np.maximum(along(np.ones(len(demand))), 1e-12)
    rest = along(demand - _totals(columns, times, len(demand)))
    way = rest / scale
    size = rest @ way
    close = 1e-10 * max(float(along(demand) @ (along(demand) / scale)), 1e-300)
    for _ in range(STEPS):
        if size <= close:
            break
        there = along(_totals(columns, way, len(demand)))
        step = size / (way @ there)
        times = times + step * way
        rest = rest - step * there
        before, size = size, rest @ (rest / scale)
        way = rest / scale + (size / before) * way
    return times


def repeats(columns: np.ndarray, demand: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times): non-negative times for which the columns come nearest to ``demand``, by weighted squares.

    The active-set method: columns along which the error falls fastest enter,
    a wave of them together that share no length, the least-squares solution
    over all that are in is taken as far as it stays positive, and columns that
    reach zero leave. It ends when no column improves, when little is left, or after ``rounds``,
    which costs sequences that are packed by combination but never a piece.
    """
    size = len(demand)
    square = weight**2
    square[0] = 0
    inside = np.zeros(0, np.int64)
    times = np.zeros(0)
    for _ in range(rounds):
        short = demand - _totals(columns[inside], times, size)
        if np.abs(short).sum() <= CLOSE * demand.sum():
            break
        gain = (square * short)[columns].sum(axis=1)
        gain[inside] = 0
        best = np.argsort(-gain, kind="stable")[:32 * WAVE]
        best = best[gain[best] > 1e-9]
        if not best.size:
            break
        enter = best[_disjoint(columns[best], WAVE)]
        inside, times = np.append(inside, enter), np.append(times, np.zeros(len(enter)))
        while inside.size:
            solution = _least_squares(columns[inside], times, demand, square)
            down = solution <= 0
            if not down.any():
                times = solution
                break
            step = min(1.0, float(np.min(times[down] / np.maximum(times[down] - solution[down], 1e-300))))
            times = times + step * (solution - times)
            stay = ~(down & (times <= 1e-9))
            inside, times = inside[stay], np.maximum(times[stay], 0)
    return columns[inside], times


@dataclass
class Stock:
    """Pieces of each length that have no place yet, as stretches of ranks.

    A stretch is (first rank, count, start, cuts): ``start`` is where in the
    piece the rest begins that ``cuts`` cuts have left.
    """

    held: dict[int, list[list[int]]] = field(default_factory=dict)
    count: dict[int, int] = field(default_factory=dict)

    def add(self, length: int, stretch: list[int]) -> None:
        self.held.setdefault(length, []).append(stretch)
        self.count[length] = self.count.get(length, 0) + stretch[1]

    def take(self, length: int, count: int) -> list[list[int]]:
        out = []
        self.count[length] -= count
        if not self.count[length]:
            del self.count[length]
        stretches = self.held[length]
        while count:
            at, n, start, cuts = stretches[-1]
            taken = min(n, count)
            out.append([at + n - taken, taken, start, cuts])
            stretches[-1][1] -= taken
            if not stretches[-1][1]:
                stretches.pop()
            count -= taken
        return out


class Plan:
    """Places of pieces: rows (cuts, first rank, count, start, length, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0
        self.stock = Stock()
        rank = 0
        for length in sorted(k for k, n in histogram.items() if n):
            self.stock.add(length, [rank, histogram[length], 0, 0])
            rank += histogram[length]
        self._combine()
        self._greedy()

    def _put(self, stretches: list[list[int]], length: int, sequence: int, offset: int) -> None:
        for at, count, start, cuts in stretches:
            self.rows.append((cuts, at, count, start, length, sequence, offset))
            sequence += count

    def _fill(self, lengths: list[int], count: int) -> None:
        """``count`` sequences of whole pieces of these lengths."""
        offset = 0
        for length in lengths:
            self._put(self.stock.take(length, count), length, self.sequences, offset)
            offset += length
        self.sequences += count

    def _combine(self) -> None:
        demand = np.zeros(self.capacity + 1)
        for length, count in self.stock.count.items():
            demand[length] = count
        present = np.flatnonzero(demand)
        columns = combinations(present, self.capacity) if present.size else np.zeros((0, 3), np.int64)
        if not len(columns):
            return
        # long pieces are the hard ones to place later
        chosen, times = repeats(columns, demand, np.sqrt(0.1 + np.arange(self.capacity + 1) / self.capacity))
        for k in np.argsort(-times, kind="stable").tolist():
            lengths = [x for x in chosen[k].tolist() if x]
            room = min(self.stock.count.get(x, 0) // lengths.count(x) for x in lengths)
            count = min(round(float(times[k])), room)
            if count:
                self._fill(lengths, count)

    def _greedy(self) -> None:
        while self.stock.count:
            free = dict(self.stock.count)
            ordered = sorted(free)
            lengths: list[int] = []
            gap = self.capacity
            while gap:
                k = int(np.searchsorted(ordered, gap, "right")) - 1
                if k < 0:
                    break
                each = min(gap // ordered[k], free[ordered[k]])
                lengths += [ordered[k]] * each
                gap -= each * ordered[k]
                free[ordered[k]] -= each
                if not free[ordered[k]]:
                    ordered.pop(k)
            if gap and not ordered:
                self._last(lengths)  # all that is left
                return
            times = min(self.stock.count[x] // lengths.count(x) for x in set(lengths))
            if gap:
                longer = ordered[0]  # the shortest of those that do not fit
                times = min(times, self.stock.count[longer] // (lengths.count(longer) + 1))
                self._cut_into(lengths, gap, longer, times)
            else:
                self._fill(lengths, times)

    def _cut_into(self, lengths: list[int], gap: int, longer: int, times: int) -> None:
        """Sequences of these lengths and the first ``gap`` tokens of a longer piece each."""
        first = self.sequences
        self._fill(lengths, times)
        stretches = self.stock.take(longer, times)
        self._put(stretches, gap, first, self.capacity - gap)
        for at, count, start, cuts in stretches:
            self.stock.add(longer - gap, [at, count, start + gap, cuts + 1])

    def _last(self, lengths: list[int]) -> None:
        """Too little for a sequence: cut into powers of two."""
        total = sum(lengths)
        rooms = [1 << k for k in range(self.capacity.bit_length(), -1, -1) if total >> k & 1]
        offset = 0
        for length in lengths:
            ((at, _, start, cuts),) = self.stock.take(length, 1)
            while length:
                part = min(length, rooms[0] - offset)
                self._put([[at, 1, start, cuts]], part, self.sequences, offset)
                length, start, cuts, offset = length - part, start + part, cuts + 1, offset + part
                if offset == rooms[0]:
                    rooms.pop(0)
                    self.sequences, offset = self.sequences + 1, 0

    def tables(self) -> list[dict[str, np.ndarray]]:
        """A table of places for each number of cuts before a part, sorted by rank."""
        out = []
        for cuts in range(max((r[0] for r in self.rows), default=-1) + 1):
            rows = np.array(sorted(r[1:] for r in self.rows if r[0] == cuts), np.int64).reshape(-1, 6)
            out.append(dict(zip(("at", "count", "start", "length", "sequence", "offset"), rows.T, strict=True)))
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): token ids of documents in pieces of ``capacity`` and a rest.

    ``ids`` are little-endian unsigned integers where a piece may still be cut, and null where it is full. They take
    two bytes each where the vocabulary allows it; ``ids_crc32`` is of four.
    """
    path = path or vocabulary(BYTE_BPE)
    end = int(end_id).to_bytes(4, "little")

    def make():
        held = encoder(path)
        encode = held.encode
        width = 4 * capacity
        short = max(held.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16

        def kept(part):
            if len(part) == width:
                return None
            return np.frombuffer(part, "<u4").astype("<u2").tobytes() if short else part

        def apply(ids, texts):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, data in zip(ids, encode(texts), strict=True):
                data += end
                for at in range(0, len(data), width):
                    part = data[at:at + width]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, kept(part))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            return out

        return apply

    return map_columns(docs.select("doc_id", "text"), make, PIECES, text="text")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the pieces of ``docs`` (doc_id, text).

    Each id of a document, ``end_id`` included, lies in one piece. A sequence
    holds ``capacity`` ids, but for at most one of each smaller power of two. A
    null or empty text is the end id alone; a null doc_id stays null; repeated
    rows are packed each; equal pieces may trade places; other columns are left
    out; an empty table packs into none. Pieces are written once and their ranks checkpointed, so places stay
    the same when work is repeated. Ids are not moved; those of the few pieces that are cut meet their parts again by number.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    # the number of a row is written with it, so it stays the same
    held = stored(pieces(docs, capacity, path, end_id).withColumn("key", F.monotonically_increasing_id()), "shallow-pieces")
    placed = with_position(held.drop("ids"), "length", "key").drop("_block")
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = stored(_parts(placed, Plan(histogram, capacity).tables()), "shallow-parts")
    whole = parts.where("NOT cut").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    cut_up = parts.where("cut").drop("ids_crc32").join(held.select("key", "ids"), "key")
    return whole.unionByName(_summed(cut_up))


def _parts(placed: DataFrame, tables: list[dict[str, np.ndarray]]) -> DataFrame:
    """Every part of every piece in its place; ``cut`` says that it is not the piece, and ``begin`` where in it it lies."""
    shared = placed.sparkSession.sparkContext.broadcast(tables)
    fields = ("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begin", "cut")

    def make():
        tables = shared.value

        def apply(ids, starts, lengths, sums, sizes, keys, positions):
            ids, keys = np.array(ids, object), np.array(keys, np.int64)
            starts, lengths, sums, sizes, position = (np.array(x, np.int64) for x in (starts, lengths, sums, sizes, positions))
            found = []
            for table in tables:
                row = np.searchsorted(table["at"], position, "right") - 1
                within = position - table["at"][row]
                k = np.flatnonzero((row >= 0) & (within < table["count"][row]))
                row, within = row[k], within[k]
                begin, length = table["start"][row], table["length"][row]
                found.append((
                    keys[k], ids[k], starts[k] + begin, length, sums[k], sizes[k], table["sequence"][row] + within,
                    table["offset"][row], begin, length != lengths[k],
                ))
            return {name: np.concatenate(x).tolist() for name, x in zip(fields, zip(*found, strict=True), strict=True)}

        return apply

    schema = f"key long, {PACKED}, begin long, cut boolean"
    order = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "key", "position")
    return map_columns(placed.select(*order), make, schema, rows=20_000)


def _summed(cut_up: DataFrame) -> DataFrame:
    """Parts of cut pieces with the checksum of their own ids."""
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "begin", "ids")

    def make():
        def apply(*columns):
            rows = dict(zip(names, columns, strict=True))
            begins, contents = rows.pop("begin"), rows.pop("ids")
            sums = []
            for begin, length, content, start, size in zip(
                begins, rows["length"], contents, rows["start"], rows["doc_tokens"], strict=True
            ):
                # a piece that can be cut is the rest of its document
                ids = np.frombuffer(content, f"<u{len(content) // (size - start + begin)}")[begin:begin + length]
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            return {**rows, "ids_crc32": sums}

        return apply

    return map_columns(cut_up.select(*names), make, PACKED, text="ids")
