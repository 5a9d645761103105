"""Near-duplicate documents: minima of many universal hashes, banding, exact verification.

Texts with the same set of shingles are one node from the start. Nodes whose
minima agree in a band are candidates; the bands are chosen so that a pair at
the threshold is missed with a probability of at most ``MISS``. Candidates
pass an estimate from their signatures and are then confirmed on full sets.

Within a bucket nobody meets everybody: all are first held against the least
member, and components of those links are found. A link inside a component
cannot change it, so only buckets with members of several components are left.
Their members are compared where they share a shingle so rare, and so early
in the order from rare to common, that the similarity is still possible: this
prefix and position test loses no pair, and copies that all share their common
part but are not similar enough do not meet.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import CHARS, ROWS, map_columns, slices
from ambry.llm.components import components
from ambry.llm.storage import stored
from ambry.session import cut

WORDS = 5
SIMILARITY = Fraction(8, 10)
MISS = 1e-6
HASHES = 360
SEED = 20_240_229
CACHED_WORDS = 100_000
RARITY_BITS = 20
PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def banding(similarity: float, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``hashes`` minima still miss a pair so seldom."""
    best = None
    for rows in range(1, hashes + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if rows * bands > hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hashes cannot find pairs at {similarity}")
    return best


class _WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles of ``words`` words.

    A-Z are lower-cased; words are what spaces, tabs, line feeds, form feeds,
    vertical tabs and carriage returns leave. Fewer words are one shingle;
    none, or a null, give the empty set.
    """

    def __init__(self, words: int):
        self.words = words
        self.hashes = _WordHashes()
        self.factors = np.random.default_rng(SEED).integers(0, 2**63, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = len(codes) - self.words + 1
        if n < 1:
            whole = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little")
            return np.array([whole], np.uint64)
        total = np.zeros(n, np.uint64)
        for k, factor in enumerate(self.factors):
            total += _mix(codes[k:k + n] * factor) * factor
        return np.unique(_mix(total))


class Signer:
    """Minima of universal multiply-add hashes over 32 bits, and their bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(SEED + 1)
        self.a = (draw.integers(0, 2**31, (bands * rows, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = draw.integers(0, 2**32, (bands * rows, 1), np.uint32)
        self.salt = draw.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            hashed = self.a * x[at:at + 1024]
            hashed += self.b
            np.minimum(out, hashed.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; different bands never mean the same by it."""
        mixed = _mix(minima.reshape(self.bands, self.rows).astype(np.uint64) + self.salt) * self.salt
        return _mix(mixed.sum(axis=1, dtype=np.uint64)).view(np.int64)


def profiles(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: size and digest of its shingle set, band keys, low bytes of the minima."""

    def make():
        shingle, sign = Shingler(words), Signer(bands, rows)

        def apply(ids, texts):
            out = {k: [] for k in ("doc_id", "n_shingles", "set_a", "set_b", "bands", "signature")}
            for doc_id, text in zip(ids, texts, strict=True):
                found = shingle(text)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(len(found))
                out["set_a"].append(int.from_bytes(digest[:8], "little", signed=True))
                out["set_b"].append(int.from_bytes(digest[8:], "little", signed=True))
                minima = sign.minima(found) if len(found) and doc_id is not None else None
                out["bands"].append(None if minima is None else sign.keys(minima))
                out["signature"].append(None if minima is None else minima.astype(np.uint8).tobytes())
            return out

        return apply

    return map_columns(docs.select("doc_id", "text"), make, PROFILE, text="text")


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """Pairs whose signatures do not rule out the similarity.

    The bound is six standard errors below it: a true pair is dropped once in a
    billion. Only the low byte of each minimum is held; unequal ones agree in
    it once in 256, which lets a few more pairs pass.
    """
    n = bands * rows
    least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / n)
    a = nodes.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    b = nodes.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))

    def make():
        def apply(left, right, sig_left, sig_right):
            x = np.frombuffer(b"".join(sig_left), np.uint8).reshape(-1, n)
            y = np.frombuffer(b"".join(sig_right), np.uint8).reshape(-1, n)
            good = ((x == y).mean(axis=1) >= least).tolist()
            return {
                "a": [v for v, g in zip(left, good, strict=True) if g],
                "b": [v for v, g in zip(right, good, strict=True) if g],
            }

        return apply

    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    return map_columns(both, make, "a long, b long", rows=4096)


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """Pairs whose full sets of shingles are as similar as asked for."""
    a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    top, bottom = similarity.numerator, similarity.denominator

    def make():
        shingle = Shingler(words)
        last: dict[str, np.ndarray] = {}

        def of(text):
            if text not in last:
                if len(last) >= 8:
                    last.pop(next(iter(last)))
                last[text] = shingle(text)
            return last[text]

        def apply(left, right, texts_left, texts_right):
            out = {"a": [], "b": []}
            for one, other, x, y in zip(left, right, texts_left, texts_right, strict=True):
                p, q = of(x), of(y)
                common = np.intersect1d(p, q, assume_unique=True).size
                if bottom * common >= top * (p.size + q.size - common):
                    out["a"].append(one)
                    out["b"].append(other)
            return out

        return apply

    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return map_columns(both, make, "a long, b long", text="text_a")


def _rarity(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur in ``texts``, in a table of fixed size that many share.

    A task adds up its own rows and hands over one number per used slot.
    """

    def run(batches):
        shingle = Shingler(words)
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for piece in slices(batch, 0, ROWS, CHARS):
                for text in piece.column(0).to_pylist():
                    np.add.at(total, _slot(shingle(text)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    seen = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = seen.toArrow()
    table = np.zeros(1 << RARITY_BITS, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _prefixes(texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(doc_id, n, shingle, at): the rarest shingles of each set, as many as a similar set must share one of.

    Any total order over shingles keeps this exact; one from rare to common keeps it short.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_rarity(texts, words))
    top, bottom = similarity.numerator, similarity.denominator

    def make():
        shingle, table = Shingler(words), shared.value

        def apply(ids, rows):
            out = {"doc_id": [], "n": [], "shingle": [], "at": []}
            for doc_id, text in zip(ids, rows, strict=True):
                found = shingle(text)
                n = int(found.size)
                length = n - -(-top * n // bottom) + 1
                first = found[np.lexsort((found, table[_slot(found)]))[:length]]
                out["doc_id"] += [doc_id] * first.size
                out["n"] += [n] * first.size
                out["shingle"] += first.view(np.int64).tolist()
                out["at"] += range(first.size)
            return out

        return apply

    return map_columns(texts.select("doc_id", "text"), make, "doc_id long, n long, shingle long, at long", text="text")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked where the Jaccard similarity of their sets of
    ``words``-word shingles is at least ``similarity``; component_id is the
    least doc_id reachable, and ``kept`` marks the document that bears it.
    Rows without words, and null texts, are linked with nothing and kept. A
    null doc_id cannot be named: its row is kept with a null component. Rows
    that repeat a doc_id with the same text get the same answer. Columns besides
    doc_id and text are ignored; an empty table gives no rows.
    """
    bands, rows = banding(float(similarity))
    share = float(similarity)
    known = stored(profiles(docs, words, bands, rows), "minhash-profiles")
    named = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first")))
    nodes = stored(
        named.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", "n_shingles", "bands", "signature"), "minhash-nodes",
    )
    buckets = nodes.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    texts = docs.select("doc_id", "text")

    def settle(pairs: DataFrame) -> DataFrame:
        near = cut(_alike(pairs, nodes, share, bands, rows))
        ends = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        held = stored(texts.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "minhash-texts")
        return cut(_confirmed(near, held, words, similarity))

    def fits(one: str, other: str):
        # sets of more different sizes cannot be as similar
        return (F.least(one, other) * similarity.denominator >= F.greatest(one, other) * similarity.numerator)

    shared = cut(
        buckets.groupBy("bucket").agg(F.min(F.struct("doc_id", "n_shingles")).alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("bucket", F.col("least.doc_id").alias("b"), F.col("least.n_shingles").alias("size_b"))
    )
    star = (
        buckets.join(shared, "bucket").where(F.col("doc_id") != F.col("b")).where(fits("n_shingles", "size_b"))
        .select(F.col("doc_id").alias("a"), "b").distinct()
    )
    links = settle(star)
    roots = cut(components(links))

    # what is left: buckets with members of different components
    rooted = cut(
        buckets.join(shared.select("bucket"), "bucket", "left_semi")
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    )
    mixed = cut(
        rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high").select("bucket")
    )
    unsettled = cut(rooted.join(mixed, "bucket", "left_semi").select("doc_id", "root").distinct())
    left = stored(
        texts.join(unsettled.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "minhash-unsettled"
    )
    prefixes = stored(_prefixes(left, words, similarity).join(unsettled, "doc_id"), "minhash-prefixes")
    one, other = (prefixes.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "at", "root")]) for x in "ab")
    # what two sets share from their first common shingle on must be enough
    possible = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (
        similarity.numerator + similarity.denominator
    ) >= (F.col("n_a") + F.col("n_b")) * similarity.numerator
    across = (
        one.join(other, "shingle").where("doc_id_a > doc_id_b AND root_a <> root_b").where(possible)
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    more = settle(across)
    if not more.isEmpty():
        roots = cut(components(links.unionByName(more)))

    belongs = cut(
        classes.join(roots.withColumnRenamed("node", "first"), "first", "left")
        .select("set_a", "set_b", F.coalesce("root", "first").alias("component_id"))
    )
    placed = known.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b").join(
        belongs, ["set_a", "set_b"], "left"
    )
    alone = known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    ).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the least doc_id.

    All columns stay. Of rows that repeat both doc_id and text one stays;
    rows without words, and those without a doc_id, all stay.
    """
    copies = near_duplicates(docs, words, similarity).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    dropped = cut(copies.distinct())
    twice = cut(
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("_h"))
        .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id").distinct()
    )
    # the side of the texts is streamed past a table of ids, so it is neither sorted nor held
    rest = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return rest
    single = rest.join(twice, "doc_id", "left_anti")
    repeated = rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(docs.columns)
