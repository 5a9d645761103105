"""A manifest of a dataset: hash trees over the rows of every source, and a witness for each row.

Rows are the leaves of their source's tree, in order; the trees' roots are the
leaves of the tree of the dataset. A node is the hash of up to three
consecutive ones below it.

Witnesses are made incrementally. Leaves are appended in order to a streaming
accumulator that holds the open subtrees, at most two of each height. A
subtree carries the partial witnesses of its leaves; when its siblings are
complete they merge, and each witness is extended by the siblings. Appends are
aligned: the leaves of a tree are dealt into blocks of a power of three, each
block is appended in a task of its own, and its root is then a further append
to the same kind of accumulator one storey higher, until a tree is one block.
No task sees more than the leaves of a block, and no block all of a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import map_columns
from ambry.llm.storage import stored
from ambry.operators.ordering import with_position
from ambry.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: leaves that one task appends: three to this power
HEIGHT = 7
_ROWS = "tree long, block long, rank long, digest binary, above binary, shape binary, root binary"


def encoded(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256))


def node(children: Iterable[bytes]) -> bytes:
    """The hash of nodes below, which go in as hexadecimal text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Accumulator:
    """Appends digests and holds open subtrees with the partial witnesses of their leaves.

    ``above[i]`` holds the siblings met by leaf ``i``, ``shape[i]`` a byte for
    each level: how many of them stand left of it times four, plus how many right.
    """

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = []  # by height: (digest, first leaf, end)
        self.above: list[bytearray] = []
        self.shape: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.above)
        self.above.append(bytearray())
        self.shape.append(bytearray())
        self._put(0, (digest, at, at + 1))

    def _put(self, height: int, tree: tuple[bytes, int, int]) -> None:
        if height == len(self.open):
            self.open.append([])
        self.open[height].append(tree)
        if len(self.open[height]) == ARITY:
            self._merge(height)

    def _merge(self, height: int) -> None:
        trees = self.open[height]
        self.open[height] = []
        digests = [t[0] for t in trees]
        for k, (_, first, end) in enumerate(trees):
            siblings = b"".join(digests[:k] + digests[k + 1:])
            shape = k * 4 + len(trees) - 1 - k
            for i in range(first, end):
                self.above[i] += siblings
                self.shape[i].append(shape)
        self._put(height + 1, (node(digests), trees[0][1], trees[-1][2]))

    def close(self, height: int | None) -> bytes:
        """Merges what is open, fewer than three as they are, up to ``height``; without one, until a single node is left."""
        level = 0
        while True:
            higher = any(self.open[level + 1:])
            if height is None and not higher and len(self.open[level]) == 1:
                return self.open[level][0][0]
            if level == height:
                return self.open[level][0][0]
            if self.open[level]:
                self._merge(level)
            level += 1


def folded(digest: bytes, above: bytes, shape: bytes) -> bytes:
    """The root that a digest leads to by its siblings."""
    at = 0
    size = len(digest)
    for step in shape:
        left, right = divmod(step, 4)
        siblings = [above[at + k * size:at + (k + 1) * size] for k in range(left + right)]
        digest = node([*siblings[:left], digest, *siblings[left:]])
        at += size * (left + right)
    return digest


def _append(leaves: DataFrame, height: int) -> DataFrame:
    """Witnesses of ``leaves`` (tree, rank, size, digest) inside their blocks, and the blocks' roots.

    A task streams over its rows; what it holds is one block.
    """
    wide = ARITY**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, single, tree = None, [], False, Accumulator()

        def done():
            root = tree.close(None if single else height)
            return pa.RecordBatch.from_pydict(
                {
                    "tree": [key[0]] * len(held), "block": [key[1]] * len(held), "rank": [h[0] for h in held],
                    "digest": [h[1] for h in held], "above": [bytes(a) for a in tree.above],
                    "shape": [bytes(s) for s in tree.shape], "root": [root] * len(held),
                },
                schema=schema,
            )

        schema = pa.schema([
            ("tree", pa.int64()), ("block", pa.int64()), ("rank", pa.int64()), ("digest", pa.binary()),
            ("above", pa.binary()), ("shape", pa.binary()), ("root", pa.binary()),
        ])
        for batch in batches:
            for number, rank, size, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (number, rank // wide):
                    if held:
                        yield done()
                    key, held, single, tree = (number, rank // wide), [], size <= wide, Accumulator()
                held.append((rank, digest))
                tree.append(digest)
        if held:
            yield done()

    block = F.floor(F.col("rank") / wide)
    dealt = (
        leaves.select("tree", "rank", "size", "digest").repartition("tree", block).sortWithinPartitions("tree", "rank")
    )
    return dealt.mapInArrow(run, _ROWS)


def _upwards(found: DataFrame, higher: DataFrame) -> DataFrame:
    """Witnesses inside blocks, carried on by those of the blocks."""
    names = {"rank": "block", "root": "_root", "above": "_above", "shape": "_shape"}
    more = higher.select("tree", *[F.col(k).alias(v) for k, v in names.items()])
    return found.join(more, ["tree", "block"]).select(
        "tree", "rank", "digest", F.concat("above", "_above").alias("above"), F.concat("shape", "_shape").alias("shape"),
        F.col("_root").alias("root"),
    )


def witnesses(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, rank, digest, above, shape, root) for leaves (tree, rank, size, digest) of any number of trees.

    ``rank`` counts a tree's leaves from 0 and ``size`` says how many it has.
    """
    wide = ARITY**height
    found = stored(_append(leaves, height), "merkle-blocks")
    most = found.agg(F.max("block")).first()[0]
    if not most:
        return found.select("tree", "rank", "digest", "above", "shape", "root")
    # blocks are appended further up; a tree that is one block already stays as it is, with nothing above
    blocks = found.where(F.col("rank") % wide == 0).select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"))
    sizes = found.groupBy("tree").agg((F.max("block") + 1).alias("size"))
    return _upwards(found, witnesses(blocks.join(sizes, "tree"), height))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``tree``, ``rank`` in it and its ``size``; trees are the values of ``group``, null among them.

    A tree is named by the place of its first row in the order of all. Ranks
    come from that order, so that a group of any size is spread over tasks;
    only a row for each task and group is looked at across tasks.
    """
    placed = with_position(rows, group, *order)
    parts = cut(placed.groupBy("_block", group).agg(F.min("position").alias("_from"), F.count(F.lit(1)).alias("_n")))
    trees = parts.groupBy(F.col(group).alias("_g")).agg(F.min("_from").alias("tree"), F.sum("_n").alias("size"))
    named = parts.join(trees, F.col(group).eqNullSafe(F.col("_g"))).select(
        F.col("_block").alias("_b"), F.col(group).alias("_g"), "tree", "size"
    )
    same = (F.col("_block") == F.col("_b")) & F.col(group).eqNullSafe(F.col("_g"))
    return placed.join(named, same).withColumn("rank", F.col("position") - F.col("tree")).drop(
        "_block", "_b", "_g", "position"
    )


def manifest(docs: DataFrame, changed: Column, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    The leaf of a row is the hash of doc_id, source, lang, n_chars and text.
    Leaves of a source ascend by doc_id, nulls first, then by their digest, so
    rows that share a doc_id have a defined order and exact repeats may trade
    places. Sources ascend by their bytes, null first. ``changed`` is the text
    as it is found later, which is hashed again and led to a root by the
    siblings of the row; where that root is not the dataset's, the row is not
    what it was. Nulls in any column are hashed as such; other columns are
    left out; an empty table gives no rows.
    """
    values = [F.col(c) for c in FIELDS]
    other = leaf([*values[:-1], changed])
    rows = docs.select("doc_id", "source", leaf(values).alias("digest"), F.when(~changed.eqNullSafe(F.col("text")), other).alias("other"))
    # the digests are small; texts are read once and go no further
    named = stored(ranked(cut(rows), "source", "doc_id", "digest", "other"), "merkle-leaves")
    below = witnesses(named, height)

    subroots = below.where("rank = 0").select("tree", "root")
    sources = named.where("rank = 0").select("tree", "source").join(subroots, "tree")
    upper = ranked(cut(sources.withColumn("all", F.lit(0)).select("all", "source", "root", F.col("tree").alias("of"))), "all", "source", "of")
    upper = cut(upper.select("tree", "rank", "size", F.col("root").alias("digest"), "of"))
    top = witnesses(upper, height).join(upper.select("tree", "rank", "of"), ["tree", "rank"]).select(
        F.col("of").alias("tree"), F.col("above").alias("top_above"), F.col("shape").alias("top_shape"), F.col("root").alias("top"),
    )
    # a row for each task's share of a source, so that no source is one join key
    shares = F.floor(F.col("rank") / ARITY**height)
    spread = named.select("tree", shares.alias("share")).distinct().join(top, "tree")
    whole = (
        below.withColumnRenamed("digest", "leaf").withColumn("share", shares)
        .join(spread, ["tree", "share"]).join(named.select("tree", "rank", "doc_id", "other"), ["tree", "rank"])
        .select("doc_id", "leaf", "other", "root", "above", "shape", "top", "top_above", "top_shape")
    )

    def make():
        def apply(ids, leaves, others, subs, aboves, shapes, tops, top_aboves, top_shapes):
            out = {k: [] for k in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            for doc_id, own, other, sub, above, shape, root, more, steps in zip(
                ids, leaves, others, subs, aboves, shapes, tops, top_aboves, top_shapes, strict=True
            ):
                proof = hashlib.sha256((above.hex() + more.hex()).encode()).hexdigest()
                led = folded(other or own, above + more, shape + steps)
                row = (doc_id, own.hex(), sub.hex(), root.hex(), proof, led.hex(), led == root)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            return out

        return apply

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_columns(whole, make, schema, rows=4096)
