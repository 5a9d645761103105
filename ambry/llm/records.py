"""Token ids as files of length-delimited binary records, with an offset index beside them.

A record is framed as

    length of the payload   8 bytes, little-endian
    masked CRC of those     4 bytes
    payload
    masked CRC of it        4 bytes
    line feed

The payload is the width of an id in bytes (2 or 4), one byte that is 1 where
the document has an id of its own, the document's id in 8 bytes, then the
token ids. The checksum is CRC-32, rotated by 15 bits and moved by a constant, so
that checksums of data that hold checksums stay good.

Files are written by Spark's text writer, one record to a line whatever bytes
it holds: its commit protocol lets tasks be repeated, and any file system
that Spark knows will do. Lengths alone delimit records for readers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry.llm.batches import map_columns
from ambry.llm.tokens import encoder, vocabulary

_LENGTH = struct.Struct("<Q")
_CRC = struct.Struct("<I")
_HEAD = struct.Struct("<BBq")
_MASK = 0xA282EAD8
#: characters of text that go to one file, about
FILE_CHARS = 32_000_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CRC.pack(masked_crc(length)), payload, _CRC.pack(masked_crc(payload)), b"\n"))


def payload(doc_id: int | None, ids: bytes) -> bytes:
    """``ids`` are little-endian unsigned 32-bit; they take half of that where they fit."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not wide.size or int(wide.max()) < 1 << 16 else 4
    body = wide.astype("<u2").tobytes() if width == 2 else ids
    return _HEAD.pack(width, doc_id is not None, doc_id or 0) + body


def unframed(data: bytes, at: int = 0) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record from ``at`` on; a damaged or cut one raises."""
    view = memoryview(data)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"record at {at} is cut short")
        head = view[at:at + 8]
        size = _LENGTH.unpack(head)[0]
        if _CRC.unpack(view[at + 8:at + 12])[0] != masked_crc(head):
            raise ValueError(f"length at {at} is damaged")
        end = at + 12 + size
        if end + 5 > len(data):
            raise ValueError(f"record at {at} is cut short")
        body = view[at + 12:end]
        if _CRC.unpack(view[end:end + 4])[0] != masked_crc(body):
            raise ValueError(f"record at {at} is damaged")
        yield at, body
        at = end + 5


def decoded(body: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian unsigned 32-bit) of a payload."""
    width, named, doc_id = _HEAD.unpack(body[:_HEAD.size])
    ids = np.frombuffer(body[_HEAD.size:], f"<u{width}").astype("<u4")
    return (doc_id if named else None), ids


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, file_chars: int = FILE_CHARS) -> str:
    """Writes the token ids of ``docs`` (doc_id, text) in ascending order of doc_id, and their index.

    ``folder`` gets ``records`` and ``index``. Rows are dealt out by ranges of
    doc_id, nulls first, into files of about ``file_chars`` characters; the number of a file
    says where it comes. Rows that share a doc_id follow each other in any
    order. A null or empty text is the end id alone; an empty table makes an
    empty folder.
    """
    path = path or vocabulary()
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // file_chars))

    def make():
        encode = encoder(path).encode

        def apply(ids, texts):
            # the writer ends each record with the line feed
            return {"value": [frame(payload(i, x + end))[:-1] for i, x in zip(ids, encode(texts), strict=True)]}

        return apply

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash splits a doc_id that many rows share
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    frames = map_columns(dealt, make, "value binary", text="text")
    records = f"{folder.rstrip('/')}/records"
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(records)
    _index(docs.sparkSession, records).write.parquet(f"{folder.rstrip('/')}/index")
    return folder


def _files(spark: SparkSession, records: str) -> DataFrame:
    """(file, content): the number in a file's name tells its place in the order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(records)
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int")
    return found.select(number.alias("file"), "content")


def _index(spark: SparkSession, records: str) -> DataFrame:
    """(file, doc_id, offset, size, n_tokens, start): where each record lies, and the ids before it in its file.

    Made by reading what was written, so it fits the files that were committed.
    """
    schema = "file int, doc_id long, offset long, size long, n_tokens long, start long"

    def make():
        def apply(files, contents):
            out = {k: [] for k in ("file", "doc_id", "offset", "size", "n_tokens", "start")}
            for file, content in zip(files, contents, strict=True):
                start = 0
                for offset, body in unframed(content):
                    doc_id, ids = decoded(body)
                    row = (file, doc_id, offset, len(body), ids.size, start)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    start += ids.size
            return out

        return apply

    return map_columns(_files(spark, records), make, schema, rows=1)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start`` counted over all files.

    Totals are summed per file, one row each, before they are added up.
    """
    held = spark.read.parquet(f"{folder.rstrip('/')}/index")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return held.join(F.broadcast(starts), "file").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, doc_id, ids): all records, their checksums verified; ids are little-endian 32-bit."""

    def make():
        def apply(files, contents):
            out = {k: [] for k in ("file", "offset", "doc_id", "ids")}
            for file, content in zip(files, contents, strict=True):
                for offset, body in unframed(content):
                    doc_id, ids = decoded(body)
                    for column, value in zip(out.values(), (file, offset, doc_id, ids.tobytes()), strict=True):
                        column.append(value)
            return out

        return apply

    return map_columns(
        _files(spark, f"{folder.rstrip('/')}/records"), make, "file int, offset long, doc_id long, ids binary", rows=1
    )


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, as read back from the files."""
    schema = "file int, offset long, doc_id long, n_tokens long, ids_crc32 long"

    def make():
        def apply(files, contents):
            out = {k: [] for k in ("file", "offset", "doc_id", "n_tokens", "ids_crc32")}
            for file, content in zip(files, contents, strict=True):
                for offset, body in unframed(content):
                    doc_id, ids = decoded(body)
                    row = (file, offset, doc_id, ids.size, zlib.crc32(ids.tobytes()))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            return out

        return apply

    found = map_columns(_files(spark, f"{folder.rstrip('/')}/records"), make, schema, rows=1)
    placed = read_index(spark, folder).select("file", "offset", "start")
    return found.join(placed, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def shuffled(spark: SparkSession, folder: str, seed: int, block: int = 64) -> DataFrame:
    """(doc_id, ids) in an order drawn by ``seed``, through the index.

    Blocks of ``block`` neighbouring records are dealt out at random and
    shuffled inside, so a reader fetches a stretch of a file at a time.
    """
    chosen = read_index(spark, folder).select(
        "file", "offset", F.xxhash64(F.lit(seed), "file", F.floor(F.col("start") / block)).alias("_block"),
        F.xxhash64(F.lit(seed), "file", "offset").alias("_in"),
    )
    held = read(spark, folder).join(chosen, ["file", "offset"])
    return held.repartitionByRange("_block").sortWithinPartitions("_block", "_in").select("doc_id", "ids")
