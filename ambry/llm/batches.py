"""Running a function over the rows of a DataFrame in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 256
CHARS = 4_000_000
#: bytes of an Arrow batch between Spark and Python; a single row may be longer
BATCH_BYTES = 8_000_000
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(df: DataFrame) -> None:
    """Lowers the session's size of Arrow batches to ``BATCH_BYTES`` where it is greater.

    A batch is held whole on both sides of the pipe, in every running task.
    """
    conf = df.sparkSession.conf
    number, unit = re.match(r"(-?\d+)\s*([kmgt]?)", conf.get(_SETTING).strip().lower()).groups()
    held = int(number) << 10 * " kmgt".index(unit or " ")
    if not 0 < held <= BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: int | None, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Cuts of at most ``rows`` rows and about ``chars`` bytes of column ``text``; a row is never cut."""
    if text is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(batch.column(text)), 0).to_pylist()
    begun, held = 0, 0
    for at, size in enumerate(sizes):
        if at > begun and (at - begun >= rows or held + size > chars):
            yield batch.slice(begun, at - begun)
            begun, held = at, 0
        held += size
    if begun < len(sizes):
        yield batch.slice(begun)


def map_columns(
    df: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], schema: str | StructType,
    text: str | None = None, rows: int = ROWS, chars: int = CHARS,
) -> DataFrame:
    """Applies a function of whole columns to bounded slices of rows.

    ``make`` runs once per task, so models and caches live as long as a task;
    what it returns gets one list per column of ``df`` and returns one list
    per field of ``schema``. A slice is bounded by rows and by the size of the
    column ``text``, and the Arrow batch it is cut from by ``BATCH_BYTES``.
    """
    _small_batches(df)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    at = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        apply = make()
        for batch in batches:
            for piece in slices(batch, at, rows, chars):
                got = apply(*[c.to_pylist() for c in piece.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, kind)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str = "text") -> DataFrame:
    """The rows of ``df`` whose ``column`` passes; all columns stay as they are, whatever their names.

    ``make`` runs once per task; what it returns gets the values of a slice and
    says which of them stay.
    """
    _small_batches(df)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            for piece in slices(batch, at, ROWS, CHARS):
                yield piece.filter(pa.array(passes(piece.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_column(df: DataFrame, make: Callable[[], Callable[[list], list]], column: str = "text") -> DataFrame:
    """``df`` with the strings of ``column`` made anew from themselves, slice by slice."""
    _small_batches(df)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for piece in slices(batch, at, ROWS, CHARS):
                values = pa.array(change(piece.column(at).to_pylist()), piece.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(
                    [values if i == at else c for i, c in enumerate(piece.columns)], schema=piece.schema
                )

    return df.mapInArrow(run, df.schema)
