"""Resumable ingest: a stream of records kept as the latest version per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def ingest(source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch of a streaming ``source`` below ``table``.

    A batch is one folder, replaced as a whole, so a batch that is run again
    after a failure changes nothing. Old rows are not rewritten on arrival;
    ``current`` picks the newest version of each key when it reads.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, table: str, schema: StructType, keys: list[str], order: str) -> DataFrame:
    """The newest version of each key: by batch, within a batch by ``order``."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(full).parquet(table)
    others = [c for c in schema.names if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct("batch", order))
    return rows.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


def compact(spark: SparkSession, table: str, into: str, schema: StructType, keys: list[str], order: str) -> None:
    """Writes the current state as batch -1 of a fresh table."""
    current(spark, table, schema, keys, order).write.mode("overwrite").parquet(f"{into}/batch=-1")
