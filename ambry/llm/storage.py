"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ambry.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet below the shared folder and reads it from there.

    Later readers fetch the columns they need, and a lost executor costs them
    nothing. The files belong to the owner of that folder.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
