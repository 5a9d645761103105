"""Tables that are replaced together or not at all.

Every version lies in a folder of its own. A row in the manifest names it, and
that row is written last, so readers see the old version or the new one whole,
and a run that fails leaves nothing that anyone reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, folder string, tables array<string>, written_at timestamp"


class Versions:
    """Versioned tables below ``root``, a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """All versions that were ever committed."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def current(self) -> Row | None:
        """The manifest row that readers follow; of two with one number the greater folder name."""
        return self.manifest().orderBy(F.desc("version"), F.desc("folder")).first()

    def publish(
        self, tables: Mapping[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]],
        check: Callable[[dict[str, DataFrame]], None] | None = None,
    ) -> int:
        """Writes ``tables`` as the next version and returns its number.

        A table may be a function of those written before it, so that it is made from what lies there.
        ``check`` gets the tables as they were written and refuses them by
        raising: the version is then never named, and readers keep the old one.
        """
        folder = f"{self.root}/data-{uuid.uuid4().hex}"
        written: dict[str, DataFrame] = {}
        for name, table in tables.items():
            made = table(written) if callable(table) else table
            made.write.mode("errorifexists").parquet(f"{folder}/{name}")
            written[name] = self.spark.read.parquet(f"{folder}/{name}")
        if check is not None:
            check(written)
        last = self.current()
        version = (last.version if last else 0) + 1
        row = self.spark.createDataFrame([(version, folder, list(tables))], "version long, folder string, tables array<string>")
        row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return version

    def read(self, name: str) -> DataFrame:
        """A table of the current version."""
        last = self.current()
        if last is None or name not in last.tables:
            raise LookupError(f"no version of {name} was published in {self.root}")
        return self.spark.read.parquet(f"{last.folder}/{name}")


def some_rows(*names: str) -> Callable[[dict[str, DataFrame]], None]:
    """A check that refuses empty tables."""

    def check(tables: dict[str, DataFrame]) -> None:
        for name in names or tables:
            if tables[name].isEmpty():
                raise ValueError(f"refusing to replace {name} with nothing")

    return check
