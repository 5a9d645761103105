"""A batch source over an interface that hands out pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(DataSourceReader):
    """One task per page, so pages are fetched side by side and again after a lost task."""

    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        size = self.source.page_size
        return [InputPartition(at) for at in range(0, max(self.source.total(), 1), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.fetch(partition.value, self.source.page_size)


class PagedSource(DataSource):
    """Subclass with ``name``, ``schema``, ``total`` and ``fetch``, then register it.

    ``fetch(offset, limit)`` returns the rows of one page as tuples.
    """

    page_size = 50

    def total(self) -> int:
        raise NotImplementedError

    def fetch(self, offset: int, limit: int) -> list[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return Pages(self)
