"""The fixed-window limiter over a stream: two numbers of state per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

OUTPUT = StructType([
    StructField("key", LongType()), StructField("event", LongType()), StructField("accepted", BooleanType()),
])
STATE = StructType([StructField("resets", LongType()), StructField("used", LongType())])


class FixedWindow(StatefulProcessor):
    """Decides hits (key, t, event) in time order within each micro-batch."""

    def __init__(self, limit: int, width: int):
        self.limit = limit
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        resets, used = self.window.get() if self.window.exists() else (0, 0)
        for row in sorted(rows, key=lambda r: (r.t, r.event)):
            if not resets or row.t >= resets:
                resets, used = row.t + self.width, 1
                accepted = True
            else:
                accepted = used < self.limit
                used += accepted
            yield Row(key=key[0], event=row.event, accepted=accepted)
        self.window.update((resets, used))

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int, width: int) -> DataFrame:
    """Streaming ``hits`` with ``accepted``. Needs the RocksDB state store.

    The live limiter must decide each key's hits in order, so one key is one
    task here, bounded by the size of a micro-batch; for a log of the past use
    ``operators.limits.rate_limit``, which splits busy keys.
    """
    return hits.groupBy("key").transformWithState(
        statefulProcessor=FixedWindow(limit, width), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
