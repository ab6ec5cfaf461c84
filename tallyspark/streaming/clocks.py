"""A watermark that is the least over the source's partitions, with idleness: for sources whose partitions lag.

Spark's own watermark follows the latest event time of all rows.  Here a first query keeps the clock of each topic partition
in Spark's state store and adds the least of them to the rows it hands on; a second query takes that column as its
watermark.  The hand-over is a folder of Parquet files that Spark's file sink commits batch by batch, so each row and
each clock comes over once, in order, and both queries go on from their checkpoints after a failure.

Executors reduce each Arrow batch to one row for each topic partition before these meet in the one group that compares
partitions, so that group sees a few numbers for each partition and never an event.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import parse
from ..schema import ENVELOPE
from . import identity

#: The column that holds the least clock in rows that hold nothing else, and null in rows of the source.
CLOCK = "clock"
ALIGNED = T.StructType([*ENVELOPE, T.StructField(CLOCK, T.TimestampType())])
_PLACE = "topic string, partition int"


class LeastClock(StatefulProcessor):
    """The least of the clocks of all partitions that aren't idle; gives a row whenever it has gone up.

    A partition is idle once ``idle_ms`` of processing time have gone by without a valid event of it.  One that is expected and has
    had none yet holds the clock back until it is idle.  If all are idle, or one that comes back is behind, the clock stays.
    """

    def __init__(self, delay_ms: int, idle_ms: int, expected: Iterable[tuple[str, int]] = ()):
        self.delay_ms, self.idle_ms, self.expected = delay_ms, idle_ms, tuple(expected)

    def init(self, handle) -> None:
        self.handle = handle
        self.partitions = handle.getMapState("partitions", _PLACE, "latest long, seen long")
        self.least = handle.getValueState("least", "ms long")

    def _advance(self, now: int) -> pd.DataFrame:
        awake = [latest for latest, seen in self.partitions.values() if now - seen < self.idle_ms]
        before = self.least.get()[0] if self.least.exists() else None
        if not awake or None in awake or (before is not None and min(awake) - self.delay_ms <= before):
            return pd.DataFrame({"ms": pd.Series([], dtype="int64")})
        self.least.update((min(awake) - self.delay_ms,))
        return pd.DataFrame({"ms": [min(awake) - self.delay_ms]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.partitions.exists():
            for place in self.expected:
                self.partitions.updateValue(place, (None, now))
        arrived = pd.concat(list(rows)).groupby(["topic", "partition"])["ms"].max()
        for (topic, partition), ms in arrived.items():
            place = (topic, int(partition))
            latest = self.partitions.getValue(place)[0] if self.partitions.containsKey(place) else None
            self.partitions.updateValue(place, (int(ms) if latest is None else max(int(ms), latest), now))
        self.handle.registerTimer(now + self.idle_ms)  # who is silent until then is idle
        yield self._advance(now)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def _latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.groupby(["topic", "partition"], as_index=False)["ms"].max()


def least_clock(source: DataFrame, delay_ms: int, idle_ms: int, expected: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """Envelope rows to a row ``ms`` whenever the least clock goes up: the latest valid event time less ``delay_ms``.

    Invalid rows move no clock and keep no partition awake.  Rows without topic or partition count as those of one nameless
    partition.
    """
    events = parse.valid(parse.parse_events(source)).select(F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("partition", F.lit(-1)).alias("partition"), F.unix_millis("event_time").alias("ms"))
    latest = events.mapInPandas(_latest, f"{_PLACE}, ms long")
    clocks = latest.withColumn("all", F.lit(0)).groupBy("all")
    return clocks.transformWithStateInPandas(LeastClock(delay_ms, idle_ms, expected), "ms long", "append", "processingTime")


def align(source: DataFrame, folder: str, delay_ms: int, idle_ms: int, expected: Iterable[tuple[str, int]] = (), name: str = "aligned", **trigger) -> StreamingQuery:
    """Start the first query: rows of ``source`` and clocks to ``folder``/rows; ``identity.OtherState`` if the checkpoint is of other operators.

    With timers of processing time Spark goes on with batches without rows for ever, so an ``availableNow`` run has none of
    those: there, idle partitions are found when rows of others come.
    """
    kept = least_clock(source, delay_ms, idle_ms, expected)
    identity.guard(source.sparkSession, f"{folder}/operators.json", f"{folder}/checkpoint", identity.planned(kept, [LeastClock(delay_ms, idle_ms, expected)]))
    clocks = kept.select(F.timestamp_millis("ms").alias(CLOCK))
    rows = source.select(*ENVELOPE.fieldNames()).unionByName(clocks, allowMissingColumns=True)
    writer = rows.writeStream.format("parquet").queryName(name).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    spark, empty = source.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    try:
        spark.conf.set(empty, "false" if trigger.get("availableNow") else "true")
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
    finally:
        spark.conf.set(empty, before)


def aligned(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """What ``align`` writes, as a stream: the source of the second query."""
    reader = spark.readStream.schema(ALIGNED)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{folder}/rows")


def by_clock(rows: DataFrame) -> DataFrame:
    """The envelope rows of ``aligned``, with the clock as the watermark of whatever follows."""
    return rows.withWatermark(CLOCK, "0 seconds").where(F.col(CLOCK).isNull()).drop(CLOCK)
