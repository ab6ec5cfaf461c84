"""One stateful operator that deduplicates events, holds them until their window closes, and gives late ones apart.

State lives in Spark's state store (RocksDB): for each slot of windows and part of their event ids the events as they came,
and an event-time timer at the first window's end.  When the watermark reaches an end the window's events are given out and
go from the state; an event of a window that is closed already comes out at once, marked late.  So results and late events
are rows of one stream, and a restart goes on in the middle of a window from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import parse
from ..operators import metrics
from ..schema import EVENT
from . import clocks

#: Parts of a window's event ids, so a busy window is not one group.
PARTS = 16
ON_TIME, LATE, DEAD = "on time", "late", "dead"
#: The key of what couldn't be parsed.
NO_WINDOW = -(1 << 63)
_ARRIVAL = ("topic", "partition", "offset")
_HELD = T.StructType([f if f.name != "event_time" else T.StructField("micros", T.LongType()) for f in EVENT] + [T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])
_DEAD = T.StructType([T.StructField("sourceTopic", T.StringType()), T.StructField("sourcePartition", T.IntegerType()), T.StructField("sourceOffset", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("keyBase64", "valueBase64", "reason"))])
OUTPUT = "kind string, body string"
#: Milliseconds of windows that share a group.
SLOT = 21_600_000
_HELD_BY = ("end", "event_id", *_ARRIVAL, "turn", "body")
PIECE = "end array<long>, event_id array<string>, topic array<string>, partition array<int>, offset array<long>, turn array<long>, body array<string>"


def _piece(rows: pd.DataFrame) -> tuple:
    return tuple(rows[c].tolist() for c in _HELD_BY)


class HeldWindow(StatefulProcessor):
    """The events of one part of a slot's windows, by pieces as they came; bodies are JSON, so state has one schema whatever events hold.

    A piece is one value of state with columns of many events, and a slot has one timer, at the first end of its windows: calls
    between Spark and Python grow with slots and pieces, not with events.  Equal ids are sorted out when their window closes.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", PIECE)
        self.about = handle.getValueState("about", "turn long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        turn, due = self.about.get() if self.about.exists() else (0, None)
        first = due
        for arrived in rows:
            dead, late = arrived["end"] == NO_WINDOW, arrived["end"] <= watermark
            late &= ~dead
            for kind, these in ((DEAD, dead), (LATE, late)):
                if these.any():
                    yield pd.DataFrame({"kind": kind, "body": arrived["body"][these]})
            kept = arrived[~(dead | late)]
            if len(kept):
                self.held.appendValue(_piece(kept.assign(turn=turn)))
                first = int(kept["end"].min()) if first is None else min(first, int(kept["end"].min()))
        if first is not None:
            self._wait(turn + 1, due, first)

    def _wait(self, turn: int, before: int | None, due: int | None) -> None:
        """Note the turn, and have the timer at ``due`` alone."""
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self.about.update((turn, due))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, _ = self.about.get()
        held = pd.concat([pd.DataFrame(dict(zip(_HELD_BY, piece, strict=True))) for piece in self.held.get()], ignore_index=True)
        held = held.sort_values(["turn", *_ARRIVAL], kind="stable").drop_duplicates(["end", "event_id"])
        closed = held["end"] <= timerValues.getCurrentWatermarkInMs()
        rest = held[~closed]
        if len(rest):
            self.held.put([_piece(rest)])
            self._wait(turn, None, int(rest["end"].min()))
        else:
            self.held.clear()
            self.about.clear()
        yield pd.DataFrame({"kind": ON_TIME, "body": held["body"][closed]})

    def close(self) -> None:
        pass


def prepare_store(spark: SparkSession) -> None:
    """State in RocksDB with changelog checkpoints: a commit uploads what changed, not the whole store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def held_until_closed(source: DataFrame, delay_ms: int = 30_000, width: str = metrics.MINUTE) -> DataFrame:
    """Envelope rows to (kind, body): events once their window has closed, late events and dead letters at once.

    An event is late if its window's end isn't after the watermark, which is the latest valid event time of the batches
    before less ``delay_ms``; for rows of ``clocks.aligned`` it is the least clock of the partitions, which has the delay in it.
    Of equal ids in a window the first by batch, then by topic, partition and offset, is kept.
    """
    if clocks.CLOCK in source.columns:
        rows = parse.parse_events(clocks.by_clock(source))
    else:
        rows = parse.parse_events(source).withWatermark("event_time", f"{delay_ms} milliseconds")
    micros = F.unix_micros("event_time")  # a number carries no watermark: Spark hands late rows on
    held = F.struct(*(c for c in EVENT.fieldNames() if c != "event_time"), micros.alias("micros"), *_ARRIVAL)
    dead = F.struct(F.col("topic").alias("sourceTopic"), F.col("partition").alias("sourcePartition"), F.col("offset").alias("sourceOffset"), F.base64("key").alias("keyBase64"), F.base64("value").alias("valueBase64"), F.col("error").alias("reason"))
    body = F.when(F.col("error").isNull(), F.to_json(held)).otherwise(F.to_json(dead))
    window_end = F.unix_millis(metrics.minute_end(F.timestamp_micros(F.coalesce(micros, F.lit(0))), width))  # F.window leaves out rows without a time
    end = F.when(micros.isNotNull(), window_end).otherwise(F.lit(NO_WINDOW))
    part = F.pmod(F.xxhash64(F.coalesce("event_id", F.col("offset").cast("string"))), F.lit(PARTS))
    places = [F.coalesce(c, F.lit(last)).alias(c) for c, last in zip(_ARRIVAL, ("\U0010ffff", (1 << 31) - 1, (1 << 63) - 1), strict=True)]  # for the order alone: unknown ones come last
    keyed = rows.select(end.alias("end"), part.alias("part"), "event_id", *places, body.alias("body")).withColumn("slot", F.floor(F.col("end") / SLOT))
    return keyed.groupBy("slot", "part").transformWithStateInPandas(HeldWindow(), OUTPUT, "append", "eventTime")


def events_of(rows: DataFrame, kind: str) -> DataFrame:
    """The events of one kind, as ``parse.valid`` gives them, with ``arrival``."""
    body = rows.where(F.col("kind") == kind).select(F.from_json("body", _HELD).alias("e")).select("e.*")
    events = body.withColumn("event_time", F.timestamp_micros("micros"))
    return events.select(*_ARRIVAL, *EVENT.fieldNames(), F.struct(*_ARRIVAL).alias("arrival"))


def dead_letters_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == DEAD).select(F.from_json("body", _DEAD).alias("d")).select("d.*")
