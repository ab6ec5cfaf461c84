"""The streaming pipeline: envelope rows to minute metrics, rankings, dead letters and late events.

``native_*`` chain Spark's stateful operators in append mode: a result comes once, when its window closes, and late input
never changes it.  A row is late if its window's end isn't after the watermark; Spark counts such rows and drops them.

``AuditedPipeline`` keeps them: ``windows`` holds events in Spark's state store and gives late ones out as rows.  Every output is
written under its batch number and replaces what an earlier try of the same batch left, so a batch that is run again
leaves what it would have left at once.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import StorageSettings, StreamSettings
from ..functions import parse
from ..operators import metrics
from ..plans.folder import Folder
from ..schema import MONEY, PAYMENT, REFUND
from . import clocks, identity, windows


def parsed(source: DataFrame) -> DataFrame:
    """Valid events with ``arrival``, the order of the source's rows."""
    return parse.valid(parse.parse_events(source)).withColumn("arrival", F.struct("topic", "partition", "offset"))


def _deduplicated(events: DataFrame, delay_ms: int, width: str) -> DataFrame:
    """Invalid rows are gone before, so they never move the watermark.  State of an id lives as long as its window."""
    marked = events.withWatermark("event_time", f"{delay_ms} milliseconds").withColumn("w", F.window("event_time", width))
    return marked.dropDuplicates(["event_id", "w"])


def native_totals(events: DataFrame, delay_ms: int = 30_000, width: str = metrics.MINUTE) -> DataFrame:
    """``metrics.window_totals`` as a stream."""
    refund = F.col("event_type") == REFUND
    rows = metrics.transactions(_deduplicated(events, delay_ms, width))
    firsts = rows.groupBy("w", "order_id").agg(F.min_by(F.struct("user_id", "quantity", "amount"), F.when(F.col("event_type") == PAYMENT, F.col("arrival"))).alias("p"), F.count_if(refund).alias("n_refunds"), F.sum(F.when(refund, F.col("amount"))).alias("refunded"))
    users = firsts.groupBy("w", F.col("p.user_id").alias("user_id")).agg(F.count("p").alias("orders"), F.sum(F.col("p.quantity").cast("long")).alias("quantity"), F.sum("p.amount").alias("amount"), F.sum("n_refunds").alias("n_refunds"), F.sum("refunded").alias("refunded"))
    zero = F.lit("0.00").cast(MONEY)
    totals = users.groupBy("w").agg(
        F.sum("orders").alias("paid_orders"), F.count_if((F.col("orders") > 0) & F.col("user_id").isNotNull()).alias("paid_users"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("paid_quantity"),
        F.coalesce(F.sum("amount").cast(MONEY), zero).alias("gmv"), F.sum("n_refunds").alias("refunds"), F.coalesce(F.sum("refunded").cast(MONEY), zero).alias("refund_amount"),
    )
    return totals.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in totals.columns if c != "w"])


#: Parts of a window's products that are ranked apart before the best of each meet.
RANKING_PARTS = 64


def native_ranking(events: DataFrame, n: int = 10, delay_ms: int = 30_000, width: str = metrics.MINUTE) -> DataFrame:
    """``metrics.ranking_array`` as a stream: a chain of aggregations by order, user, product, part of the products and window.

    Users are counted by grouping, and no row holds more than the best ``n`` of each part, however many products a window has.
    """
    if n < 1:
        raise ValueError("a ranking needs at least one place")
    paid = metrics.payments(_deduplicated(events, delay_ms, width))
    firsts = paid.groupBy("w", "product_id", "order_id").agg(F.min_by(F.struct("user_id", "quantity", "amount"), "arrival").alias("p"))
    users = firsts.groupBy("w", "product_id", F.col("p.user_id").alias("user_id")).agg(F.sum("p.amount").alias("gmv"), F.count("p").alias("orders"), F.sum(F.col("p.quantity").cast("long")).alias("quantity"))
    products = users.groupBy("w", "product_id").agg(F.sum("gmv").cast(MONEY).alias("gmv"), F.sum("orders").alias("paid_orders"), F.count("user_id").alias("paid_users"), F.sum("quantity").alias("paid_quantity"))
    entry = F.struct(F.negative("gmv").alias("o"), "product_id", "gmv", "paid_orders", "paid_users", "paid_quantity")
    best = lambda rows: F.slice(F.array_sort(rows), 1, n)
    parts = products.groupBy("w", F.pmod(F.xxhash64("product_id"), F.lit(RANKING_PARTS)).alias("part")).agg(best(F.collect_list(entry)).alias("a"))
    ranked = parts.groupBy("w").agg(best(F.flatten(F.collect_list("a"))).alias("a"))
    return ranked.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.transform("a", lambda x: x.dropFields("o")).alias("products"))


def snapshot_rows(results: DataFrame, storage: StorageSettings, seq: int) -> DataFrame:
    """Results tagged with data set and version; ``seq`` orders tries of one version."""
    return results.select(F.lit(storage.dataset).alias("dataset"), F.lit(storage.result_version).cast("long").alias("result_version"), F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("received_at"), "*", F.date_format("window_start", "yyyy-MM").alias("month"))


def snapshot_sink(path: str, storage: StorageSettings) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends snapshots; readers converge on the newest version (``snapshots.newest``)."""

    def write(batch: DataFrame, number: int) -> None:
        rows = snapshot_rows(batch, storage, number).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").parquet(path)

    return write


def log_sink(rows: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream's rows as JSON lines on the console."""
    return parse.as_json(rows).writeStream.format("console").option("truncate", False).queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def late_union(dedup: DataFrame, minute: DataFrame, product: DataFrame) -> DataFrame:
    """What came too late for deduplication, minute totals and product totals, with the ``stage`` that refused it."""
    tagged = [rows.withColumn("stage", F.lit(stage)) for stage, rows in (("dedup", dedup), ("minute", minute), ("product", product))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


class AuditedPipeline:
    """A stream of envelope rows to minute metrics, rankings, late events and dead letters, each a table under ``folder``.

    One stateful operator (``windows.held_until_closed``) holds events until their window closes and gives late ones and dead
    letters apart; a batch's closed windows are computed by the batch functions.  All windows share one watermark, so
    deduplication refuses what minute and product totals would, and late events carry that stage.  Rankings are made of the
    windows that close, in the batch in which they close, so no product result comes late for them.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: StreamSettings | None = None, storage: StorageSettings | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings, self.storage = settings or StreamSettings(), storage or StorageSettings()

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _put(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def batch(self, rows: DataFrame, number: int) -> None:
        """Write what a micro-batch of the stateful operator gave out; a batch that runs again replaces its files."""
        rows = rows.persist()
        try:
            self._put(parse.as_json(windows.dead_letters_of(rows)), "dead_letters", number)
            late = windows.events_of(rows, windows.LATE)
            self._put(late_union(late, late.limit(0), late.limit(0)), "late_events", number)
            done = windows.events_of(rows, windows.ON_TIME)
            self._put(snapshot_rows(metrics.window_totals(done), self.storage, number), "minutes", number)
            self._put(snapshot_rows(metrics.ranking_array(metrics.product_totals(done), self.settings.top_n), self.storage, number), "rankings", number)
        finally:
            rows.unpersist()

    def start(self, source: DataFrame, name: str = "audited-commerce", same_code: bool = False, **trigger) -> StreamingQuery:
        """The running query; ``identity.OtherState`` if the checkpoint's state is of other operators than this plan's.

        With ``same_code`` any other code than that which wrote the checkpoint is refused, with a RuntimeError.
        """
        guard_checkpoint(Folder(self.spark, f"{self.folder}/guard"), strict=same_code)
        windows.prepare_store(self.spark)
        held = windows.held_until_closed(source, self.settings.out_of_order_ms)
        operators = identity.planned(held, [windows.HeldWindow()])
        identity.guard(self.spark, f"{self.folder}/guard/operators.json", f"{self.folder}/checkpoint", operators, parts=windows.PARTS, width=metrics.MINUTE)
        writer = held.writeStream.queryName(name).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.batch)
        return writer.trigger(**(trigger or {"processingTime": f"{self.settings.checkpoint_interval_ms} milliseconds"})).start()

    def align(self, source: DataFrame, expected: Iterable[tuple[str, int]] = (), **trigger) -> StreamingQuery:
        """The query before ``start`` where partitions lag: ``start(pipeline.aligned())`` then judges by the least of their clocks."""
        windows.prepare_store(self.spark)
        return clocks.align(source, f"{self.folder}/aligned", self.settings.out_of_order_ms, self.settings.idle_timeout_ms, expected, **trigger)

    def aligned(self) -> DataFrame:
        return clocks.aligned(self.spark, f"{self.folder}/aligned")

    def run(self, source: Callable[[], DataFrame], retries: int = 3, wait_s: float = 5.0, **kw) -> None:
        """Start and keep running: after a failure the query goes on from its checkpoint, ``retries`` times at most."""
        supervise(lambda: self.start(source(), **kw), retries, wait_s)

    def minutes(self) -> DataFrame | None:
        return self._read("minutes")

    def rankings(self) -> DataFrame | None:
        return self._read("rankings")

    def late_events(self) -> DataFrame | None:
        return self._read("late_events")

    def dead_letters(self) -> DataFrame | None:
        return self._read("dead_letters")


def supervise(start: Callable[[], StreamingQuery], retries: int = 3, wait_s: float = 5.0) -> None:
    """Run a query to its end; after a failure start it again, ``retries`` times at most, from its checkpoint."""
    for attempt in range(retries + 1):
        try:
            start().awaitTermination()
            return
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait_s)


def code_version() -> str:
    """A digest of the package's code without ``llm``."""
    root, digest = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        if "llm" not in p.relative_to(root).parts:
            digest.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes())
    return digest.hexdigest()


def guard_checkpoint(folder: Folder, version: str | None = None, strict: bool = True) -> None:
    """Write the code's version beside a checkpoint; if another version wrote it, RuntimeError where ``strict``."""
    mark, version = folder / "code-version", version or code_version()
    folder.make()
    if not mark.claim(version) and mark.read() != version:
        if strict:
            raise RuntimeError("another version of the code wrote this checkpoint")
        mark.write(version)
