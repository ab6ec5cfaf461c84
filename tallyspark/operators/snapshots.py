"""Versioned snapshots: newest version of each window, and the queries that serve them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("dataset", "window_start")


def newest(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """For each key the row of the highest version; of equal versions the one received last, then written last (``seq``)."""
    order = F.struct(*[c for c in ("result_version", "received_at", "seq") if c in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def latest(rows: DataFrame, dataset: str) -> DataFrame:
    """The newest window of a dataset; no row if there is none."""
    return newest(rows.where(F.col("dataset") == dataset)).orderBy(F.desc("window_start")).limit(1)


def check_range(start: datetime, end: datetime, limit: int) -> None:
    if not start < end or end - start > timedelta(hours=24):
        raise ValueError("a range must increase and span 24 hours at most")
    for t in (start, end):
        if not 1900 <= t.year < 2300 or t.microsecond % 1000:
            raise ValueError("times must be from 1900 to before 2300, in whole milliseconds")
    if not 1 <= limit <= 1440:
        raise ValueError("limit must be 1 to 1440")


def window_range(rows: DataFrame, dataset: str, start: datetime, end: datetime, limit: int = 120) -> DataFrame:
    """Windows from ``start`` to before ``end`` in order, ``limit`` at most; ``truncated`` says whether there are more."""
    check_range(start, end, limit)
    within = (F.col("dataset") == dataset) & (F.col("window_start") >= F.lit(start)) & (F.col("window_start") < F.lit(end))
    found = newest(rows.where(within)).orderBy("window_start").limit(limit + 1)
    more = found.agg((F.count("*") > limit).alias("truncated"))  # one row
    return found.orderBy("window_start").limit(limit).crossJoin(F.broadcast(more))


def last_hour(rows: DataFrame, dataset: str, limit: int = 120) -> DataFrame:
    """The windows of the hour before the newest window's end, in order, with ``truncated``: one plan, nothing is looked up first."""
    mine = rows.where(F.col("dataset") == dataset)
    edge = mine.agg(F.max("window_end").alias("edge"))  # one row
    near = mine.crossJoin(F.broadcast(edge)).where((F.col("window_start") >= F.col("edge") - F.expr("INTERVAL 1 HOUR")) & (F.col("window_start") < F.col("edge"))).drop("edge")
    found = newest(near).orderBy("window_start").limit(limit + 1)
    more = found.agg((F.count("*") > limit).alias("truncated"))  # one row
    return found.orderBy("window_start").limit(limit).crossJoin(F.broadcast(more))


def check_ranking(window_start: datetime, result_version: int, limit: int) -> None:
    if window_start.second or window_start.microsecond:
        raise ValueError("a window starts at a whole minute")
    if result_version < 1 or not 1 <= limit <= 100:
        raise ValueError("result-version must be positive, limit 1 to 100")


def ranking(rows: DataFrame, dataset: str, window_start: datetime, result_version: int, limit: int = 10) -> DataFrame:
    """The places of a stored ranking if its newest version is the one asked for.

    No row: not ready.  One row of rank 0: ready and empty.
    """
    check_ranking(window_start, result_version, limit)
    current = newest(rows.where((F.col("dataset") == dataset) & (F.col("window_start") == F.lit(window_start)))).where(F.col("result_version") == result_version)
    placed = current.select("dataset", "window_start", "result_version", F.posexplode_outer(F.slice("products", 1, limit)).alias("pos", "p"))
    return placed.select("dataset", "window_start", "result_version", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), "p.*").orderBy("rank")


def dashboard(minutes: DataFrame, rankings: DataFrame, dataset: str, limit: int = 10) -> dict[str, DataFrame] | None:
    """The newest window, its ranking, and the hour before the window's end; None without data."""
    newest_row = latest(minutes, dataset)
    row = newest_row.first()
    if row is None:
        return None
    return {"latest": newest_row, "ranking": ranking(rankings, dataset, row["window_start"], row["result_version"], limit), "history": window_range(minutes, dataset, row["window_end"] - timedelta(hours=1), row["window_end"])}


def expire(rows: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """Rows that retention keeps."""
    return rows.where(F.col("received_at") >= F.lit(now - timedelta(days=days)))


def expire_stored(spark: SparkSession, folder: str, now: datetime, days: int = 90) -> int:
    """Retention of snapshots stored in partitions (batch=.../...): batches all of whose rows are too old go; how many did.

    Batches are written once and never changed, so a batch goes as a whole and no row is written again.
    """
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest_of = rows.groupBy("batch").agg(F.max("received_at").alias("newest"))
    old = [r["batch"] for r in newest_of.where(F.col("newest") < F.lit(now - timedelta(days=days))).select("batch").collect()]  # numbers of batches
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for number in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(base, f"batch={number}"), True)
    return len(old)


def exact_numbers(rows: DataFrame) -> DataFrame:
    """Longs and decimals as text, so JSON readers don't round them."""
    wide = {f.name for f in rows.schema if f.dataType.typeName() in ("long", "decimal")}
    return rows.select(*[F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in rows.columns])
