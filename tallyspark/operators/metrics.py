"""Commerce metrics per window: deduplication, totals, product totals and rankings.

Pure functions from events (``schema.EVENT`` plus ``arrival``) to results.  The first payment of an order in a window
counts, by arrival; later ones don't.  Refunds all count.  All grouping is two-level with partial aggregation, so neither
a busy order nor a busy product is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MONEY, PAYMENT, REFUND

MINUTE = "1 minute"


def _zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def with_window(events: DataFrame, width: str = MINUTE) -> DataFrame:
    w = F.window("event_time", width)
    return events.withColumn("w", w)


def minute_end(ts: Column, width: str = MINUTE) -> Column:
    """The end of the window that a time falls into."""
    return F.window(ts, width)["end"]


def _bounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *columns)


def transactions(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(PAYMENT, REFUND))


def payments(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == PAYMENT)


def deduplicate(events: DataFrame, width: str = MINUTE) -> DataFrame:
    """The first row of each event id within a window; the same id in another window is another event."""
    columns = events.columns
    first = with_window(events, width).groupBy("event_id", "w").agg(F.min_by(F.struct(*columns), "arrival").alias("first"))
    return first.select("first.*")


def _first_payment() -> Column:
    return F.min_by(F.struct("user_id", "quantity", "amount"), F.when(F.col("event_type") == PAYMENT, F.col("arrival"))).alias("p")


def _totals(firsts: DataFrame, *by: str) -> DataFrame:
    return firsts.groupBy("w", *by).agg(
        F.count("p").alias("paid_orders"), F.count_distinct("p.user_id").alias("paid_users"), F.coalesce(F.sum(F.col("p.quantity").cast("long")), F.lit(0)).alias("paid_quantity"),
        F.coalesce(F.sum("p.amount").cast(MONEY), _zero()).alias("gmv"), F.coalesce(F.sum("n_refunds"), F.lit(0)).alias("refunds"), F.coalesce(F.sum("refunded").cast(MONEY), _zero()).alias("refund_amount"),
    )


def window_totals(events: DataFrame, width: str = MINUTE) -> DataFrame:
    """``schema.MINUTE_METRICS`` of each window with a payment or refund."""
    is_refund = F.col("event_type") == REFUND
    firsts = with_window(transactions(events), width).groupBy("w", "order_id").agg(_first_payment(), F.count_if(is_refund).alias("n_refunds"), F.sum(F.when(is_refund, F.col("amount"))).alias("refunded"))
    return _bounds(_totals(firsts), "paid_orders", "paid_users", "paid_quantity", "gmv", "refunds", "refund_amount")


def product_totals(events: DataFrame, width: str = MINUTE) -> DataFrame:
    """Payments by product: an order across several products counts once for each."""
    firsts = with_window(payments(events), width).groupBy("w", "product_id", "order_id").agg(_first_payment(), F.lit(0).cast("long").alias("n_refunds"), F.lit(None).cast(MONEY).alias("refunded"))
    return _bounds(_totals(firsts, "product_id"), "product_id", "paid_orders", "paid_users", "paid_quantity", "gmv", "refunds", "refund_amount")


def _checked(n: int) -> int:
    if n < 1:
        raise ValueError("a ranking needs at least one place")
    return n


def top_products(products: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n best products of each window by gmv, then id, with their rank."""
    order = Window.partitionBy("window_start", "window_end").orderBy(F.desc("gmv"), F.asc("product_id"))
    return products.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _checked(n))


def ranking_array(products: DataFrame, n: int = 10) -> DataFrame:
    """One row for each window with the ordered ranking as an array, so a new result replaces all places at once."""
    entry = F.struct(F.negative("gmv").alias("o"), "product_id", "gmv", "paid_orders", "paid_users", "paid_quantity")
    best = top_products(products, n).groupBy("window_start", "window_end").agg(F.array_sort(F.collect_list(entry)).alias("a"))  # n entries at most
    return best.select("window_start", "window_end", F.transform("a", lambda x: x.dropFields("o")).alias("products"))


def ranking_rows(rankings: DataFrame, outer: bool = False) -> DataFrame:
    """Ranking arrays as rows with ranks from 1; ``outer`` keeps empty rankings as a row of rank 0."""
    explode = F.posexplode_outer if outer else F.posexplode
    kept = [c for c in rankings.columns if c != "products"]
    rows = rankings.select(*kept, explode("products").alias("pos", "p"))
    return rows.select(*kept, F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), "p.*")


def late_split(events: DataFrame, delay: str, batch: str = "batch", width: str = MINUTE) -> DataFrame:
    """Marks ``late`` the events whose window was closed by the watermark of the earlier batches.

    The watermark after a batch is the latest event time so far less ``delay``; a window is closed once its end isn't
    after it.  There is one row for each batch in the ordered part.
    """
    ends = events.groupBy(batch).agg(F.max("event_time").alias("latest"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = ends.withColumn("watermark", F.max("latest").over(before) - F.expr(f"INTERVAL {delay}")).select(batch, "watermark")
    joined = events.join(marks, batch)  # a row for each batch: Spark broadcasts it only while it is small
    return joined.withColumn("late", F.coalesce(minute_end(F.col("event_time"), width) <= F.col("watermark"), F.lit(False))).drop("watermark")


def event_counters(events: DataFrame) -> DataFrame:
    """Sent events, and those that repeat an earlier id or stand behind a later time."""
    return events.agg(F.count("*").alias("sent"), F.count_if("duplicate").alias("duplicates"), F.count_if("out_of_order").alias("out_of_order"))
