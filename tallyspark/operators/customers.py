"""Customer features, RFM profiles, segments, pages and repurchase samples."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExperimentPlan
from ..schema import AMOUNT, AT_RISK, CANCELLATION, HIGH_VALUE, PURCHASE, REPEAT_CUSTOMER, SINGLE_PURCHASE
from ..staging import settle
from .quantiles import exact_percentiles

THIRDS = (0.3333333333, 0.6666666667)


def in_window(facts: DataFrame, start: date, end: date) -> DataFrame:
    """Facts of known customers from ``start`` to before ``end``; ISO times compare as text."""
    return facts.where(F.col("customer_id").isNotNull() & (F.col("invoice_time") >= start.isoformat()) & (F.col("invoice_time") < end.isoformat()))


def purchase_totals(window: DataFrame, observation: date) -> DataFrame:
    bought = window.where(F.col("disposition") == PURCHASE)
    return bought.groupBy("customer_id").agg(
        F.count_distinct("invoice_no").alias("orders"), F.sum("signed_amount").cast(AMOUNT).alias("purchase_amount"), F.date_diff(F.lit(observation), F.max(F.col("invoice_time").cast("date"))).alias("recency_days"),
        F.min("invoice_time").alias("first_purchase"), F.max("invoice_time").alias("last_purchase"),
    )


def cancellation_totals(window: DataFrame) -> DataFrame:
    return window.where(F.col("disposition") == CANCELLATION).groupBy("customer_id").agg(F.sum("signed_amount").cast(AMOUNT).alias("cancellation_amount"))


def latest_country(window: DataFrame) -> DataFrame:
    """The country of a customer's latest row; equal times go by row id."""
    return window.groupBy("customer_id").agg(F.max_by("country", F.struct("invoice_time", "source_row_id")).alias("country"))


def preferred_product(window: DataFrame) -> DataFrame:
    """The product a customer spent most on; equal amounts go by code."""
    spent = window.where(F.col("disposition") == PURCHASE).groupBy("customer_id", "stock_code").agg(F.sum("signed_amount").alias("amount"))
    return spent.groupBy("customer_id").agg(F.min_by("stock_code", F.struct(F.negative("amount"), "stock_code")).alias("preferred_product"))


def features(facts: DataFrame, observation: date, window_days: int = 180) -> DataFrame:
    """A row for each customer with a purchase in the window before the observation date."""
    if not 1 <= window_days <= 366:
        raise ValueError("window-days must be 1 to 366")
    window = in_window(facts, observation - timedelta(days=window_days), observation)
    bought, cancelled = F.col("disposition") == PURCHASE, F.col("disposition") == CANCELLATION
    when = lambda c: F.when(bought, F.col(c))
    # one pass for all that groups by customer, one for spending by product
    totals = window.groupBy("customer_id").agg(
        F.count_distinct(when("invoice_no")).alias("orders"), F.sum(when("signed_amount")).cast(AMOUNT).alias("purchase_amount"), F.date_diff(F.lit(observation), F.max(when("invoice_time").cast("date"))).alias("recency_days"),
        F.min(when("invoice_time")).alias("first_purchase"), F.max(when("invoice_time")).alias("last_purchase"), F.coalesce(F.sum(F.when(cancelled, F.col("signed_amount"))).cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("cancellation_amount"),
        F.max_by("country", F.struct("invoice_time", "source_row_id")).alias("country"), F.count_if(bought).alias("purchases"),
    )
    return totals.where("purchases > 0").drop("purchases").join(preferred_product(window), "customer_id", "left")


def thresholds(customer_features: DataFrame) -> DataFrame:
    """Exact thirds of recency, orders and amount: one row of three arrays.  They are found at once, in a few passes over the written rows."""
    return _thresholds(settle(customer_features.select("recency_days", "orders", "purchase_amount")))


def _thresholds(stored: DataFrame) -> DataFrame:
    names = {"recency_days": "recency", "orders": "frequency", "purchase_amount": "monetary"}
    found = exact_percentiles(stored, list(names), THIRDS)
    cut = lambda values: F.lit(None).cast("array<double>") if values is None else F.array(*map(F.lit, values))
    return stored.sparkSession.range(1).select(*(cut(found[c]).alias(n) for c, n in names.items()))


def _third(value: str, cuts: str, rising: bool) -> Column:
    marks = (1, 2, 3) if rising else (3, 2, 1)
    v = F.col(value).cast("double")
    return F.when(v <= F.col(cuts)[0], marks[0]).when(v <= F.col(cuts)[1], marks[1]).otherwise(marks[2])


def profiles(customer_features: DataFrame) -> DataFrame:
    """Features with r, f and m scores and a segment."""
    customer_features = settle(customer_features)
    scored = customer_features.crossJoin(F.broadcast(_thresholds(customer_features)))  # one row
    scored = scored.withColumn("r_score", _third("recency_days", "recency", False)).withColumn("f_score", _third("orders", "frequency", True)).withColumn("m_score", _third("purchase_amount", "monetary", True))
    segment = F.when(F.col("orders") == 1, SINGLE_PURCHASE).when(F.col("r_score") == 1, AT_RISK).when((F.col("f_score") == 3) & (F.col("m_score") == 3), HIGH_VALUE).otherwise(REPEAT_CUSTOMER)
    return scored.drop("recency", "frequency", "monetary").withColumn("segment", segment)


def broken_profiles(rows: DataFrame) -> DataFrame:
    """Profiles that break an invariant of the store."""
    bad = (F.coalesce(F.trim("customer_id"), F.lit("")) == "") | (F.col("orders") < 1) | (F.col("recency_days") < 0) | (F.col("purchase_amount") <= 0) | (F.col("cancellation_amount") > 0)
    return rows.where(F.coalesce(bad, F.lit(True)))


def segment_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("purchase_amount").cast("decimal(38,6)").alias("purchase_amount"), F.sum("cancellation_amount").cast("decimal(38,6)").alias("cancellation_amount"), F.sum("orders").alias("orders"),
    ).orderBy("segment")


def check_page(limit: int) -> None:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")


def page(rows: DataFrame, limit: int = 100, after: str | None = None, segment: str | None = None, customer_id: str | None = None) -> DataFrame:
    """The next ``limit`` customers by id; ``has_more`` says whether others follow, the last id is the next ``after``."""
    check_page(limit)
    for column, value in (("segment", segment), ("customer_id", customer_id)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(F.col("customer_id") > after) if after is not None else rows
    found = rows.orderBy("customer_id").limit(limit + 1)
    more = found.agg((F.count("*") > limit).alias("has_more"))  # one row
    return found.orderBy("customer_id").limit(limit).crossJoin(F.broadcast(more))


def samples_at(facts: DataFrame, dates: list[date], history_days: int, horizon_days: int) -> DataFrame:
    """Features at each observation date, labelled 1.0 if the customer buys within the horizon from that date on.

    Features only see what was before the date, so the future changes labels alone.  One pass over the facts serves all
    dates: a fact is repeated for the dates that it is the past or the near future of.
    """
    if not 1 <= history_days <= 366:
        raise ValueError("window-days must be 1 to 366")
    bought, time = F.col("disposition") == PURCHASE, F.col("invoice_time")
    roles = []
    for d in sorted(set(dates)):
        start, end = (d - timedelta(days=history_days)).isoformat(), (d + timedelta(days=horizon_days)).isoformat()
        past = F.when((time >= start) & (time < d.isoformat()), True).when((time >= d.isoformat()) & (time < end) & bought, False)
        roles.append(F.struct(F.lit(d.isoformat()).alias("observation"), F.lit(d).alias("day"), past.alias("past")))
    near = in_window(facts, min(dates) - timedelta(days=history_days), max(dates) + timedelta(days=horizon_days))
    rows = near.select("customer_id", "invoice_no", "stock_code", "disposition", "invoice_time", "signed_amount", "country", "source_row_id", F.explode(F.filter(F.array(*roles), lambda r: r["past"].isNotNull())).alias("role")).select("*", "role.*").drop("role")
    mine = F.col("past") & bought
    when = lambda c: F.when(mine, F.col(c))
    zero, cancelled = F.lit(0).cast(AMOUNT), F.col("past") & (F.col("disposition") == CANCELLATION)
    totals = rows.groupBy("customer_id", "observation", "day").agg(
        F.count_distinct(when("invoice_no")).alias("orders"), F.sum(when("signed_amount")).cast(AMOUNT).alias("purchase_amount"), F.date_diff("day", F.max(when("invoice_time").cast("date"))).alias("recency_days"),
        F.min(when("invoice_time")).alias("first_purchase"), F.max(when("invoice_time")).alias("last_purchase"), F.coalesce(F.sum(F.when(cancelled, F.col("signed_amount"))).cast(AMOUNT), zero).alias("cancellation_amount"),
        F.max_by("country", F.when(F.col("past"), F.struct("invoice_time", "source_row_id"))).alias("country"), F.count_if(mine).alias("purchases"), F.max(F.when(F.col("past"), 0.0).otherwise(1.0)).alias("label"),
    ).where("purchases > 0")
    spent = rows.where(mine).groupBy("customer_id", "observation", "stock_code").agg(F.sum("signed_amount").alias("amount"))
    favourite = spent.groupBy("customer_id", "observation").agg(F.min_by("stock_code", F.struct(F.negative("amount"), "stock_code")).alias("preferred_product"))
    return totals.drop("purchases", "day").join(favourite, ["customer_id", "observation"], "left").select(
        "customer_id", "orders", "purchase_amount", "recency_days", "first_purchase", "last_purchase", "cancellation_amount", "country", "preferred_product", "observation", "label",
    )


def samples(facts: DataFrame, observation: date, history_days: int, horizon_days: int) -> DataFrame:
    return samples_at(facts, [observation], history_days, horizon_days)


def all_samples(facts: DataFrame, plan: ExperimentPlan, start: date, end: date) -> DataFrame:
    """Samples of all observation dates of a plan; data from ``start`` to before ``end`` must cover them."""
    missing = [d.isoformat() for d in plan.dates() if not plan.available(d, start, end)]
    if missing:
        raise ValueError(f"the data don't cover {', '.join(missing)}")
    return samples_at(facts, list(plan.dates()), plan.history_days, plan.horizon_days)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("observation", "label").agg(F.count("*").alias("samples")).orderBy("observation", "label")


def observed(rows: DataFrame, dates: list[date]) -> DataFrame:
    return rows.where(F.col("observation").isin([d.isoformat() for d in dates]))
