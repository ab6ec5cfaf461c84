"""Scored samples: ranking metrics, baselines, examples, stored scores and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SCORE
from ..staging import settle

#: Best first; ties by observation, then customer.
ORDER = (F.desc, "score"), (F.asc, "observation"), (F.asc, "customer_id")


def _order() -> list[Column]:
    return [direction(c) for direction, c in ORDER]


def model_inputs(rows: DataFrame) -> DataFrame:
    """The four numbers that models see, beside all columns."""
    log = lambda c: F.log1p(c.cast("double"))
    return rows.withColumn("recency", F.col("recency_days").cast("double")).withColumn("log_orders", log(F.col("orders"))).withColumn("log_purchase", log(F.col("purchase_amount"))).withColumn("log_cancellation", log(-F.col("cancellation_amount")))


def recency_baseline(rows: DataFrame) -> DataFrame:
    """Those who bought last come first."""
    return rows.withColumn("score", F.negative(F.col("recency_days").cast("double")))


def contacts(samples: int, fraction: float) -> int:
    return math.ceil(samples * fraction)


def top_fraction(scored: DataFrame, fraction: float) -> DataFrame:
    """The best ceil(n * fraction) samples: a distributed top-k, not an order over all rows."""
    scored = settle(scored)
    return scored.orderBy(*_order()).limit(contacts(scored.count(), fraction))


def ranking_metrics(scored: DataFrame, fraction: float) -> DataFrame:
    """samples, positives, prevalence, k, precision_at_k, recall_at_k and lift_at_k (null without positives): one row.

    ValueError for no samples, or scores that aren't finite numbers.
    """
    scored = settle(scored.select("score", "observation", "customer_id", "label"))
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    total = scored.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if not total["n"] or total["bad"]:
        raise ValueError("metrics need samples, and finite scores")
    k = contacts(total["n"], fraction)
    best = scored.orderBy(*_order()).limit(k).agg(F.sum("label").alias("hits"))
    all_ = scored.agg(F.count("*").alias("samples"), F.sum("label").cast("long").alias("positives"))
    rows = all_.crossJoin(F.broadcast(best))  # one row each
    prevalence = F.col("positives") / F.col("samples")
    some = F.col("positives") > 0
    return rows.select(
        "samples", "positives", prevalence.alias("prevalence"), F.lit(k).cast("long").alias("k"), (F.col("hits") / k).alias("precision_at_k"),
        F.when(some, F.col("hits") / F.nullif("positives", F.lit(0))).alias("recall_at_k"), F.when(some, F.col("hits") / k / F.nullif(prevalence, F.lit(0.0))).alias("lift_at_k"),
    )


def pr_auc(scored: DataFrame) -> float | None:
    """Area under the precision-recall curve with all thresholds; None without positives."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    if scored.where(F.col("label") == 1).isEmpty():
        return None
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderPR", numBins=0).evaluate(scored)


def error_examples(scored: DataFrame, n: int = 5) -> DataFrame:
    """The negatives scored highest and the positives scored lowest."""
    columns = ("customer_id", "observation", "label", "score")
    high = scored.where(F.col("label") == 0).orderBy(*_order()).limit(n).select(F.lit("false positive").alias("kind"), *columns)
    low = scored.where(F.col("label") == 1).orderBy(F.asc("score"), "observation", "customer_id").limit(n).select(F.lit("false negative").alias("kind"), *columns)
    return high.unionByName(low)


def stored_score(score: Column) -> Column:
    """A score from 0 to 1 with twelve decimals, rounded half up."""
    return F.round(score.cast("decimal(38,18)"), 12).cast(SCORE)


def coverage(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Customers with a profile and no score, or the other way round; none if scores cover the profiles exactly."""
    p, s = profiles.select("customer_id"), scores.select("customer_id")
    missing = p.join(s, "customer_id", "left_anti").withColumn("problem", F.lit("without score"))
    extra = s.join(p, "customer_id", "left_anti").withColumn("problem", F.lit("without profile"))
    return missing.unionByName(extra)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows either side has that the other hasn't, counting repeats.

    Rows are known by 128 bits: two 64-bit hashes of all values and of which are null.  Whole rows aren't shuffled; n
    different rows are told apart but for a chance of about n*n/2^129.
    """
    both = left.withColumn("sign", F.lit(1)).unionByName(right.withColumn("sign", F.lit(-1)))
    nulls = F.array(*[F.col(c).isNull() for c in left.columns])  # a hash skips nulls
    names = [F.xxhash64(F.lit(k), nulls, *left.columns).alias(f"name_{k}") for k in (1, 2)]
    more = both.select(*names, "sign").groupBy("name_1", "name_2").agg(F.sum("sign").alias("more"))
    sides = more.agg(F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("l"), F.coalesce(F.sum(F.greatest(F.negative("more"), F.lit(0))), F.lit(0)).alias("r"))
    return sides.select(F.inline(F.array(F.struct(F.lit("only left").alias("side"), F.col("l").alias("row_count")), F.struct(F.lit("only right").alias("side"), F.col("r").alias("row_count")))))
