"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import settle


def connected_components(edges: DataFrame, folder: str, name: str, size: int = 0) -> DataFrame:
    """``node`` and ``component`` (the component's smallest node) for each node of ``edges`` (a, b; long).

    Each step hangs a node's neighbours onto the smallest of them, so a component becomes a star within a number of
    steps logarithmic in its size.  A step's minimum is taken before rows of a node meet (partial aggregation), its
    join has AQE split frequent nodes, and its result is written to ``folder``: nothing is collected but a count and
    a checksum.  ``size`` is the bytes that the edges come from, which sizes the files.  Loops and null ends are ignored; an empty input gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, before, step = settle(now, folder, f"{name}-0", size), None, 0
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, step = state, step + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = settle(large, folder, f"{name}-{step}-large", size)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        now = settle(small, folder, f"{name}-{step}", size)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
