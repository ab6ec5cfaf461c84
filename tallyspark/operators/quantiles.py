"""Exact percentiles by distributed selection: passes of counting, with no task that holds the distinct values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def exact_percentiles(rows: DataFrame, columns: list[str], fractions: tuple[float, ...], buckets: int = BUCKETS) -> dict[str, list[float] | None]:
    """For each numeric column its percentiles as doubles, interpolated as ``F.percentile`` does; None where it has no values.

    Nulls and NaN count for nothing.  A pass counts the values of each range of interest in ``buckets`` equal parts; the part that
    holds a wanted rank, from its own smallest to its own largest value, is the next pass's range, until the two are
    the same.  So a shuffle carries ``buckets`` rows from each task and range, and the driver sees as many; both ends
    of a range fall into different parts, so it shrinks each time, mostly to a ``buckets``-th.  ``rows`` is read once for each pass: hand in a written table.
    """
    values = rows.select(*(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"v{k}") for k, c in enumerate(columns)))
    first = values.agg(*(f(f"v{k}").alias(f"{n}{k}") for k in range(len(columns)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    #: (column, rank) -> (smallest, largest, values before the range)
    wanted = {}
    for k in range(len(columns)):
        for p in fractions if first[f"n{k}"] else ():
            place = p * (first[f"n{k}"] - 1)
            for rank in (math.floor(place), math.ceil(place)):
                wanted[k, rank] = (first[f"a{k}"], first[f"b{k}"], 0)
    while open_ranges := sorted({(k, *wanted[k, rank]) for k, rank in wanted if wanted[k, rank][0] < wanted[k, rank][1]}):
        cells = []
        for t, (k, a, b, _) in enumerate(open_ranges):
            v, half = F.col(f"v{k}"), b / 2 - a / 2  # halves keep the width of finite ranges finite
            if 0 < half < math.inf:
                part = F.least(F.floor((v / 2 - a / 2) / half * buckets), F.lit(buckets - 1)).cast("int")
            else:
                part = F.when(v == a, 0).when(v == b, 2).otherwise(1)
            cells.append(F.when(v.between(a, b), F.struct(F.lit(t).alias("t"), part.alias("part"), v.alias("v"))))
        hits = values.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        counted = hits.groupBy("t", "part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        parts: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["t"], r["part"])):  # `buckets` rows for each range
            parts.setdefault(r["t"], []).append((r["a"], r["b"], r["n"]))
        of = {range_: parts[t] for t, range_ in enumerate(open_ranges)}
        for (k, rank), (a, b, before) in list(wanted.items()):
            for low, high, n in of.get((k, a, b, before), ()):
                if rank < before + n:
                    wanted[k, rank] = (low, high, before)
                    break
                before += n
    out: dict[str, list[float] | None] = {}
    for k, c in enumerate(columns):
        n = first[f"n{k}"]
        found = []
        for p in fractions if n else ():
            place = p * (n - 1)
            low, high = math.floor(place), math.ceil(place)
            x, y = wanted[k, low][0], wanted[k, high][0]
            found.append(x if low == high or x == y else (high - place) * x + (place - low) * y)
        out[c] = found if n else None
    return out
