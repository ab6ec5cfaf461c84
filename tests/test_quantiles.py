"""Exact percentiles by selection against Spark's own and against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import quantiles
from tallyspark.operators.customers import THIRDS


def sorted_percentiles(values, fractions):
    x, out = sorted(values), []
    for p in fractions:
        place = p * (len(x) - 1)
        a, b = math.floor(place), math.ceil(place)
        out.append(x[a] if x[a] == x[b] else (b - place) * x[a] + (place - a) * x[b])
    return out


@pytest.mark.parametrize("buckets", [2, 3, 1024])
def test_against_sorting(spark, buckets):
    r = random.Random(buckets)
    tables = [
        [r.uniform(-5, 5) for _ in range(501)], [float(r.choice([1, 1, 1, 2, 9])) for _ in range(200)], [7.0], [1.0, 2.0], [r.lognormvariate(0, 9) for _ in range(333)],
        [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0], [math.inf, -math.inf, 1.0, 2.0, 3.0],
    ]
    for values in tables:
        rows = spark.createDataFrame([(v, k) for k, v in enumerate([*values, None, math.nan])], "x double, n long").repartition(3).cache()
        fractions = (0.0, *THIRDS, 0.5, 1.0)
        got = quantiles.exact_percentiles(rows, ["x", "n"], fractions, buckets)
        assert got == {"x": sorted_percentiles(values, fractions), "n": sorted_percentiles(range(len(values) + 2), fractions)}


def test_no_values(spark):
    rows = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_percentiles(rows, ["x"], THIRDS) == {"x": None}
    assert quantiles.exact_percentiles(rows.limit(0), ["x"], THIRDS) == {"x": None}


def test_a_million_distinct_values(spark, tmp_path):
    """As exact as Spark's percentile; a pass's result, which is all that a shuffle brings together, has no more than ``buckets`` rows for a range."""
    rows = spark.range(1_000_000, numPartitions=8).select((F.pmod(F.xxhash64("id"), F.lit(10**12)) / F.lit(100)).cast("decimal(30,6)").alias("x"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    sizes, collect = [], type(rows).collect

    def counted(self):
        out = collect(self)
        sizes.append(len(out))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "collect", counted)
        got = quantiles.exact_percentiles(rows, ["x"], THIRDS)
    want = rows.agg(F.percentile("x", F.array(*map(F.lit, THIRDS)))).first()[0]
    assert got["x"] == pytest.approx(want, rel=1e-15) and len(sizes) <= 6 and max(sizes) <= 4 * quantiles.BUCKETS
