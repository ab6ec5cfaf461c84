import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import metrics, snapshots
from tallyspark.schema import CLICK, PAYMENT, REFUND

START = datetime(2026, 1, 15, 10)
SCHEMA = "event_id string, order_id string, user_id string, product_id string, event_type string, amount decimal(38,2), quantity int, event_time timestamp_ntz, arrival long"


def at(ms):
    return START + timedelta(milliseconds=ms)


def events(spark, rows):
    return spark.createDataFrame([(*r[:5], D(r[5]), r[6], at(r[7]), n) for n, r in enumerate(rows)], SCHEMA)


STREAM = [
    ("a", "o1", "u1", "p1", PAYMENT, "12.30", 1, 0), ("b", "o2", "u2", "p2", PAYMENT, "30.00", 1, 59_999), ("a", "o1", "u1", "p1", PAYMENT, "12.30", 1, 0), ("c", "o3", "u1", "p1", PAYMENT, "7.70", 2, 10_000),
    ("r", "o1", "u1", "p1", REFUND, "2.30", 1, 50_000), ("d", "o4", "u3", "p3", PAYMENT, "20.00", 1, 20_000), ("next", "o5", "u1", "p1", PAYMENT, "5.00", 1, 60_000), ("advance", None, "u1", "p1", CLICK, "0.00", 1, 152_000),
]


def test_minute_totals(spark):
    rows = metrics.window_totals(metrics.deduplicate(events(spark, STREAM))).orderBy("window_start").collect()
    assert [(r.paid_orders, r.paid_users, r.paid_quantity, r.gmv, r.refunds, r.refund_amount) for r in rows] == [(4, 3, 5, D("70.00"), 1, D("2.30")), (1, 1, 1, D("5.00"), 0, D("0.00"))]
    assert rows[0].window_end == at(60_000)


def test_ranking_breaks_ties_by_id(spark):
    products = metrics.product_totals(events(spark, STREAM))
    first = metrics.ranking_array(products, 2).orderBy("window_start").first()
    assert [(p.product_id, p.gmv) for p in first.products] == [("p2", D("30.00")), ("p1", D("20.00"))]
    assert metrics.ranking_array(products, 10).orderBy("window_start").first().products[2].product_id == "p3"


def test_first_payment_of_an_order_counts(spark):
    rows = [("e1", "o1", "u1", "p", PAYMENT, "12.30", 1, 0), ("e2", "o1", "u9", "p", PAYMENT, "99.00", 5, 1), ("e3", "o2", "u1", "p", PAYMENT, "0.20", 1, 2), ("e4", "o3", "u2", "p", PAYMENT, "0.10", 1, 3), ("r1", "o1", "u1", "p", REFUND, "2.30", 1, 4)]
    r = metrics.window_totals(events(spark, rows)).first()
    assert (r.paid_orders, r.paid_users, r.paid_quantity, r.gmv, r.refunds, r.refund_amount) == (3, 2, 3, D("12.60"), 1, D("2.30"))


def test_ranking_is_the_same_in_any_order(spark):
    rows = [(f"e{i}", f"o{i}", "u", p, PAYMENT, a, 1, i) for i, (p, a) in enumerate([("a", "12.30"), ("b", "12.30"), ("c", "20.00")])]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = metrics.ranking_array(metrics.product_totals(events(spark, rows)), 2).first().products
        assert [p.product_id for p in got] == ["c", "a"]


def test_empty_input_and_bad_size(spark):
    empty = events(spark, STREAM).limit(0)
    assert metrics.window_totals(empty).count() == metrics.ranking_array(metrics.product_totals(empty)).count() == 0
    with pytest.raises(ValueError):
        metrics.top_products(metrics.product_totals(empty), 0)


def test_same_id_in_another_window_is_another_event(spark):
    rows = [("a", "o1", "u", "p", PAYMENT, "1.00", 1, 0), ("a", "o1", "u", "p", PAYMENT, "1.00", 1, 60_000)]
    assert metrics.deduplicate(events(spark, rows)).count() == 2


def test_late_split(spark):
    batches = spark.createDataFrame([(1, at(0)), (1, at(95_000)), (2, at(10_000)), (2, at(61_000)), (3, at(5_000))], "batch int, event_time timestamp_ntz")
    got = {(r.batch, r.event_time): r.late for r in metrics.late_split(batches, "30 SECONDS").collect()}
    assert got == {(1, at(0)): False, (1, at(95_000)): False, (2, at(10_000)): True, (2, at(61_000)): False, (3, at(5_000)): True}


def versions(spark, rows):
    return spark.createDataFrame([("d", v, START, n, p) for n, (v, p) in enumerate(rows)], "dataset string, result_version long, window_start timestamp_ntz, seq long, products array<struct<product_id string, gmv decimal(38,2), paid_orders long, paid_users long, paid_quantity long>>")


def test_versions_converge_and_empty_rankings_replace(spark):
    p = lambda *ids: [(i, D("1.00"), 1, 1, 1) for i in ids]
    rows = [(1, p("a", "b")), (2, p("c")), (1, p("a")), (2, p("d")), (3, []), (2, p("e"))]
    seen = [snapshots.newest(versions(spark, rows[:n])).first() for n in range(1, 7)]
    assert [[x.product_id for x in r.products] for r in seen] == [["a", "b"], ["c"], ["c"], ["d"], [], []]
    ready = snapshots.ranking(versions(spark, rows), "d", START, 3, 5).collect()
    assert [(r["rank"], r.product_id) for r in ready] == [(0, None)]
    assert snapshots.ranking(versions(spark, rows), "d", START, 2, 5).count() == 0


def test_range_and_validation(spark):
    rows = spark.createDataFrame([("d", 1, at(m * 60_000)) for m in (2, 0, 1)], "dataset string, result_version long, window_start timestamp_ntz")
    got = snapshots.window_range(rows, "d", START, at(120_000), 1).collect()
    assert [(r.window_start, r.truncated) for r in got] == [(START, True)]
    assert [r.truncated for r in snapshots.window_range(rows, "d", START, at(120_000), 5).collect()] == [False, False]
    for bad in ((START, START, 1), (START, START + timedelta(hours=25), 1), (START, at(1000), 0)):
        with pytest.raises(ValueError):
            snapshots.window_range(rows, "d", *bad)
    with pytest.raises(ValueError):
        snapshots.check_ranking(at(1), 1, 10)


def test_exact_numbers_keep_all_digits(spark):
    rows = spark.range(1).select(F.lit(9007199254740993).alias("n"), F.lit("9007199254740993.12").cast("decimal(38,2)").alias("m"))
    assert tuple(snapshots.exact_numbers(rows).first()) == ("9007199254740993", "9007199254740993.12")
