from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.config import ExperimentPlan
from tallyspark.operators import customers, ledger, ranking
from tallyspark.schema import LEDGER


def raw(spark, rows):
    return spark.createDataFrame([(f"r{n}", str(n), h, *rest) for n, (h, *rest) in enumerate(rows, 1)], LEDGER)


ROWS = [
    ("h1", "100", "A", "apple", "2", "2011-01-05T10:00", "2.5", "c1", "UK"), ("h2", "101", "B", "", "3", "2011-01-06T10:00", "1.5", "c1", "France"), ("h2", "101", "B", "", "3", "2011-01-06T10:00", "1.5", "c1", "France"),
    ("h3", "C102", "A", "red apple", "-1", "2011-02-01T09:30", "1.25", "c1", "UK"), ("h4", "103", "A", "x", "1.5", "2011-02-01T09:30", "1", "c2", "UK"), ("h5", " ", "A", "x", "1", "2011-02-01T09:30", "1", "c2", "UK"),
    ("h6", "104", "A", "x", "1", "never", "1", "", "UK"), ("h7", "105", "A", "x", "-1", "2011-02-01T09:30", "1", "c2", "UK"), ("h8", "c106", "A", "x", "1", "2011-02-01T09:30", "1", "c2", "UK"), ("h9", "107", "A", "x", "1", "2011-02-01T09:30", "0", "c2", "UK"),
]


def test_classification(spark):
    got = {r.source_row_id: r for r in ledger.classify(raw(spark, ROWS)).collect()}
    kinds = {k: (r.disposition, r.reason) for k, r in got.items()}
    assert kinds == {
        "r1": ("PURCHASE", None), "r2": ("PURCHASE", None), "r3": ("EXCLUDED_DUPLICATE", "SUSPECTED_EXACT_DUPLICATE"), "r4": ("CANCELLATION", None), "r5": ("QUARANTINED", "INVALID_QUANTITY"), "r6": ("QUARANTINED", "MISSING_TRANSACTION_KEY"),
        "r7": ("QUARANTINED", "INVALID_TIME"), "r8": ("QUARANTINED", "NEGATIVE_WITHOUT_CANCELLATION"), "r9": ("QUARANTINED", "CANCELLATION_SIGN_CONFLICT"), "r10": ("QUARANTINED", "NONPOSITIVE_OR_INVALID_PRICE"),
    }
    assert got["r3"].duplicate_of == "r2" and got["r4"].cancellation_link == "UNMATCHED" and got["r7"].transaction_month == "INVALID" and not got["r3"].customer_eligible
    assert sum(r.signed_amount for r in got.values() if r.disposition == "PURCHASE") == D("9.500000") and got["r4"].signed_amount == D("-1.250000")


def test_dimensions_and_reconciliation(spark):
    source = raw(spark, ROWS)
    audit = ledger.classify(source)
    facts = ledger.facts(audit)
    products, people = ledger.products(facts), ledger.customers(facts)
    assert {tuple(r) for r in products.collect()} == {("A", "red apple"), ("B", None)} and {tuple(r) for r in people.collect()} == {("c1", "UK")}
    assert ledger.reconcile(source, audit, facts, products, people, 10)["facts"] == 3
    assert tuple(ledger.summary(audit, "PURCHASE").first()) == (2, 2, D("9.500000")) and tuple(ledger.summary(audit.limit(0), "PURCHASE").first()) == (0, 0, D("0.000000"))
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, audit, facts, products.limit(1), people)
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, audit, facts, products, people, 11)


def test_month_filter_prunes_partitions(spark, tmp_path):
    ledger.facts(ledger.classify(raw(spark, ROWS))).write.partitionBy("transaction_month").parquet(str(tmp_path / "facts"))
    month = ledger.month_amount(spark.read.parquet(str(tmp_path / "facts")), "2011-01")
    assert "PartitionFilters: [isnotnull(transaction_month" in month._jdf.queryExecution().toString() and month.first()[0] == D("9.500000")


def fact(customer, time, amount, invoice="1", stock="A", kind="PURCHASE", country="UK", row="r1"):
    return (customer, time, D(amount), invoice, stock, kind, country, row)


FACTS = "customer_id string, invoice_time string, signed_amount decimal(30,6), invoice_no string, stock_code string, disposition string, country string, source_row_id string"


def test_features_see_only_the_window(spark):
    day = date(2011, 6, 1)
    rows = [fact("a", "2011-05-01 10:00:00", "10"), fact("a", "2011-05-02 10:00:00", "5", "2", "B", country="Spain", row="r2"), fact("a", "2011-05-03 10:00:00", "-2", "C3", kind="CANCELLATION", country="Italy", row="r3"), fact("a", "2011-06-01 00:00:00", "99", "4", "Z", row="r4"), fact("b", "2011-06-02 00:00:00", "1", "5"), fact("c", "2011-05-09 00:00:00", "-1", "C6", kind="CANCELLATION"), fact(None, "2011-05-01 10:00:00", "7")]
    got = customers.features(spark.createDataFrame(rows, FACTS), day).collect()
    assert [(r.customer_id, r.orders, r.purchase_amount, r.recency_days, r.cancellation_amount, r.country, r.preferred_product) for r in got] == [("a", 2, D("15.000000"), 30, D("-2.000000"), "Italy", "A")]
    labels = {r.customer_id: r.label for r in customers.samples(spark.createDataFrame(rows, FACTS), day, 180, 30).collect()}
    assert labels == {"a": 1.0}
    assert customers.samples(spark.createDataFrame(rows[:3], FACTS), day, 180, 30).first().label == 0.0


def test_profiles(spark):
    rows = [(f"c{i}", o, D(m), r, D(0)) for i, (o, m, r) in enumerate([(1, "5", 1), (2, "50", 100), (9, "900", 2), (3, "90", 3), (2, "60", 50), (4, "100", 10)])]
    table = spark.createDataFrame(rows, "customer_id string, orders long, purchase_amount decimal(30,6), recency_days int, cancellation_amount decimal(30,6)")
    got = {r.customer_id: r.segment for r in customers.profiles(table).collect()}
    assert got["c0"] == "SINGLE_PURCHASE" and got["c1"] == "AT_RISK" and got["c2"] == "HIGH_VALUE" and got["c3"] == "REPEAT_CUSTOMER"
    page = customers.page(customers.profiles(table), 2).collect()
    assert [(r.customer_id, r.has_more) for r in page] == [("c0", True), ("c1", True)]
    assert [r.customer_id for r in customers.page(customers.profiles(table), 4, after="c3").collect()] == ["c4", "c5"]
    with pytest.raises(ValueError):
        customers.page(table, 0)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(f"c{i}", "d", float(y), s) for i, (y, s) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (0, 0.0)])], "customer_id string, observation string, label double, score double")
    m = ranking.ranking_metrics(rows, 0.4).first()
    assert (m.samples, m.positives, m.k, m.precision_at_k, m.recall_at_k) == (5, 2, 2, 0.5, 0.5) and abs(m.lift_at_k - 1.25) < 1e-12
    assert abs(ranking.pr_auc(rows) - 0.791667) < 1e-5
    none = rows.withColumn("label", F.lit(0.0))
    assert ranking.pr_auc(none) is None and ranking.ranking_metrics(none, 0.4).first().lift_at_k is None
    for bad in (rows.limit(0), rows.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            ranking.ranking_metrics(bad, 0.4)


def test_plan():
    plan = ExperimentPlan((date(2011, 6, 1),), (date(2011, 7, 1),), (date(2011, 8, 1),), 90, 30)
    assert plan.available(date(2011, 6, 1), date(2011, 3, 3), date(2011, 7, 1)) and not plan.available(date(2011, 6, 1), date(2011, 3, 4), date(2011, 7, 1))
    for bad in ({"training": ()}, {"history_days": 0}, {"horizon_days": 0}, {"contact_fraction": 0}, {"validation": (date(2011, 6, 15),)}):
        with pytest.raises(ValueError):
            ExperimentPlan(**{**plan.__dict__, **bad})


def shuffles(df):
    """Exchanges of the plan before it runs, and the columns of the widest."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text


def test_classification_deals_rows_out_once(spark):
    """No join back to the rows and no copy of them: one exchange, by content."""
    assert shuffles(ledger.classify(raw(spark, ROWS)))[0] == 1
    rows = [("same", "1", "A", "x", "1", "2011-01-05T10:00", "2", "c", "UK")] * 3
    got = {r.source_row_id: r.duplicate_of for r in ledger.classify(raw(spark, [(None, *rows[0][1:]), (None, *rows[0][1:]), *rows])).collect()}
    assert got == {"r1": None, "r2": "r1", "r3": None, "r4": "r3", "r5": "r3"}  # rows without a content count as equal
    blind = ledger.classify(raw(spark, rows).withColumn("source_row", F.lit(None).cast("string")))
    assert blind.where("duplicate_of IS NOT NULL").count() == 0  # none of them is known to be the first


def test_order_lines_are_dealt_out_once(spark):
    from tallyspark.plans import adapters

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, plan = shuffles(adapters.ledger_rows(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("l_orderkey" in x or "l_linenumber" in x or "source_row" in x)]
    assert len(wide) == 1 and "hashpartitioning(l_orderkey" in wide[0]


def test_order_lines_travel_without_columns_that_no_row_shows(spark, tmp_path):
    """Status and shipping day are neither dealt out nor sorted by, and twins that differ in them alone give the rows that they gave."""
    from tallyspark.plans import adapters

    _, plan = shuffles(adapters.ledger_rows(spark, "/root/testdata/sf0.001"))
    assert "l_partkey" in plan and "l_shipdate" not in plan and "l_linestatus" not in plan
    source = "/root/testdata/sf0.001"
    for name in ("orders", "customer", "nation"):
        adapters.table(spark, source, name).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = adapters.table(spark, source, "lineitem").limit(200)
    again = lines.withColumn("l_linestatus", F.lit("x")).withColumn("l_shipdate", F.col("l_shipdate") - F.expr("INTERVAL 1 DAY"))
    lines.unionByName(again).write.parquet(f"{tmp_path}/lineitem.parquet")
    both = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    order = [c for c in both.columns if c not in ("l_orderkey", "l_linenumber")]
    turn = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    numbered = both.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + turn).alias("n"), "l_partkey", "l_returnflag", "l_orderkey").collect()
    want = sorted((f"r{x.n}", f"P{x.l_partkey}", " " if x.n % 97 == 6 else f"{'C' if x.l_returnflag == 'R' else ''}{x.l_orderkey}") for x in numbered)
    assert len(want) == 400 and want == sorted((x.source_row_id, x.stock_code, x.invoice_no) for x in adapters.ledger_rows(spark, str(tmp_path)).collect())


def test_a_lost_and_a_repeated_row_are_found(spark):
    """One row lost and another of the same amount in its place twice: count and amount agree."""
    source = raw(spark, [("a", "1", "A", "x", "1", "2011-01-05T10:00", "2", "c", "UK"), ("b", "2", "A", "x", "1", "2011-01-05T10:00", "2", "c", "UK")])
    audit = ledger.classify(source)
    forged = audit.where("source_row = 1").unionByName(audit.where("source_row = 1"))
    facts = ledger.facts(audit)
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, forged, facts, ledger.products(facts), ledger.customers(facts))
    twice = source.where("source_row = '1'").unionByName(source.where("source_row = '1'"))
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(twice, forged, facts, ledger.products(facts), ledger.customers(facts))


def test_audit_of_order_lines_deals_them_out_once(spark):
    """Numbering, the join to orders and classification share one exchange of the lines."""
    from tallyspark.plans import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, plan = shuffles(queries._audit(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in wide if "content_hash" in x] and len([x for x in wide if "l_orderkey" in x]) == 1


def test_differences_shuffle_names_of_rows(spark):
    rows = [(None, "a", D("1.5"), 0.0), ("a", None, D("1.5"), 0.0), ("a", "b", None, float("nan")), ("a", "b", None, float("nan")), ("ab", "", None, None)]
    kind = "x string, y string, z decimal(30,6), v double"
    left = spark.createDataFrame(rows, kind)
    right = spark.createDataFrame([("a", None, D("1.5"), -0.0), ("a", "b", None, float("nan")), ("", "ab", None, None)], kind)
    found = ranking.differences(left, right)
    assert {tuple(r) for r in found.collect()} == {("only left", 3), ("only right", 1)}
    assert {tuple(r) for r in ranking.differences(left, left).collect()} == {("only left", 0), ("only right", 0)}
    exchange = [x for x in shuffles(found)[1].splitlines() if "Exchange hashpartitioning" in x]
    assert exchange and all("hashpartitioning(name_1" in x for x in exchange)


def test_ids_are_counted_in_parts_of_bounded_size(spark):
    """The number of tasks that count ids follows the rows, not the session's shuffles; sums are the same."""
    source = raw(spark, ROWS)
    source = source.unionByName(source.where("source_row < 4")).unionByName(source.withColumn("source_row_id", F.lit(None).cast("string")).where("source_row < 3"))
    assert ledger.source_totals(source, 7).collect() == ledger.source_totals(source).collect() and tuple(ledger.source_totals(source, 7).first())[:2] == (15, 10)
    assert ledger.source_totals(source.limit(0), 7).collect() == ledger.source_totals(source.limit(0)).collect()
    assert [x for x in shuffles(ledger.source_totals(source, 7))[1].splitlines() if "hashpartitioning(source_row_id" in x and ", 7)" in x]
