"""The synthetic star-schema tables as the engine's inputs: commerce events, event JSON and raw ledger rows.

``EVENTS_SQL`` and ``LEDGER_SQL`` are the same in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CLICK, MONEY, ORDER, PAYMENT, REFUND, VIEW

TYPES = {"view": VIEW, "click": CLICK, "signup": ORDER, "purchase": PAYMENT, "error": REFUND}


#: Order lines to a task; their number is in the files' footers.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_type").isin("signup", "purchase", "error"), F.concat_ws("-", user, k)).alias("order_id"), user.alias("user_id"), F.concat(F.lit("p"), k).alias("product_id"),
        kinds[F.col("event_type")].alias("event_type"), F.col("value").cast(MONEY).alias("amount"), (1 + F.col("event_id") % 3).cast("int").alias("quantity"), F.col("ts").alias("event_time"), F.col("event_id").alias("arrival"),
    )


def with_repeats(events: DataFrame) -> DataFrame:
    """Every twentieth event arrives once more, behind all others."""
    again = events.where(F.col("arrival") % 20 == 0).withColumn("arrival", F.col("arrival") + F.lit(10**12))
    return events.unionByName(again)


EVENTS_SQL = """
e AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') END AS order_id,
         CAST(user_id AS VARCHAR) AS user_id, 'p' || json_extract_string(props, '$.k') AS product_id,
         CASE event_type WHEN 'view' THEN 'PRODUCT_VIEW' WHEN 'click' THEN 'PRODUCT_CLICK' WHEN 'signup' THEN 'ORDER_CREATED'
                         WHEN 'purchase' THEN 'PAYMENT_COMPLETED' WHEN 'error' THEN 'REFUND_COMPLETED' END AS event_type,
         CAST(value AS DECIMAL(38,2)) AS amount, CAST(1 + event_id % 3 AS INTEGER) AS quantity, ts AS event_time, event_id AS arrival
  FROM events)"""


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that hold ``LINES`` order lines each, one to a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def ledger_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Order lines as raw transactions, some of them spoilt by a rule over the row number; ``more`` names columns to keep beside these.

    They are dealt out by ``l_orderkey``, which rows of equal content share.
    """
    # lines that agree in all of these give the same raw row, so what else a line has needn't decide which comes first, nor travel
    rest = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *rest)
    twin = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    # dealt out by order once, for the numbers and for the join, in parts of bounded size; what orders bring along is joined to them first
    lines = lines.repartition(line_parts(spark, sf_dir), "l_orderkey").withColumn("source_row", F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + twin)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = lines.join(orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("source_row") % 97
    returned = F.col("l_returnflag") == "R"
    count = F.col("l_quantity").cast("long").cast("string")
    order = F.col("l_orderkey").cast("string")
    return joined.select(
        F.concat(F.lit("r"), F.col("source_row").cast("string")).alias("source_row_id"), F.col("source_row").cast("string").alias("source_row"), F.concat_ws("-", order, F.col("l_linenumber").cast("string")).alias("content_hash"),
        F.when(k == 6, " ").when(returned, F.concat(F.lit("C"), order)).otherwise(order).alias("invoice_no"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_code"),
        F.when(k == 7, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("description"),
        F.when(k == 0, "0").when(k == 5, "1.5").when(returned == (k == 1), count).otherwise(F.concat(F.lit("-"), count)).alias("quantity"),
        F.when(k == 3, "no time").otherwise(F.col("o_orderdate").cast("string")).alias("invoice_time"), F.when(k == 2, "0").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("unit_price"),
        F.when(k == 4, " ").otherwise(F.col("o_custkey").cast("string")).alias("customer_id"), F.col("n_name").alias("country"),
        *more,
    )


LEDGER_SQL = """
numbered AS (
  SELECT *, l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
  FROM lineitem),
raw AS (
  SELECT 'r' || n AS source_row_id, CAST(n AS VARCHAR) AS source_row, l_orderkey || '-' || l_linenumber AS content_hash,
    CASE WHEN n % 97 = 6 THEN ' ' WHEN l_returnflag = 'R' THEN 'C' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_no,
    'P' || l_partkey AS stock_code, CASE WHEN n % 97 = 7 THEN '' ELSE 'part ' || l_partkey END AS description,
    CASE WHEN n % 97 = 0 THEN '0' WHEN n % 97 = 5 THEN '1.5' WHEN (l_returnflag = 'R') = (n % 97 = 1) THEN '' ELSE '-' END
      || CASE WHEN n % 97 IN (0, 5) THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
    CASE WHEN n % 97 = 3 THEN 'no time' ELSE CAST(o_orderdate AS VARCHAR) END AS invoice_time,
    CASE WHEN n % 97 = 2 THEN '0' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS unit_price,
    CASE WHEN n % 97 = 4 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS customer_id, n_name AS country
  FROM numbered JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
cells AS (
  SELECT source_row_id, CAST(source_row AS BIGINT) AS source_row, content_hash, nullif(trim(invoice_no), '') AS invoice_no, nullif(trim(stock_code), '') AS stock_code,
    nullif(trim(description), '') AS description, TRY_CAST(quantity AS DECIMAL(18,6)) AS exact,
    CASE WHEN regexp_matches(trim(quantity), '^[+-]?[0-9]+$') THEN TRY_CAST(quantity AS BIGINT) END AS quantity, TRY_CAST(invoice_time AS TIMESTAMP) AS stamp,
    TRY_CAST(unit_price AS DECIMAL(18,6)) AS unit_price, nullif(trim(customer_id), '') AS customer_id, nullif(trim(country), '') AS country,
    count(*) OVER (PARTITION BY content_hash ORDER BY CAST(source_row AS BIGINT) ROWS UNBOUNDED PRECEDING) AS turn,
    min_by(source_row_id, CAST(source_row AS BIGINT)) OVER (PARTITION BY content_hash) AS head
  FROM raw),
judged AS (
  SELECT *, CAST(CAST(exact AS DECIMAL(38,6)) * unit_price AS DECIMAL(30,6)) AS signed_amount, coalesce(upper(invoice_no) LIKE 'C%', FALSE) AS cancels,
    CASE WHEN coalesce(invoice_no, stock_code) IS NULL OR invoice_no IS NULL OR stock_code IS NULL THEN 'MISSING_TRANSACTION_KEY' WHEN stamp IS NULL THEN 'INVALID_TIME'
         WHEN coalesce(quantity, 0) = 0 OR exact <> quantity THEN 'INVALID_QUANTITY' WHEN coalesce(unit_price, 0) <= 0 THEN 'NONPOSITIVE_OR_INVALID_PRICE'
         WHEN upper(invoice_no) LIKE 'C%' AND quantity > 0 THEN 'CANCELLATION_SIGN_CONFLICT' WHEN quantity < 0 AND NOT upper(invoice_no) LIKE 'C%' THEN 'NEGATIVE_WITHOUT_CANCELLATION' END AS fault
  FROM cells),
audit AS (
  SELECT source_row_id, source_row, content_hash, invoice_no, stock_code, description, quantity, CAST(stamp AS VARCHAR) AS invoice_time, CAST(stamp AS DATE) AS invoice_date, unit_price, customer_id, country, signed_amount,
    coalesce(strftime(stamp, '%Y-%m'), 'INVALID') AS transaction_month,
    CASE WHEN turn > 1 THEN 'EXCLUDED_DUPLICATE' WHEN fault IS NOT NULL THEN 'QUARANTINED' WHEN cancels THEN 'CANCELLATION' ELSE 'PURCHASE' END AS disposition,
    CASE WHEN turn > 1 THEN 'SUSPECTED_EXACT_DUPLICATE' ELSE fault END AS reason, CASE WHEN turn > 1 THEN head END AS duplicate_of,
    customer_id IS NOT NULL AND fault IS NULL AND turn = 1 AS customer_eligible, CASE WHEN cancels THEN 'UNMATCHED' ELSE 'NOT_APPLICABLE' END AS cancellation_link
  FROM judged),
facts AS (SELECT * FROM audit WHERE disposition IN ('PURCHASE', 'CANCELLATION'))"""
