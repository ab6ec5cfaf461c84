"""Record types of the engine as Spark schemas, and their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 2)
AMOUNT = T.DecimalType(30, 6)
PRICE = T.DecimalType(18, 6)
SCORE = T.DecimalType(13, 12)

# Event types and result codes of the data contract.
VIEW, CLICK, CART, ORDER, PAYMENT, REFUND = EVENT_TYPES = ("PRODUCT_VIEW", "PRODUCT_CLICK", "ADD_TO_CART", "ORDER_CREATED", "PAYMENT_COMPLETED", "REFUND_COMPLETED")
ORDER_TYPES = (ORDER, PAYMENT, REFUND)
PURCHASE, CANCELLATION, QUARANTINED, EXCLUDED_DUPLICATE = "PURCHASE", "CANCELLATION", "QUARANTINED", "EXCLUDED_DUPLICATE"
SINGLE_PURCHASE, AT_RISK, HIGH_VALUE, REPEAT_CUSTOMER = "SINGLE_PURCHASE", "AT_RISK", "HIGH_VALUE", "REPEAT_CUSTOMER"
EVENT_VERSION = 2

#: A parsed commerce event; ``arrival`` is a total order of the source's rows.
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("event_time", T.TimestampType()),
])

#: Rows of an event source, as Kafka's connector gives them.
ENVELOPE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
])

MINUTE_METRICS = T.StructType([
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("paid_orders", T.LongType()),
    T.StructField("paid_users", T.LongType()),
    T.StructField("paid_quantity", T.LongType()),
    T.StructField("gmv", MONEY),
    T.StructField("refunds", T.LongType()),
    T.StructField("refund_amount", MONEY),
])

RANKED_PRODUCT = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("gmv", MONEY),
    T.StructField("paid_orders", T.LongType()),
    T.StructField("paid_users", T.LongType()),
    T.StructField("paid_quantity", T.LongType()),
])

#: Raw transaction rows: all text, as they were in the source.
LEDGER_COLUMNS = ("source_row_id", "source_row", "content_hash", "invoice_no", "stock_code", "description", "quantity", "invoice_time", "unit_price", "customer_id", "country")
LEDGER = T.StructType([T.StructField(c, T.StringType()) for c in LEDGER_COLUMNS])
#: Headers of the workbook's sheet, in order.
SHEET = "Online Retail"
SHEET_HEADERS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
