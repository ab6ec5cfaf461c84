"""Queries of the catalogue that go through a stored form: landings, JSON lines, releases, batches and streams.

Each writes under the shared folder and reads what it wrote, so its SQL tests the whole way.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ProfileBatch, ScoreBatch, StorageSettings, StreamSettings
from ..functions import parse
from ..operators import ledger, metrics, ranking, snapshots
from ..sources import events as sources
from ..sources import workbook
from ..staging import brief_shuffles, shared_dir
from ..streaming import pipeline
from . import adapters, publication
from .adapters import EVENTS_SQL, LEDGER_SQL
from .queries import _DIMS, _MINUTES, _PROFILES, _REPEATS_SQL, _SCORED, DATASET, OBSERVATION, _facts, _minutes, _profiles, _samples, _totals_sql, query
from .serving import PROFILE_COLUMNS, CustomerService


@query("csv_landing", f"{LEDGER_SQL} SELECT source_row_id, source_row, content_hash, invoice_no, stock_code, nullif(description, '') AS description, quantity, invoice_time, unit_price, customer_id, country FROM raw")
def csv_landing(spark, sf_dir):
    """Raw rows written as a CSV landing and read again, strictly; CSV has one form for null and empty."""
    path = shared_dir(spark)
    workbook.write_landing(adapters.ledger_rows(spark, sf_dir), path)
    return workbook.read_landing(spark, path).withColumn("description", F.nullif("description", F.lit("")))


@query("json_lines", f"{EVENTS_SQL} SELECT event_id, order_id, user_id, product_id, event_type, amount, quantity, event_time FROM e")
def json_lines(spark, sf_dir):
    """Events written as JSON lines, read as envelopes, strictly parsed."""
    path = shared_dir(spark)
    parse.event_json(adapters.commerce_events(spark, sf_dir)).select(F.col("value").cast("string").alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.col("value").cast("binary").alias("value"), F.lit("commerce-events").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(None).cast("binary").alias("key"))
    found = parse.valid(parse.parse_events(rows.select("topic", "partition", "offset", "key", "value")))
    return found.select("event_id", "order_id", "user_id", "product_id", "event_type", "amount", "quantity", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


def _release(spark, sf_dir: str) -> tuple[str, str]:
    root = shared_dir(spark)
    landing = f"{root}/landing"
    rows, parts = adapters.ledger_rows(spark, sf_dir, "l_orderkey"), adapters.line_parts(spark, sf_dir)
    # rows are dealt out by order once, for the landing and for the release
    with brief_shuffles(spark), workbook.dealt_landing(rows, landing, "l_orderkey", parts) as raw:
        return root, publication.build_release(raw, root, "synthetic", dealt_by=("l_orderkey",))


@query("release_facts", f"{LEDGER_SQL} SELECT * FROM facts")
def release_facts(spark, sf_dir):
    """The facts of a release: classified, reconciled, written by month, digested and moved into place."""
    return publication.release_table(spark, *_release(spark, sf_dir), "facts")


@query("release_products", f"{_DIMS} SELECT * FROM dim_p")
def release_products(spark, sf_dir):
    root, release = _release(spark, sf_dir)
    names = publication.register_release(spark, root, release, f"r{release[:12]}")
    return spark.table(names[3])


@query("ledger_reconciliation", f"{_DIMS} SELECT (SELECT count(*) FROM audit) AS row_count, (SELECT CAST(sum(signed_amount) AS DECIMAL(38,6)) FROM audit) AS amount, (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM facts JOIN dim_c ON facts.customer_id = dim_c.customer_id) AS customer_matches")
def ledger_reconciliation(spark, sf_dir):
    raw = adapters.ledger_rows(spark, sf_dir)
    root, release = _release(spark, sf_dir)
    tables = [publication.release_table(spark, root, release, name) for name in ("audit", "facts", "products", "customers")]
    with brief_shuffles(spark):
        found = ledger.reconcile(raw, *tables)
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("row_count"), F.lit(found["amount"]).cast("decimal(38,6)").alias("amount"), F.lit(found["facts"]).cast("long").alias("facts"), F.lit(found["customer_matches"]).cast("long").alias("customer_matches"))


def _service(spark, sf_dir: str, scores: bool = False) -> CustomerService:
    """A service with the profiles of the observation date published, and scores of one over the orders."""
    service = CustomerService(spark, shared_dir(spark))
    service.publish_profiles(ProfileBatch("p1", DATASET, "r1", "v1", OBSERVATION), _profiles(spark, sf_dir))
    if scores:
        stored = service.profiles.rows(DATASET, "p1")
        service.publish_scores(DATASET, ScoreBatch("b1", "p1", "m1", "rule", 60), stored.select("customer_id", (F.lit(1.0) / F.col("orders")).alias("score")))
    return service


@query("published_profiles", f"{_PROFILES} SELECT {', '.join(PROFILE_COLUMNS)} FROM prof")
def published_profiles(spark, sf_dir):
    """The current batch of a store: checked, written, read back, compared and made the head."""
    return _service(spark, sf_dir).profiles.rows(DATASET)


@query("served_page", f"{_PROFILES} SELECT {', '.join(PROFILE_COLUMNS)}, 'p1' AS batch, (SELECT count(*) > 25 FROM prof) AS has_more FROM prof ORDER BY customer_id LIMIT 25")
def served_page(spark, sf_dir):
    return _service(spark, sf_dir).page(DATASET, limit=25)


@query("served_segments", f"{_PROFILES} SELECT segment, count(*) AS customers, CAST(sum(purchase_amount) AS DECIMAL(38,6)) AS purchase_amount, CAST(sum(cancellation_amount) AS DECIMAL(38,6)) AS cancellation_amount, CAST(sum(orders) AS BIGINT) AS orders FROM prof GROUP BY 1")
def served_segments(spark, sf_dir):
    return _service(spark, sf_dir).segments(DATASET)


@query("published_scores", f"{_PROFILES} SELECT customer_id, CAST(1.0 / orders AS DECIMAL(13,12)) AS score, 'p1' AS profile_batch, 'm1' AS model_id, CAST(60 AS INTEGER) AS horizon_days FROM prof")
def published_scores(spark, sf_dir):
    """Scores that cover a profile batch exactly, from 0 to 1."""
    return _service(spark, sf_dir, scores=True).scores.rows(DATASET)


@query("recency_pr_auc", f"""{_SCORED}, steps AS (SELECT score, sum(label) AS hits, count(*) AS n FROM sc GROUP BY score),
curve AS (SELECT score, sum(hits) OVER w / (SELECT sum(label) FROM sc) AS recall, sum(hits) OVER w / sum(n) OVER w AS precision FROM steps WINDOW w AS (ORDER BY score DESC)),
pairs AS (SELECT recall, precision, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, precision) AS p0 FROM curve WINDOW w AS (ORDER BY score DESC))
SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS pr_auc FROM pairs""")  # fmt: skip
def recency_pr_auc(spark, sf_dir):
    value = ranking.pr_auc(ranking.recency_baseline(_samples(spark, sf_dir)))
    return spark.range(1).select(F.round(F.lit(value), 9).alias("pr_auc"))


@query("snapshot_retention", f"{_MINUTES} SELECT dataset, result_version, window_start FROM current WHERE window_end >= TIMESTAMP '2024-01-10'")
def snapshot_retention(spark, sf_dir):
    """Snapshots received when their window ended, less those older than ten days on 20 January 2024."""
    rows = snapshots.newest(_minutes(spark, sf_dir)).withColumn("received_at", F.col("window_end"))
    return snapshots.expire(rows, datetime(2024, 1, 20), 10).select("dataset", "result_version", "window_start")


def _envelopes(spark, sf_dir: str, repeats: bool = False) -> str:
    """A folder of envelope rows, as a stream's source."""
    rows = adapters.commerce_events(spark, sf_dir)
    path = shared_dir(spark)
    parse.event_json(adapters.with_repeats(rows) if repeats else rows).write.parquet(path)
    return path


_CLOSED = "window_end <= (SELECT max(event_time) - INTERVAL 30 second FROM e)"


@query("stream_hour_totals", f"{EVENTS_SQL}, {_totals_sql('hour')} SELECT window_start, window_end, paid_orders, paid_users, paid_quantity, gmv, refunds, refund_amount FROM totals WHERE {_CLOSED}")
def stream_hour_totals(spark, sf_dir):
    """Chained stateful aggregations over a stream of envelopes, up to what the watermark has closed."""
    out = shared_dir(spark)
    totals = pipeline.native_totals(pipeline.parsed(sources.file_stream(spark, _envelopes(spark, sf_dir))), width="1 hour")
    totals.writeStream.option("checkpointLocation", f"{out}/state").foreachBatch(pipeline.snapshot_sink(f"{out}/rows", StorageSettings(dataset=DATASET))).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return _without_zone(snapshots.newest(rows)).select("window_start", "window_end", "paid_orders", "paid_users", "paid_quantity", "gmv", "refunds", "refund_amount")


def _without_zone(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_audited_minutes", f"{_REPEATS_SQL}, {_totals_sql('minute')} SELECT window_start, window_end, paid_orders, paid_users, paid_quantity, gmv, refunds, refund_amount FROM totals WHERE {_CLOSED}")
def stream_audited_minutes(spark, sf_dir):
    """The audited pipeline over a stream in which events repeat: its minutes are those of the events without repeats."""
    p = pipeline.AuditedPipeline(spark, shared_dir(spark), StreamSettings(), StorageSettings(dataset=DATASET))
    source = _envelopes(spark, sf_dir, repeats=True)
    p.run(lambda: sources.file_stream(spark, source), availableNow=True)
    return _without_zone(snapshots.newest(p.minutes())).select("window_start", "window_end", "paid_orders", "paid_users", "paid_quantity", "gmv", "refunds", "refund_amount")


_LATER = "arrival % 7 = 0"


@query("stream_late_events", f"""{EVENTS_SQL}, mark AS (SELECT max(event_time) - INTERVAL 30 second AS m FROM e WHERE NOT ({_LATER})),
closed AS (SELECT *, date_trunc('minute', event_time) + INTERVAL 1 minute <= m AS closed FROM e, mark),
own AS (SELECT * FROM closed WHERE NOT ({_LATER}) OR NOT closed)
SELECT event_id, 'dedup' AS stage, CAST(NULL AS BIGINT) AS paid_orders FROM closed WHERE {_LATER} AND closed
UNION ALL SELECT CAST(date_trunc('minute', event_time) AS VARCHAR), 'minute', count(DISTINCT order_id) FILTER (WHERE event_type = 'PAYMENT_COMPLETED') FROM own
WHERE event_type IN ('PAYMENT_COMPLETED', 'REFUND_COMPLETED') AND date_trunc('minute', event_time) + INTERVAL 1 minute <= (SELECT max(event_time) - INTERVAL 30 second FROM e) GROUP BY date_trunc('minute', event_time)""")  # fmt: skip
def stream_late_events(spark, sf_dir):
    """A stream whose every seventh event comes in a second run: late events by the watermark of the first, and the minutes without them."""
    source, rows = shared_dir(spark), adapters.commerce_events(spark, sf_dir)
    p = pipeline.AuditedPipeline(spark, shared_dir(spark), StreamSettings(), StorageSettings(dataset=DATASET))
    for part in (rows.where(f"NOT ({_LATER})"), rows.where(_LATER)):
        parse.event_json(part).write.mode("append").parquet(source)
        p.run(lambda: sources.file_stream(spark, source), availableNow=True)
    late = p.late_events().select("event_id", "stage", F.lit(None).cast("long").alias("paid_orders"))
    minutes = _without_zone(snapshots.newest(p.minutes()))
    return late.unionByName(minutes.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("event_id"), F.lit("minute").alias("stage"), "paid_orders"))


@query("event_counters", f"{EVENTS_SQL} SELECT count(*) + count(*) FILTER (WHERE arrival % 20 = 0) AS sent, count(*) FILTER (WHERE arrival % 20 = 0) AS duplicates, count(*) FILTER (WHERE arrival % 20 = 0) AS out_of_order FROM e")
def event_counters(spark, sf_dir):
    rows = adapters.with_repeats(adapters.commerce_events(spark, sf_dir))
    again = F.col("arrival") >= 10**12
    return metrics.event_counters(rows.withColumn("duplicate", again).withColumn("out_of_order", again))
