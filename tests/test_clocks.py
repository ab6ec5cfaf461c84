import time

from pyspark.sql import functions as F

from tallyspark.config import StreamSettings
from tallyspark.schema import ENVELOPE
from tallyspark.sources import events as sources
from tallyspark.streaming import clocks, pipeline, windows

from test_streaming import PAY, line

BAD = "not-json"


def put(spark, folder, rows, first):
    """Rows of (partition, value), from offset ``first`` on."""
    rows = [("commerce-events", partition, first + n, b"k", value.encode()) for n, (partition, value) in enumerate(rows)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(folder)


def paid(name, ms):
    return line(name, f"o-{name}", "u", "p", PAY, "1.00", 1, ms)


def clock_of(spark, folder):
    """Milliseconds after the tests' start."""
    base = F.unix_millis(F.lit("2026-01-15 10:00:00+00:00").cast("timestamp"))
    row = spark.read.parquet(f"{folder}/rows").agg(F.max(F.unix_millis(clocks.CLOCK)) - base).first()
    return row[0]


def until(true, seconds=60):
    end = time.time() + seconds
    while True:
        try:
            if true():
                return
        except Exception:  # the first files aren't there yet
            pass
        assert time.time() < end
        time.sleep(0.5)


def step(spark, tmp_path, rows, first, expected=(), idle_ms=3_600_000):
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/aligned"
    put(spark, source, rows, first)
    clocks.align(sources.file_stream(spark, source), out, 1000, idle_ms, expected, availableNow=True).awaitTermination()
    return clock_of(spark, out)


def test_the_clock_is_the_least_over_partitions(spark, tmp_path):
    windows.prepare_store(spark)
    assert step(spark, tmp_path, [(0, paid("a", 10_000)), (1, paid("b", 40_000))], 0) == 9_000
    assert step(spark, tmp_path, [(0, paid("c", 30_000)), (1, BAD)], 2) == 29_000
    assert step(spark, tmp_path, [(0, paid("d", 90_000))], 4) == 39_000  # the other one holds it back
    assert step(spark, tmp_path, [(1, paid("e", 20_000))], 5) == 39_000  # an earlier event moves nothing
    rows = spark.read.parquet(f"{tmp_path}/aligned/rows").where("clock is null")
    assert sorted(r.offset for r in rows.collect()) == list(range(6))  # each row comes over once


def test_an_idle_partition_stops_holding_the_clock_and_bad_rows_dont_keep_it_awake(spark, tmp_path):
    windows.prepare_store(spark)
    both = [("commerce-events", 0), ("commerce-events", 1)]
    assert step(spark, tmp_path, [(0, paid("a", 10_000))], 0, both, 3000) is None  # nothing known of the other one yet
    time.sleep(3.2)
    assert step(spark, tmp_path, [(0, paid("b", 30_000)), (1, BAD)], 1, both, 3000) == 29_000
    assert step(spark, tmp_path, [(0, paid("c", 60_000)), (1, paid("d", 50_000))], 3, both, 3000) == 49_000


def test_a_timer_moves_the_clock_without_new_rows(spark, tmp_path):
    windows.prepare_store(spark)
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/aligned"
    put(spark, source, [(0, paid("a", 10_000)), (1, paid("b", 5_000))], 0)
    query = clocks.align(sources.file_stream(spark, source), out, 1000, 20_000, processingTime="500 milliseconds")
    try:
        until(lambda: clock_of(spark, out) == 4_000)
        put(spark, source, [(0, paid("c", 12_000))], 2)
        until(lambda: spark.read.parquet(f"{out}/rows").where("offset = 2").count() == 1)
        assert clock_of(spark, out) == 4_000  # partition 1 is awake when the last row comes; then only timers run
        until(lambda: clock_of(spark, out) == 11_000)
    finally:
        query.stop()


def test_windows_wait_for_the_partition_that_lags(spark, tmp_path):
    source = str(tmp_path / "in")
    p = pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out", StreamSettings(out_of_order_ms=0, idle_timeout_ms=3_600_000))
    batches = [
        [(0, paid("a", 10_000)), (1, paid("b", 20_000)), (0, paid("c", 200_000))],  # Spark's own watermark would close the first minute
        [(1, paid("d", 30_000)), (1, paid("e", 150_000))],  # so d isn't late; then the least clock passes two minutes
        [(1, paid("f", 40_000)), (0, BAD)],  # late now
    ]
    closed = []
    for n, rows in enumerate(batches):
        put(spark, source, rows, 10 * n)
        p.align(sources.file_stream(spark, source), availableNow=True).awaitTermination()
        p.run(p.aligned, availableNow=True)
        closed.append(p.minutes().count())
    assert closed == [0, 1, 1]
    assert p.minutes().first().paid_orders == 3
    assert [r.event_id for r in p.late_events().collect()] == ["f"] and p.dead_letters().count() == 1
