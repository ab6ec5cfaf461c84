from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.config import StorageSettings, StreamSettings
from tallyspark.operators import snapshots
from tallyspark.plans.folder import Folder
from tallyspark.schema import ENVELOPE
from tallyspark.sources import events as sources
from tallyspark.streaming import clocks, identity, pipeline, windows

START = datetime(2026, 1, 15, 10, tzinfo=timezone.utc)


def line(event, order, user, product, kind, amount, quantity, ms):
    time = (START + timedelta(milliseconds=ms)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    order = f'"{order}"' if order else "null"
    return f'{{"schemaVersion":2,"eventId":"{event}","orderId":{order},"userId":"{user}","productId":"{product}","eventType":"{kind}","amount":{amount},"quantity":{quantity},"eventTime":"{time}"}}'


PAY, FIRST = "PAYMENT_COMPLETED", []
FIRST += [line("a", "o1", "u1", "p1", PAY, "12.30", 1, 0), line("b", "o2", "u2", "p2", PAY, "30.00", 1, 59_999), line("a", "o1", "u1", "p1", PAY, "12.30", 1, 0), line("c", "o3", "u1", "p1", PAY, "7.70", 2, 10_000)]
FIRST += [line("r", "o1", "u1", "p1", "REFUND_COMPLETED", "2.30", 1, 50_000), line("d", "o4", "u3", "p3", PAY, "20.00", 1, 20_000), line("next", "o5", "u1", "p1", PAY, "5.00", 1, 60_000), "not-json", line("advance", None, "u1", "p1", "PRODUCT_CLICK", "0", 1, 152_000)]
LATER = [line("late", "o6", "u4", "p4", PAY, "999.00", 1, 15_000), line("a", "o1", "u1", "p1", PAY, "12.30", 1, 0)]


def put(spark, folder, lines, first=0):
    rows = [("commerce-events", 0, first + n, b"k", x.encode()) for n, x in enumerate(lines)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(folder)


def check(minutes):
    rows = snapshots.newest(minutes).orderBy("window_start").collect()
    assert [(r.paid_orders, r.paid_users, r.paid_quantity, r.gmv, r.refunds, r.refund_amount) for r in rows] == [(4, 3, 5, D("70.00"), 1, D("2.30")), (1, 1, 1, D("5.00"), 0, D("0.00"))]


def test_audited_pipeline(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, FIRST)
    p = pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out", StreamSettings(top_n=2), StorageSettings(dataset="d"))

    def run():
        p.run(lambda: sources.file_stream(spark, source, 1), availableNow=True)

    run()
    put(spark, source, LATER, 9)
    run()
    check(p.minutes())
    assert {(r.event_id, r.stage) for r in p.late_events().collect()} == {("late", "dedup"), ("a", "dedup")} and p.dead_letters().count() == 1
    first = snapshots.newest(p.rankings()).orderBy("window_start").first()
    assert [(x.product_id, x.gmv) for x in first.products] == [("p2", D("30.00")), ("p1", D("20.00"))]
    # a batch that runs again leaves the same
    again = spark.read.parquet(f"{tmp_path}/out/late_events")
    number = again.first().batch
    body = again.select(F.lit("late").alias("kind"), F.to_json(F.struct(F.lit("late").alias("event_id"), F.lit("x").alias("topic"))).alias("body"))
    p.batch(spark.createDataFrame(body.collect(), "kind string, body string"), number)
    check(p.minutes())
    assert p.late_events().count() == 2


def test_restart_in_the_middle_of_a_window(spark, tmp_path):
    """State survives between runs: repeats of an earlier run are dropped, a window closes once, late rows come out once."""
    source = str(tmp_path / "in")
    p = pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out", StreamSettings(top_n=2), StorageSettings(dataset="d"))
    for first, lines in ((0, FIRST[:3]), (3, FIRST[3:8]), (8, [*FIRST[:2], FIRST[8]]), (11, LATER), (13, LATER[:1])):
        put(spark, source, lines, first)
        p.run(lambda: sources.file_stream(spark, source), availableNow=True)
    check(p.minutes())
    assert p.minutes().count() == 2  # each window once, in the batch that closed it
    assert sorted(r.event_id for r in p.late_events().collect()) == ["a", "late", "late"]
    late = p.late_events().where("event_id = 'late'").first()
    assert (late.amount, late.quantity, late.order_id, late.event_time.second) == (D("999.00"), 1, "o6", 15)


def test_a_window_closes_when_the_watermark_reaches_its_end(spark, tmp_path):
    source = str(tmp_path / "in")
    p = pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out", StreamSettings(), StorageSettings(dataset="d"))
    for k, (ms, closed) in enumerate([(1000, 0), (89_999, 0), (90_000, 1)]):  # delay 30 s: 60 s are reached at 90 s
        put(spark, source, [line(f"e{k}", f"o{k}", "u", "p", PAY, "1.00", 1, ms)], k)
        p.run(lambda: sources.file_stream(spark, source), availableNow=True)
        assert p.minutes().count() == closed
    put(spark, source, [line("at", "o9", "u", "p", PAY, "1.00", 1, 59_999), line("in", "o10", "u", "p", PAY, "1.00", 1, 60_000)], 3)
    p.run(lambda: sources.file_stream(spark, source), availableNow=True)
    assert [r.event_id for r in p.late_events().collect()] == ["at"]


def test_native_pipeline(spark, tmp_path):
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    put(spark, source, FIRST)
    sink = pipeline.snapshot_sink(out, StorageSettings(dataset="d"))

    def run():
        totals = pipeline.native_totals(pipeline.parsed(sources.file_stream(spark, source)))
        totals.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()

    run()
    put(spark, source, LATER, 9)
    run()
    check(spark.read.parquet(out))


def test_native_ranking(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, FIRST)
    ranked = pipeline.native_ranking(pipeline.parsed(sources.file_stream(spark, source)), 2)
    ranked.writeStream.format("memory").queryName("ranked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("ranked").orderBy("window_start").collect()
    assert [[p.product_id for p in r.products] for r in rows] == [["p2", "p1"], ["p1"]]
    with pytest.raises(ValueError):
        pipeline.native_ranking(pipeline.parsed(sources.file_stream(spark, source)), 0)


def test_log_sink(spark, tmp_path):
    put(spark, str(tmp_path / "in"), FIRST)
    query = pipeline.log_sink(pipeline.parsed(sources.file_stream(spark, str(tmp_path / "in"))), "log", str(tmp_path / "state"))
    query.awaitTermination()
    assert query.lastProgress["numInputRows"] == len(FIRST)


def test_late_streams_are_one_with_their_stage(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "t")], "event_id string, topic string")
    got = pipeline.late_union(rows, rows.limit(0), rows)
    assert sorted((r.event_id, r.stage) for r in got.collect()) == [("e1", "dedup"), ("e1", "product")]


def test_stored_snapshots_expire_by_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    now = datetime(2026, 3, 1)
    rows = [(1, datetime(2025, 10, 1)), (1, datetime(2025, 11, 1)), (2, datetime(2025, 10, 1)), (2, datetime(2026, 2, 1))]
    spark.createDataFrame(rows, "batch long, received_at timestamp").write.partitionBy("batch").parquet(folder)
    assert snapshots.expire_stored(spark, folder, now, 90) == 1
    assert {r.batch for r in spark.read.parquet(folder).collect()} == {2} and snapshots.expire_stored(spark, folder, now, 90) == 0


def test_supervision_and_checkpoint_guard(spark, tmp_path):
    calls = []

    class Query:
        def awaitTermination(self):
            if len(calls) < 3:
                raise RuntimeError("down")

    pipeline.supervise(lambda: calls.append(1) or Query(), 3, 0)
    assert len(calls) == 3
    place = Folder.of(spark, tmp_path) / "c"
    pipeline.guard_checkpoint(place, "one")
    pipeline.guard_checkpoint(place, "one")
    with pytest.raises(RuntimeError):
        pipeline.guard_checkpoint(place, "two")
    pipeline.guard_checkpoint(place, "two", strict=False)
    pipeline.guard_checkpoint(place, "two")
    (tmp_path / "out" / "guard").mkdir(parents=True)
    (tmp_path / "out" / "guard" / "code-version").write_text("of another time")
    with pytest.raises(RuntimeError):
        pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out").start(spark.readStream.schema(ENVELOPE).parquet(str(tmp_path)), same_code=True)


class OtherBodies(windows.HeldWindow):
    def init(self, handle):
        self.handle = handle
        self.held = handle.getMapState("held", "event_id string", "body string, size long")


class OtherName(windows.HeldWindow):
    def init(self, handle):
        self.handle = handle
        self.held = handle.getMapState("kept", "event_id string", "body string")


def test_an_edit_restarts_and_a_changed_plan_is_refused(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    p = pipeline.AuditedPipeline(spark, f"file://{tmp_path}/out", StreamSettings(top_n=2), StorageSettings(dataset="d"))

    def run():
        p.start(sources.file_stream(spark, source), availableNow=True).awaitTermination()

    put(spark, source, FIRST)
    assert identity.stored(spark, f"{p.folder}/checkpoint") is None
    run()
    monkeypatch.setattr(pipeline, "code_version", lambda: "edited")  # other code with the same operators goes on
    put(spark, source, LATER, 9)
    run()
    check(p.minutes())
    assert p.late_events().count() == 2
    for other, name in ((OtherBodies, "variables"), (OtherName, "kept")):
        with monkeypatch.context() as m, pytest.raises(identity.OtherState, match=f"operator 0 transformWithStateInPandasExec.*{name}"):
            m.setattr(windows, "HeldWindow", other)
            run()
    with monkeypatch.context() as m, pytest.raises(identity.OtherState, match="parts: 7, was 16"):
        m.setattr(windows, "PARTS", 7)
        run()
    real = windows.held_until_closed
    with monkeypatch.context() as m, pytest.raises(identity.OtherState, match="operator 0 dedupe: not in the checkpoint|operator 0 dedupe: was transformWithState"):
        m.setattr(windows, "held_until_closed", lambda *a: real(*a).dropDuplicates(["kind", "body"]))
        run()
    (tmp_path / "out" / "guard" / "operators.json").unlink()  # the state itself still says what it is
    with monkeypatch.context() as m, pytest.raises(identity.OtherState, match="operator 0"):
        m.setattr(windows, "HeldWindow", OtherBodies)
        run()
    run()
    check(p.minutes())


def test_plans_and_states_of_native_chains_agree(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, FIRST)
    for k, make in enumerate((pipeline.native_totals, pipeline.native_ranking)):
        rows = make(pipeline.parsed(sources.file_stream(spark, source)))
        rows.writeStream.format("memory").queryName(f"agree{k}").option("checkpointLocation", f"file://{tmp_path}/{k}").trigger(availableNow=True).start().awaitTermination()
        state, plan = identity.stored(spark, f"file://{tmp_path}/{k}"), identity.planned(rows)
        assert [o["name"] for o in plan] == ["stateStoreSave"] * (3 if k == 0 else 5) + ["dedupe"] and identity.differences(plan, state) == []
    totals = identity.planned(pipeline.native_totals(pipeline.parsed(sources.file_stream(spark, source))))
    found = identity.differences(totals, state)
    assert any("only in the checkpoint" in f for f in found) and any("keys" in f for f in found)
    identity.guard(spark, f"file://{tmp_path}/mark", f"file://{tmp_path}/none", totals)
    identity.guard(spark, f"file://{tmp_path}/mark", f"file://{tmp_path}/none", plan)  # nothing was committed: nothing to fit
    with pytest.raises(identity.OtherState):
        identity.guard(spark, f"file://{tmp_path}/mark", f"file://{tmp_path}/1", totals)
    assert identity.declared(clocks.LeastClock(1, 1)) == {"partitions": ["MapState", ["string", "int"], ["bigint", "bigint"]], "least": ["ValueState", ["bigint"]]}


class Handle:
    """State and timers of one group, and how often they are called."""

    def __init__(self):
        self.list, self.value, self.timers, self.calls = [], None, set(), 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def exists(self):
                return handle.value is not None

            def get(self):
                return handle.value

            def update(self, value):
                handle.calls, handle.value = handle.calls + 1, value

            def clear(self):
                handle.value = None

        return Value()

    def appendValue(self, piece):
        self.calls += 1
        self.list.append(piece)

    def get(self):
        return iter(self.list)

    def put(self, pieces):
        self.list = pieces

    def clear(self):
        self.list = []

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_calls_of_state_grow_with_pieces_and_not_with_events(spark):
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def frame(*rows):
        return pd.DataFrame([(end, i, "t", 0, offset, f"{i}@{offset}") for end, i, offset in rows], columns=["end", "event_id", "topic", "partition", "offset", "body"])

    def out(found, kind):
        return sorted(b for f in found for k, b in zip(f["kind"], f["body"], strict=True) if k == kind)

    handle, held = Handle(), windows.HeldWindow()
    held.init(handle)
    many = [(60_000 * (1 + n % 10), f"e{n}", n) for n in range(1000)]
    assert out(held.handleInputRows((0, 0), iter([frame(*many[:500], (60_000, "a", 7000)), frame(*many[500:], (60_000, "a", 6000), (windows.NO_WINDOW, None, 1))]), At(0)), windows.DEAD) == ["None@1"]
    assert handle.calls <= 6 and handle.timers == {60_000}
    list(held.handleInputRows((0, 0), iter([frame((60_000, "a", 1), (120_000, "late later", 2))]), At(0)))  # a later batch: the first stays
    handle.timers.clear()
    closed = out(held.handleExpiredTimer((0, 0), At(60_000), None), windows.ON_TIME)
    assert len(closed) == 101 and "a@6000" in closed and handle.timers == {120_000}
    assert out(held.handleInputRows((0, 0), iter([frame((60_000, "b", 9))]), At(60_000)), windows.LATE) == ["b@9"]
    assert len(out(held.handleExpiredTimer((0, 0), At(600_000), None), windows.ON_TIME)) == 901 and handle.list == [] and handle.value is None
