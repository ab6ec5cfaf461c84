import json
from decimal import Decimal as D

import pytest

from tallyspark.functions import parse
from tallyspark.schema import ENVELOPE

GOOD = {"schemaVersion": 2, "eventId": "e1", "orderId": "o1", "userId": "u1", "productId": "p1", "eventType": "PAYMENT_COMPLETED", "amount": 12.30, "quantity": 1, "eventTime": "2026-01-15T10:00:00Z"}


def text(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not ...}).encode()


def test_good_event():
    got = parse.parse_event(text())
    assert got[:7] == ("e1", "o1", "u1", "p1", "PAYMENT_COMPLETED", D("12.30"), 1) and got[7].timestamp() == 1768471200
    assert parse.parse_event(text(eventType="PRODUCT_CLICK", orderId=None, amount=0))[1] is None
    assert parse.parse_event(b'{"amount": 1e2,' + text(amount=...)[1:])[5] == D("100.00")


BAD = [
    *[text(**{k: ...}) for k in GOOD], *[text(**{k: None}) for k in GOOD], text(more=1), b"", b"[]", b"null", b"{", text() + b"{}", b'{"eventId": "x", ' + text()[1:], text(schemaVersion=1), text(schemaVersion=True),
    text(quantity=0), text(quantity=1.5), text(quantity="1"), text(quantity=2147483648), text(amount=-1), text(amount="12.30"), text(amount=12.301), text(eventId=" "), text(userId=7), text(eventType="GONE"), text(eventTime="yesterday"),
    text(eventTime="1969-12-31T23:59:59Z"), text(eventTime="2026-02-30T00:00:00Z"), None, b"\xc3\x28", text().replace(b"12.3", b"NaN"), text().replace(b"12.3", b"-1e-999"), text(eventType="PRODUCT_VIEW"), text(orderId=None),
]


@pytest.mark.parametrize("value", BAD)
def test_bad_events(value):
    with pytest.raises((ValueError, ArithmeticError)):
        parse.parse_event(value)


def test_rows_are_never_lost(spark):
    values = [text(), b"not-json", None, b"\xc3\x28", text(amount=-1)]
    rows = spark.createDataFrame([("t", 2, n, b"\x01\x02", v) for n, v in enumerate(values)], ENVELOPE)
    parsed = parse.parse_events(rows)
    assert parse.valid(parsed).count() == 1
    letters = {r.sourceOffset: r for r in parse.dead_letters(parsed).collect()}
    assert sorted(letters) == [1, 2, 3, 4] and letters[3].valueBase64 == "wyg=" and letters[1].keyBase64 == "AQI=" and letters[2].valueBase64 is None
    assert letters[4].reason.startswith("EventError: ")
    assert parse.parse_events(rows.limit(0)).count() == 0


def test_json_roundtrip(spark):
    rows = spark.createDataFrame([("t", 0, 0, b"k", text())], ENVELOPE)
    event = parse.valid(parse.parse_events(rows)).withColumn("arrival", parse.F.col("offset"))
    again = parse.valid(parse.parse_events(parse.event_json(event))).first()
    assert (again.event_id, again.amount, again.event_time) == ("e1", D("12.30"), event.first().event_time)


TRICKY = [
    text(), text(eventId='q"x'), text(eventId="é"), text(eventId="a\\b"), text(eventId=" lead"), text(eventId="tail "), text(userId="\t"), text(userId="a\u0000"), text(quantity=2147483647), text(quantity=999999999), text(quantity=1000000000),
    text(amount=0), text().replace(b"12.3", b"12.30"), text().replace(b"12.3", b"12.300"), text().replace(b"12.3", b"012.3"), text().replace(b"12.3", b"1.23e1"), text().replace(b"12.3", b"9" * 34 + b".99"), text().replace(b"12.3", b"9" * 36),
    text().replace(b"12.3", b"9" * 37), text().replace(b"12.3", b"-0"), text(eventTime="2024-02-29T10:00:00Z"), text(eventTime="2026-02-29T10:00:00Z"), text(eventTime="2026-04-31T10:00:00.5Z"), text(eventTime="9999-12-31T23:59:59.999999Z"),
    text(eventTime="2026-01-15T10:00Z"), text(eventTime="2026-01-15T10:00:00.123456789Z"), text(eventTime="2026-01-15T24:00:00Z"), text(eventTime="2026-01-15T10:00:60Z"), text(eventTime="2026-01-15T10:00:00+00:00"), text(eventTime="1970-01-01T00:00:00Z"),
    text(eventType="PRODUCT_CLICK", orderId=None, amount=0), text(eventType="PRODUCT_CLICK", orderId="null"), text(orderId="null"), text() + b"\n", b" " + text(), text() + b"\x00", text().replace(b"e1", b"e\xff"), text().replace(b'"p1"', b'"p1","more":"x"'),
    text().replace(b'"orderId": "o1"', b'"orderId": "o1","orderId": "o2"'), text(schemaVersion=3), text().replace(b": 2,", b": 2.0,"),
]


def test_both_tiers_say_the_same(spark):
    """What the engine reads is what the parser gives; spaces behind separators keep a value from the engine, so both forms are tried."""
    values = [v for x in [*BAD, *TRICKY] for v in ({x, x.replace(b'": ', b'":').replace(b', "', b',"')} if x else {x})]
    rows = spark.createDataFrame([("t", 0, n, None, v) for n, v in enumerate(values)], ENVELOPE).repartition(2)
    got = {r.offset: r for r in parse.parse_events(rows).collect()}
    assert len(got) == len(values)
    for n, v in enumerate(values):
        try:
            want = (*parse.parse_event(v)[:7], parse.parse_event(v)[7].timestamp(), None)
        except (ValueError, ArithmeticError) as e:
            want = (None,) * 8 + (f"{type(e).__name__}: {e}",)
        r = got[n]
        assert (r.event_id, r.order_id, r.user_id, r.product_id, r.event_type, r.amount, r.quantity, r.event_time.timestamp() if r.event_time else None, r.error) == want, v


def test_plain_values_stay_out_of_python(spark):
    events = [{**GOOD, "eventId": f"e{n}", "amount": n, "quantity": n + 1, "eventTime": f"2026-01-15T10:00:{n % 60:02}.{n:06}Z"} for n in range(500)]
    values = [json.dumps(e, separators=(",", ":")).encode() for e in events] + [b"not-json"]
    rows = spark.createDataFrame([("t", 0, n, None, v) for n, v in enumerate(values)], ENVELOPE)
    assert [r.offset for r in parse.undecided(rows).collect()] == [500] and parse.valid(parse.parse_events(rows)).count() == 500
    event = parse.valid(parse.parse_events(rows)).withColumn("arrival", parse.F.col("offset"))
    assert parse.undecided(parse.event_json(event)).count() == 0
