"""Strict parsing of commerce events.

A value must be UTF-8, one JSON object without repeated keys or anything behind it, with exactly the contract's fields
and types.  Nothing is coerced.  Whatever is wrong ends up as text in ``error`` beside the untouched source row; parsing
never fails a job.

There are two tiers.  JSON functions of the SQL engine accept repeated keys, other fields, trailing text and rounded numbers,
so a pattern first asks whether a value has the plain form in which producers write: the fields in order, printable
ASCII without escapes, plain numbers, a UTC time to the microsecond.  Such values are read by the engine.  All others, be
they right or wrong, are parsed row by row in Python, in the same pass over the source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_TYPES, EVENT_VERSION, ORDER_TYPES

FIELDS = ("schemaVersion", "eventId", "orderId", "userId", "productId", "eventType", "amount", "quantity", "eventTime")
#: The latest time of four-digit years, in milliseconds.
LATEST_MS = 253402300799999
_INSTANT = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?Z", re.ASCII)
_CENT, _EXACT = Decimal("0.01"), Context(prec=60)
_COLUMNS = ("event_id", "order_id", "user_id", "product_id", "event_type", "amount", "quantity", "event_time", "error")


class EventError(ValueError):
    """An event breaks the contract."""


def _pairs(items: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(items)
    if len(out) < len(items):
        raise EventError("a field is repeated")
    return out


def _constant(name: str) -> object:
    raise EventError(f"{name} is not a number")


def _text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise EventError(f"{name} must be text and not blank")
    return value


def _whole(value: object, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not -(2**31) <= value < 2**31:
        raise EventError(f"{name} must be a 32-bit whole number")
    return value


def _instant(value: object) -> datetime:
    m = _INSTANT.fullmatch(value) if isinstance(value, str) else None
    if not m:
        raise EventError("eventTime must be an ISO instant")
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        at = datetime(year, month, day, hour, minute, second, int((m[7] or "0").ljust(9, "0")[:6]), timezone.utc)
    except ValueError as e:
        raise EventError(f"eventTime: {e}") from None
    if not 0 <= at.timestamp() * 1000 <= LATEST_MS:
        raise EventError("eventTime is out of range")
    return at


def parse_event(value: bytes | None) -> tuple:
    """The values of ``schema.EVENT``; EventError, or json's and codecs' errors, if ``value`` breaks the contract."""
    if value is None:
        raise EventError("there is no value")
    body = json.loads(value.decode("utf-8", "strict"), object_pairs_hook=_pairs, parse_float=Decimal, parse_constant=_constant)
    if not isinstance(body, dict) or set(body) != set(FIELDS):
        raise EventError("an event is an object with exactly the contract's fields")
    if _whole(body["schemaVersion"], "schemaVersion") != EVENT_VERSION:
        raise EventError(f"schemaVersion must be {EVENT_VERSION}")
    kind = body["eventType"]
    if not isinstance(kind, str) or kind not in EVENT_TYPES:
        raise EventError("eventType is unknown")
    order = body["orderId"]
    if kind in ORDER_TYPES:
        order = _text(order, "orderId")
    elif order is not None:
        raise EventError(f"{kind} has no orderId")
    amount = body["amount"]
    if isinstance(amount, bool) or not isinstance(amount, (int, Decimal)):
        raise EventError("amount must be a number")
    amount = Decimal(amount)
    if amount.is_signed() and not amount.is_zero():
        raise EventError("amount must not be negative")
    cents = amount.as_tuple()
    if amount.adjusted() > 35 or (cents.exponent < -2 and any(cents.digits[cents.exponent + 2 :])):
        raise EventError("amount has at most two decimals and 36 digits before them")
    quantity = _whole(body["quantity"], "quantity")
    if quantity <= 0:
        raise EventError("quantity must be positive")
    return _text(body["eventId"], "eventId"), order, _text(body["userId"], "userId"), _text(body["productId"], "productId"), kind, amount.quantize(_CENT, context=_EXACT), quantity, _instant(body["eventTime"])


_WORD = r'"[!#-\[\]-~][ !#-\[\]-~]*"'


def _plain_form() -> str:
    """A pattern that only values which ``parse_event`` accepts match, but for days that a month hasn't got."""
    numbers = r'"amount":(?:0|[1-9][0-9]{0,33})(?:\.[0-9]{1,2})?,"quantity":[1-9][0-9]{0,8}'
    time = r'"eventTime":"(?:19[7-9][0-9]|[2-8][0-9]{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?Z"'
    kinds = (_WORD, ORDER_TYPES), ("null", [k for k in EVENT_TYPES if k not in ORDER_TYPES])
    middle = "|".join(rf'"orderId":{order},"userId":{_WORD},"productId":{_WORD},"eventType":"(?:{"|".join(of)})"' for order, of in kinds)
    return rf'^\{{"schemaVersion":{EVENT_VERSION},"eventId":{_WORD},(?:{middle}),{numbers},{time}\}}\z'


_PLAIN_FORM = _plain_form()
_FAST = "eventId string, orderId string, userId string, productId string, eventType string, amount decimal(38,2), quantity int, eventTime timestamp"


def plainly_read(value: Column) -> Column:
    """The event of a value in plain form as a struct of ``schema.EVENT``'s types; null, or one without a time, if Python has to decide."""
    text = value.cast("string")
    return F.when(text.rlike(_PLAIN_FORM), F.from_json(text, _FAST))


def undecided(source: DataFrame, value: str = "value") -> DataFrame:
    """The rows that reach the Python parser."""
    return source.where(plainly_read(F.col(value))["eventTime"].isNull())


def parse_events(source: DataFrame, value: str = "value") -> DataFrame:
    """All columns of ``source``, then those of ``schema.EVENT`` (null if invalid) and ``error`` (null if valid)."""
    kept = [c for c in source.columns if c not in _COLUMNS]
    at = kept.index(value)
    types = [pa.string()] * 5 + [pa.decimal128(38, 2), pa.int32(), pa.timestamp("us", "UTC"), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            read = [c.cast(t) for c, t in zip(batch.column(len(kept)).flatten(), types, strict=False)] + [pa.nulls(n, pa.string())]
            left = np.flatnonzero(read[7].is_null().to_numpy(zero_copy_only=False))
            if len(left):
                rows = []
                for v in batch.column(at).take(pa.array(left)).to_pylist():
                    try:
                        rows.append((*parse_event(v), None))
                    except (ValueError, ArithmeticError, RecursionError) as e:
                        rows.append((None,) * 8 + (f"{type(e).__name__}: {e}",))
                order = np.arange(n)
                order[left] = n + np.arange(len(left))
                order = pa.array(order)
                read = [pa.concat_arrays([c, pa.array(more, t)]).take(order) for c, more, t in zip(read, zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *read], names=[*kept, *_COLUMNS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema]
    schema = ", ".join([*fields, "event_id string, order_id string, user_id string, product_id string, event_type string, amount decimal(38,2), quantity int, event_time timestamp, error string"])
    return source.select(*kept, plainly_read(F.col(value)).alias("_read")).mapInArrow(run, schema)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Invalid rows as they came, with the reason; bytes in base64."""
    bad = parsed.where(F.col("error").isNotNull())
    return bad.select(F.col("topic").alias("sourceTopic"), F.col("partition").alias("sourcePartition"), F.col("offset").alias("sourceOffset"), F.base64("key").alias("keyBase64"), F.base64("value").alias("valueBase64"), F.col("error").alias("reason"))


def as_json(rows: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias(name))


def event_json(events: DataFrame) -> DataFrame:
    """Events as the wire's JSON in ``value``, with ``arrival`` as offset."""
    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = F.to_json(
        F.struct(F.lit(EVENT_VERSION).alias("schemaVersion"), F.col("event_id").alias("eventId"), F.col("order_id").alias("orderId"), F.col("user_id").alias("userId"), F.col("product_id").alias("productId"), F.col("event_type").alias("eventType"), "amount", "quantity", time.alias("eventTime")),
        {"ignoreNullFields": "false"},
    )
    return events.select(F.lit("commerce-events").alias("topic"), F.lit(0).alias("partition"), F.col("arrival").cast("long").alias("offset"), F.col("user_id").cast("binary").alias("key"), text.cast("binary").alias("value"))
