"""A deterministic sequence of commerce events with repeats, late events and plausible orders.

Types are drawn by weight.  A payment takes the oldest order that isn't paid, a refund the oldest payment that isn't
refunded, with the order's user, product, amount and quantity, and no earlier time; without one it becomes an order.
The sequence is made of blocks that are drawn apart, so executors draw it side by side and a stream goes on anywhere.
"""

from __future__ import annotations

import json
import random
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..config import GenerationSettings
from ..schema import CART, CLICK, ENVELOPE, EVENT_VERSION, ORDER, PAYMENT, REFUND, VIEW

#: Per cent of each type.
WEIGHTS = {VIEW: 40, CLICK: 25, CART: 15, ORDER: 10, PAYMENT: 8, REFUND: 2}
USERS, PRODUCTS, WAITING, LATEST_MS = 100, 50, 1000, 30_000
TOPIC = "commerce-events"
#: Events that are drawn together; another block can be drawn without them.
BLOCK = 10_000


@dataclass(frozen=True)
class Event:
    event_id: str
    order_id: str | None
    user_id: str
    product_id: str
    event_type: str
    amount: Decimal
    quantity: int
    event_time: datetime

    def to_json(self) -> str:
        time = self.event_time.isoformat(timespec="milliseconds").replace("+00:00", "Z")
        head = {"schemaVersion": EVENT_VERSION, "eventId": self.event_id, "orderId": self.order_id, "userId": self.user_id, "productId": self.product_id, "eventType": self.event_type}
        # the amount keeps its two decimals, which a float wouldn't
        return json.dumps(head)[:-1] + f', "amount": {self.amount}, "quantity": {self.quantity}, "eventTime": "{time}"}}'


@dataclass(frozen=True)
class Generated:
    event: Event
    duplicate: bool
    late: bool


def blocks(settings: GenerationSettings) -> int:
    return -(-settings.count // BLOCK)


def generate_block(settings: GenerationSettings, block: int) -> Iterator[Generated]:
    """Events ``block * BLOCK`` and on, up to the block's end: a block draws for itself, and its orders are paid and refunded within it."""
    draw = random.Random(settings.seed if not block else f"{settings.seed}/{block}")
    unpaid: deque[Event] = deque(maxlen=WAITING)
    refundable: deque[Event] = deque(maxlen=WAITING)
    kinds, weights = list(WEIGHTS), list(WEIGHTS.values())
    first = block * BLOCK
    last, newest = None, settings.start_time + timedelta(seconds=first)
    for n in range(first, min(first + BLOCK, settings.count)):
        if last is not None and draw.random() < settings.duplicate_rate:
            yield Generated(last, True, False)
            continue
        late = last is not None and draw.random() < settings.out_of_order_rate
        time = newest - timedelta(milliseconds=draw.randint(1, LATEST_MS)) if late else settings.start_time + timedelta(seconds=n)
        kind = draw.choices(kinds, weights)[0]
        before = None
        if kind in (PAYMENT, REFUND):
            queue = unpaid if kind == PAYMENT else refundable
            before = queue.popleft() if queue else None
            kind = kind if before else ORDER
        if before:
            time = max(time, before.event_time)
            event = replace(before, event_id=f"event-{n}", event_type=kind, event_time=time)
        else:
            quantity = draw.randint(1, 3)
            amount = Decimal("0.00") if kind in (VIEW, CLICK) else Decimal(draw.randint(100, 50_000) * quantity) / 100
            event = Event(f"event-{n}", f"order-{n}" if kind == ORDER else None, f"user-{draw.randrange(USERS)}", f"product-{draw.randrange(PRODUCTS)}", kind, amount.quantize(Decimal("0.01")), quantity, time)
        late = time < newest
        newest = max(newest, time)
        if kind == ORDER:
            unpaid.append(event)
        elif kind == PAYMENT:
            refundable.append(event)
        last = event
        yield Generated(event, False, late)


def generate(settings: GenerationSettings) -> Iterator[Generated]:
    for block in range(blocks(settings)):
        yield from generate_block(settings, block)


def _envelope(offset: int, g: Generated) -> tuple:
    return TOPIC, 0, offset, g.event.user_id.encode(), g.event.to_json().encode()


def envelopes(settings: GenerationSettings, first: int = 0) -> Iterator[tuple]:
    """Envelope rows from offset ``first`` on; at most a block before it is drawn again."""
    for block in range(first // BLOCK, blocks(settings)):
        for offset, g in enumerate(generate_block(settings, block), block * BLOCK):
            if offset >= first:
                yield _envelope(offset, g)


def generated(spark: SparkSession, settings: GenerationSettings) -> DataFrame:
    """The sequence as envelope rows plus duplicate and out_of_order, for ``metrics.event_counters``; executors draw it block by block."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ENVELOPE), "duplicate boolean, out_of_order boolean"])
    names = [*ENVELOPE.names, "duplicate", "out_of_order"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"].tolist():
                yield pd.DataFrame([(*_envelope(n, g), g.duplicate, g.late) for n, g in enumerate(generate_block(settings, block), block * BLOCK)], columns=names)

    return spark.range(blocks(settings)).mapInPandas(draw, schema)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, settings: GenerationSettings, per_batch: int):
        self.settings, self.per_batch = settings, per_batch

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def _between(self, first: int, last: int) -> Iterator[tuple]:
        return iter(list(envelopes(replace(self.settings, count=last), first)))  # a batch's rows; they are sent to the workers

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = min(start["offset"] + self.per_batch, self.settings.count)
        return self._between(start["offset"], last), {"offset": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(start["offset"], end["offset"])

    def commit(self, end: dict) -> None:
        pass


class GeneratorSource(DataSource):
    """``spark.dataSource.register(GeneratorSource)``, then ``readStream.format("commerce-generator")``; options count, seed, per_batch."""

    @classmethod
    def name(cls) -> str:
        return "commerce-generator"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENVELOPE)

    def simpleStreamReader(self, schema) -> _Reader:
        settings = GenerationSettings(count=int(self.options.get("count", "100")), seed=int(self.options.get("seed", "42")))
        return _Reader(settings, int(self.options.get("per_batch", "50")))
