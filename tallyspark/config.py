"""Validated settings.  Each value comes from the arguments, else the environment, else the default."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import date, datetime, timedelta, timezone


def _need(holds: bool, text: str) -> None:
    if not holds:
        raise ValueError(text)


class _Settings:
    @classmethod
    def load(cls, args: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None):
        """From ``--name value`` pairs and variables NAME_OF_SETTING, both by field name."""
        args, env, found = args or {}, os.environ if env is None else env, {}
        for f in fields(cls):
            raw = args.get(f.name.replace("_", "-"), env.get(f.name.upper()))
            if raw is not None:
                kind = str(f.type)
                found[f.name] = int(raw) if kind == "int" else float(raw) if kind == "float" else raw
        return cls(**found)


@dataclass(frozen=True)
class StreamSettings(_Settings):
    input_topic: str = "commerce-events"
    dead_letter_topic: str = "commerce-events-dead-letter"
    parallelism: int = 1
    out_of_order_ms: int = 30_000
    idle_timeout_ms: int = 10_000
    top_n: int = 10
    checkpoint_interval_ms: int = 10_000
    checkpoint_directory: str = "file:///tmp/tallyspark/checkpoints"

    def __post_init__(self):
        _need(bool(self.input_topic.strip()) and bool(self.dead_letter_topic.strip()), "topics must not be blank")
        _need(self.input_topic != self.dead_letter_topic, "input and dead-letter topics must differ")
        _need(1 <= self.parallelism <= 128, "parallelism must be 1 to 128")
        _need(0 <= self.out_of_order_ms <= 7 * 86_400_000, "out-of-order-ms must be 0 to 7 days")
        _need(self.idle_timeout_ms > 0, "idle-timeout-ms must be positive")
        _need(1 <= self.top_n <= 1000, "top-n must be 1 to 1000")
        _need(self.checkpoint_interval_ms >= 1000, "checkpoint-interval-ms must be at least 1000")
        _need(":" in self.checkpoint_directory, "checkpoint-directory must be an absolute URI")


@dataclass(frozen=True)
class StorageSettings(_Settings):
    url: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    dataset: str = "retail"
    result_version: int = 1
    batch_size: int = 500
    flush_ms: int = 1000
    retries: int = 3

    def __post_init__(self):
        _need(1 <= len(self.dataset) <= 128, "dataset must have 1 to 128 characters")
        _need(self.result_version > 0, "result-version must be positive")
        _need(1 <= self.batch_size <= 10_000, "batch-size must be 1 to 10000")
        _need(self.flush_ms > 0, "flush-ms must be positive")
        _need(0 <= self.retries <= 10, "retries must be 0 to 10")


@dataclass(frozen=True)
class GenerationSettings(_Settings):
    count: int = 100
    interval_ms: int = 100
    seed: int = 42
    duplicate_rate: float = 0.05
    out_of_order_rate: float = 0.10
    start_time: datetime = datetime(2026, 1, 15, 10, tzinfo=timezone.utc)

    def __post_init__(self):
        _need(self.count >= 0 and self.interval_ms >= 0, "count and interval-ms must not be negative")
        for rate in (self.duplicate_rate, self.out_of_order_rate):
            _need(math.isfinite(rate) and 0 <= rate <= 1, "rates must be 0 to 1")


@dataclass(frozen=True)
class ExperimentPlan:
    """Observation dates of the three groups, the feature window and the label horizon in days."""

    training: tuple[date, ...]
    validation: tuple[date, ...]
    test: tuple[date, ...]
    history_days: int = 180
    horizon_days: int = 30
    seed: int = 42
    contact_fraction: float = 0.2

    def __post_init__(self):
        _need(bool(self.training and self.validation and self.test), "each group needs an observation date")
        _need(1 <= self.history_days <= 366, "history-days must be 1 to 366")
        _need(self.horizon_days >= 1, "horizon-days must be positive")
        _need(0 < self.contact_fraction <= 1, "contact-fraction must be above 0, at most 1")
        dates = self.dates()
        _need(all(b - a >= timedelta(days=self.horizon_days) for a, b in zip(dates, dates[1:], strict=False)), "observation dates must follow each other by the horizon at least")

    def dates(self) -> list[date]:
        return [*self.training, *self.validation, *self.test]

    def available(self, observation: date, start: date, end: date) -> bool:
        """Whether data from ``start`` to before ``end`` cover an observation's history and label."""
        return observation - timedelta(days=self.history_days) >= start and observation + timedelta(days=self.horizon_days) <= end


@dataclass(frozen=True)
class ProfileBatch:
    id: str
    dataset: str
    source_release: str
    rule_version: str
    observation: date
    window_days: int = 180

    def __post_init__(self):
        for name in ("id", "dataset", "source_release", "rule_version"):
            value = getattr(self, name)
            _need(bool(value.strip()) and len(value) <= (128 if name == "dataset" else 64), f"{name} must have 1 to 64 characters")
        _need(1 <= self.window_days <= 366, "window-days must be 1 to 366")


@dataclass(frozen=True)
class ScoreBatch:
    id: str
    profile_batch_id: str
    model_id: str
    algorithm: str
    horizon_days: int

    def __post_init__(self):
        _need(all(v.strip() and len(v) <= 64 for v in (self.id, self.profile_batch_id, self.model_id, self.algorithm)), "names must have 1 to 64 characters")
        _need(self.horizon_days >= 1, "horizon-days must be positive")
