"""Spark session settings that the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-machine runs: UTC, ANSI on, AQE on."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyspark")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver found it; a cluster has it there, or by --py-files."""
    paths = [ROOT, *filter(None, (spark.sparkContext.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep))]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    return spark
