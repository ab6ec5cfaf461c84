"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; on one machine without that setting, under its temporary folder, with a warning."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables go to {base}", stacklevel=2)
    return f"{base.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there: for frames that several branches of a plan need."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it is over, not when the driver's JVM next collects what held them."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
