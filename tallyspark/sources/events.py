"""Event sources and sinks: Kafka, and files with the same columns.

All sources give ``schema.ENVELOPE``.  Progress is kept in the streaming checkpoint, so a restarted query goes on where
it stopped; a new one starts with the earliest rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENVELOPE

_COLUMNS = [f.name for f in ENVELOPE]


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A Kafka topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.options(**options).load().select(*_COLUMNS)


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder that receives Parquet files of envelope rows."""
    reader = spark.readStream.schema(ENVELOPE)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def file_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).parquet(path)


def json_lines(spark: SparkSession, path: str, topic: str = "commerce-events") -> DataFrame:
    """A file of JSON lines as envelope rows; the offset of a line is its place among the rows as read.

    Reading a line as text keeps its bytes; nothing is parsed here.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("offset"))
    return lines.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), "offset", F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def write_kafka(rows: DataFrame, servers: str, topic: str) -> None:
    """Key and value to a topic, at least once, acknowledged by all replicas."""
    rows.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()
