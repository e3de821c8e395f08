"""Events as JSON messages, on Kafka or in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def to_messages(events: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Each row as one JSON object in ``value``; null fields are left out unless kept."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    return events.select(F.to_json(F.struct(*events.columns), options).alias("value"))


def read_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting: str = "earliest",
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Message stream of a topic with text ``value``. Needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Send each row as a JSON message."""
    to_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def read_message_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Message stream from text files, one message per line."""
    reader = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())]))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)
