"""Message stream to a clean events table and a dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cartwise.functions.times import event_timestamp
from cartwise.schema import EVENTS


def _whole_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def _decimal_number(text: Column) -> Column:
    """Number text; the type suffixes Java would accept (``1.5d``) are not numbers."""
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def _parse(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType):
        return _whole_number(text)
    if isinstance(kind, T.DoubleType):
        return _decimal_number(text)
    if isinstance(kind, T.TimestampType):
        return event_timestamp(text)
    return text


def decode(messages: DataFrame, schema: T.StructType = EVENTS) -> DataFrame:
    """Add the event fields and ``reason``, which is null for a good message.

    Fields are trimmed and unknown ones ignored. A missing number reads 0, a missing
    text stays null. A message is bad if it is not a JSON object, if its price is
    null, or if a field's text does not fit the field's type.
    """
    fields = messages.withColumn("_fields", F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    values, reasons = {}, [F.when(F.col("_fields").isNull(), F.lit("not_an_object"))]
    for field in schema:
        text = F.trim(F.col("_fields")[field.name])
        parsed = _parse(text, field.dataType)
        if isinstance(field.dataType, (T.LongType, T.DoubleType)):
            parsed = F.coalesce(parsed, F.when(text.isNull(), F.lit(0).cast(field.dataType)))
        values[field.name] = parsed
        if field.name == "price":
            sent = F.map_contains_key(F.col("_fields"), F.lit("price"))
            reasons.append(F.when(sent & text.isNull(), F.lit("null_price")))
        reasons.append(F.when(text.isNotNull() & parsed.isNull(), F.lit(f"bad_{field.name}")))
    return fields.withColumns(values).withColumn("reason", F.coalesce(*reasons)).drop("_fields")


def good_events(decoded: DataFrame, schema: T.StructType = EVENTS) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).select(*[field.name for field in schema])


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).select("value", "reason")


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append to a Parquet table; the checkpoint makes a restart continue without repeats."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def ingest(
    messages: DataFrame,
    events_path: str,
    dead_path: str,
    checkpoint: str,
    schema: T.StructType = EVENTS,
    available_now: bool = False,
) -> list[StreamingQuery]:
    """Two streams over the messages: good events to one table, the rest to another."""
    decoded = decode(messages, schema)
    return [
        append_stream(good_events(decoded, schema), events_path, f"{checkpoint}/events", available_now),
        append_stream(dead_letters(decoded), dead_path, f"{checkpoint}/dead", available_now),
    ]


def drop_repeats(events: DataFrame, delay: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """Drop rows seen before within the watermark; state older than ``delay`` is forgotten."""
    watched = events.withWatermark("event_time", delay)
    return watched.dropDuplicatesWithinWatermark(keys or events.columns)
