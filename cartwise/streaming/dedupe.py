"""Stream de-duplication that keeps late rows instead of losing them.

Spark drops rows older than the watermark before a stateful operator sees them. Here the
state is the output itself: a table partitioned by day. Each trigger compares its rows with
the days that the watermark still covers, and writes what is new; rows behind the watermark
go to a table of their own with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cartwise.operators.ranking import first_by_priority
from cartwise.sources.tables import folders

DAY, BATCH = "event_day", "batch_id"
LATE = "late"


def _before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType | None = None) -> DataFrame | None:
    """What earlier triggers wrote; a trigger that is run again does not see its own first try."""
    parts = [p for n, p in _triggers(spark, path) if n < batch_id]
    if not parts:
        return None
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*parts)


def _triggers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    return [(int(p.rsplit("=", 1)[1]), p) for p in folders(spark, f"{path}/{BATCH}=*")]


def dedupe_batch(batch: DataFrame, batch_id: int, path: str, delay: str, keys: list[str]) -> None:
    """One trigger: new rows to ``<path>/events``, late ones to ``<path>/late``, the newest time to ``<path>/marks``.

    Every folder is named by the trigger and overwritten when it is run again.
    """
    spark = batch.sparkSession
    columns = batch.columns
    marks = _before(spark, f"{path}/marks", batch_id)
    newest = None if marks is None else marks.agg(F.max("newest")).first()[0]
    batch = batch.persist()
    try:
        mark = batch.agg(F.max(F.unix_micros("event_time")).alias("newest"))
        mark = mark.select(F.greatest("newest", F.lit(newest).cast("long")).alias("newest"))
        watermark = F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("event_time") < watermark, F.lit(False))
        reason = batch.where(late).withColumn("reason", F.lit(LATE))
        reason.write.mode("overwrite").parquet(f"{path}/late/{BATCH}={batch_id}")

        timed = batch.where(~late)
        first = timed.dropDuplicates() if sorted(keys) == sorted(columns) else first_by_priority(timed, keys, "event_time")
        first = first.withColumn(DAY, F.col("event_time").cast("date"))
        schema = T.StructType([*first.schema, T.StructField(BATCH, T.LongType())])
        seen = _before(spark, f"{path}/events", batch_id, schema)
        if seen is not None:
            # A row on time can only repeat one that the watermark still covers, or one without time.
            covered = F.col(DAY).isNull() | F.coalesce(F.col(DAY) >= watermark.cast("date"), F.lit(True))
            known = seen.where(covered).select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            first = first.join(known, same, "left_anti")
        first.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/events/{BATCH}={batch_id}")
        # Last: a trigger that failed before has no mark.
        mark.write.mode("overwrite").parquet(f"{path}/marks/{BATCH}={batch_id}")
    finally:
        batch.unpersist()


def dedupe_stream(
    events: DataFrame, path: str, checkpoint: str, delay: str = "1 day", keys: list[str] | None = None, available_now: bool = False
) -> StreamingQuery:
    """First row of each key below ``path``, late rows apart.

    A row is late if it is older than the newest time of all earlier triggers less ``delay``; late
    rows are kept whether or not they repeat something. Of rows with equal ``keys`` (default:
    all columns) in one trigger the earliest stays. Rows without a time are never late.
    """
    keys = keys or events.columns
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: dedupe_batch(batch, batch_id, path, delay, keys)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_deduped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The unique events."""
    return spark.read.schema(schema).parquet(f"{path}/events").select(*schema.names)


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The late events, with ``reason``."""
    with_reason = T.StructType([*schema, T.StructField("reason", T.StringType())])
    return spark.read.schema(with_reason).parquet(f"{path}/late").select(*with_reason.names)
