"""Popularity kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartwise.functions.scoring import interest_weight
from cartwise.sources.tables import delete_folder, folders

#: Folders that the table of running scores is dealt into.
BUCKETS = 16
_PART, _VERSION = "part", "version"


def running_scores(events: DataFrame) -> DataFrame:
    """Summed weights per product so far; the state is one number per product."""
    usable = events.where(F.col("product_id").isNotNull() & F.col("event_type").isNotNull())
    weight = F.coalesce(interest_weight(F.col("event_type")), F.lit(0).cast("long"))
    return usable.groupBy("product_id").agg(F.sum(weight).alias("score"))


def daily_scores(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Summed weights per product and day; a day that the watermark has passed leaves the state."""
    usable = events.where(F.col("product_id").isNotNull() & F.col("event_type").isNotNull())
    weight = F.coalesce(interest_weight(F.col("event_type")), F.lit(0).cast("long"))
    return (
        usable.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("day"), "product_id")
        .agg(F.sum(weight).alias("trend_score"))
        .select(F.col("day.start").alias("day_start"), "product_id", "trend_score")
    )


def product_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("string")


def day_folder() -> Column:
    return F.date_format("day_start", "yyyy-MM-dd")


def _newest(spark: SparkSession, path: str, below: int | None = None) -> dict[str, list[tuple[int, str]]]:
    """Versions of each part, newest first."""
    found: dict[str, list[tuple[int, str]]] = {}
    for folder in folders(spark, f"{path}/{_VERSION}=*/{_PART}=*"):
        version, part = (piece.split("=", 1)[1] for piece in folder.rsplit("/", 2)[1:])
        if below is None or int(version) < below:
            found.setdefault(part, []).append((int(version), folder))
    return {part: sorted(versions, reverse=True) for part, versions in found.items()}


def merge_batch(changed: DataFrame, batch_id: int, path: str, keys: list[str], part: Column) -> None:
    """Merge the rows of changed keys into the snapshot below ``path``.

    Only parts with changed keys are written, as a new version; of their older versions the
    newest stays, for readers that are still on it. A trigger that is run again merges into the
    same older version and overwrites its own.
    """
    spark = changed.sparkSession
    changed = changed.withColumn(_PART, part).persist()
    try:
        touched = [r[0] for r in changed.select(_PART).distinct().collect()]  # bounded by the number of parts
        older = _newest(spark, path, below=batch_id)
        before = [older[p][0][1] for p in touched if p in older]
        merged = changed
        if before:
            table = spark.read.schema(changed.schema).option("basePath", path).parquet(*before).select(*changed.columns)
            merged = table.join(changed.select(*keys), keys, "left_anti").select(*changed.columns).unionByName(changed)
        merged.repartition(_PART).write.mode("overwrite").partitionBy(_PART).parquet(f"{path}/{_VERSION}={batch_id}")
        for p in touched:
            for _, folder in older.get(p, [])[1:]:
                delete_folder(spark, folder)
    finally:
        changed.unpersist()


def snapshot_stream(
    table: DataFrame, path: str, checkpoint: str, keys: list[str], part: Column, available_now: bool = False
) -> StreamingQuery:
    """Keep a table of ``table``'s newest row per key below ``path``.

    Update mode: a trigger brings the keys that changed in it, and only the parts that they are
    in are written again. With a watermark, closed windows leave the stream's state and stay in
    the snapshot.
    """
    writer = table.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, path, keys, part)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version of each part; other folders are not opened."""
    newest = [versions[0][1] for versions in _newest(spark, path).values()]
    if not newest:
        return spark.read.parquet(path)  # tells that there is no table yet
    return spark.read.option("basePath", path).parquet(*newest).drop(_VERSION, _PART)
