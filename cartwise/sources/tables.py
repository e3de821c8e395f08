"""Batch reads and writes. Paths may be on any file system Spark can reach."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.functions.times import event_timestamp
from cartwise.schema import EVENTS, RECOMMENDATIONS

CSV_OPTIONS = {"header": True, "escape": '"'}


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options
) -> DataFrame:
    """Any file table; CSV is read with a header."""
    reader = spark.read.format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_if_present(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame | None:
    """A table that may not have been written yet: ``None`` if there is nothing at the path. Any other
    fault (no access, no readable file, a wrong option) is raised."""
    try:
        return read_table(spark, path, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a path pattern, on any file system, sorted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(status.getPath().toString() for status in found or [] if status.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_events(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = EVENTS
) -> DataFrame:
    """Events with the explicit schema.

    From CSV the time is read as text first, so that zone suffixes such as
    ``... UTC`` parse and unreadable times become null instead of failing the read.
    """
    if fmt != "csv":
        return read_table(spark, path, fmt, schema)
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "event_time" else f.dataType) for f in schema]
    )
    return read_table(spark, path, fmt, as_text).withColumn("event_time", event_timestamp(F.col("event_time")))


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types taken from the data; costs an extra pass, so for ad-hoc tables only."""
    return read_table(spark, path, "csv", inferSchema=True)


def read_recommendations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved recommendation table."""
    return read_table(spark, path, fmt, RECOMMENDATIONS if fmt == "csv" else None).select(
        *[F.col(f.name).cast(f.dataType) for f in RECOMMENDATIONS]
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def _user_bucket(user_id: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(user_id.cast("long")), buckets.cast("long")).cast("int")


def write_recommendations(df: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 1) -> str:
    """Parquet in user buckets, below a folder that names their number: the table says itself how it is
    laid out, and readers need not be told. A bucket may have several files; a user is in one."""
    bucket = _user_bucket(F.col("user_id"), F.lit(buckets))
    part = F.pmod(F.hash("user_id"), F.lit(files_per_bucket))
    dealt = df.withColumns({_BUCKETS: F.lit(buckets), _BUCKET: bucket}).repartition(_BUCKET, part)
    return write_parquet(dealt.sortWithinPartitions(_BUCKET, "user_id"), path, (_BUCKETS, _BUCKET))


_BUCKETS, _BUCKET = "user_buckets", "user_bucket"


def buckets_of(spark: SparkSession, path: str) -> int:
    """Number of buckets of a saved recommendation table, from its folders."""
    found = folders(spark, f"{path}/{_BUCKETS}=*")
    if len(found) != 1:
        raise ValueError(f"{path} is no table of write_recommendations: {len(found)} layouts")
    return int(found[0].rsplit("=", 1)[1])


def read_user_recommendations(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """One user's rows from a saved recommendation table; other buckets are pruned."""
    buckets = buckets_of(spark, path)
    table = spark.read.parquet(path)
    own = (F.col(_BUCKET) == _user_bucket(F.lit(user_id), F.lit(buckets))) & (F.col("user_id") == user_id)
    return table.where(own).drop(_BUCKETS, _BUCKET)


def read_recommendations_of(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """Rows of the users in a request table. Buckets that none of them is in are pruned from the scan;
    their list is no longer than the number of buckets."""
    buckets = buckets_of(spark, path)
    asked = users.select(F.col("user_id").cast("long")).distinct().withColumn(_BUCKET, _user_bucket(F.col("user_id"), F.lit(buckets)))
    needed = [r[0] for r in asked.select(_BUCKET).distinct().where(F.col(_BUCKET).isNotNull()).collect()]
    table = spark.read.parquet(path).where(F.col(_BUCKET).isin(needed) if needed else F.lit(False))
    return table.join(asked, [_BUCKET, "user_id"], "left_semi").select("user_id", "product_id", "final_score")
