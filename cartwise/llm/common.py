"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a table that every executor
    reaches, with its lineage cut."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing reads any more, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does the same on ASCII text, only faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def slices(batches, rows: int = 500):
    """Arrow batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()


def give_back() -> None:
    """Return what Arrow and the C library hold for later: a worker that waits for its next task keeps it otherwise,
    and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim:
        trim(0)


def text_batches(spark: SparkSession) -> None:
    """Let Spark end an Arrow batch at ``BATCH_BYTES``: ten thousand long texts at once are held by the executor and by
    its Python worker, each in a copy or two. A smaller limit of the session stays."""
    plain = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_KEY))  # as Spark writes its default; others were set on purpose
    if plain and int(plain[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names put aside, so that an operator may use the names for its own,
    and what gives a table the columns of ``docs`` back under their names and in their order."""
    own = {c: f"__own_{c}" if c in names else c for c in docs.columns}
    back = [F.col(f"`{kept}`").alias(c) for c, kept in own.items()]
    return docs.withColumnsRenamed(own), lambda df: df.select(*back)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
