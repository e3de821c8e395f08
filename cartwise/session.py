"""Session set-up and the shared working folder."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# What one task gets of a table that is dealt by ``dealt``.
ROWS_PER_TASK = 500_000


def build_session(app_name: str = "cartwise", master: str | None = None, **settings) -> SparkSession:
    """Session with the settings the jobs rely on; ``settings`` are further Spark keys."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, which import it by name wherever they were started."""
    context, folder = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, _SHIPPED, False) or not folder.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="cartwise-code-")) / f"{folder.name}.zip"  # read by the driver alone
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(folder.rglob("*.py")):
            out.write(path, path.relative_to(folder.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


_SHIPPED = "_cartwise_shipped"


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session in one
    process (``local``, ``local[n]``) may go without: there, driver and executors are one process and a temporary folder is
    shared by definition.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="cartwise-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_root(spark)}/cartwise/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table below the shared folder: read by column, and the same on every read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by a hash of ``keys`` to as many tasks as its rows need, for an aggregate or sort by ``keys``.

    More rows make more tasks, not larger ones: the number does not depend on the cluster or on how well
    the rows compress, which is what partitions joined by their size in bytes go by. Nothing is combined
    before the exchange, so use it where few rows have the same key.
    """
    table = written(df, "dealt")  # counted and then dealt, so computed once
    return table.repartition(tasks_for(table.count()), *keys)


def tasks_for(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_TASK))
