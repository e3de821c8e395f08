"""Vectors as integers, for the operators that compare exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared length up to which integer products and distances of two vectors fit in 64 bits.
MAX_SQUARED = 2.0**60


def integer_vectors(df: DataFrame, keep: list[str], vector: str = "embedding", scale: int = 256, dims: int | None = None) -> DataFrame:
    """The columns ``keep`` and ``q``, the components of ``vector`` as ``floor(scale * x)``.

    A row takes no part if its vector is null, has a null or non-finite component or another
    length than ``dims`` (if given), or if its squared integer length is 2**60 or more: exact
    products and distances of such vectors need not fit in 64 bits.
    """
    sized = df.select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    sized = sized.where(F.col("_v").isNotNull() if dims is None else F.size("_v") == dims)
    # A null or NaN component makes the comparison null or false.
    squared = F.aggregate("_v", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    usable = F.coalesce(~F.isnan(squared) & (squared < MAX_SQUARED), F.lit(False))
    return sized.where(usable).select(*keep, F.transform("_v", lambda x: F.floor(x * scale).cast("int")).alias("q"))
