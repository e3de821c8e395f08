"""A join that stays even when one key holds most rows of its left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import written

_SALT, _SALTS, _HOT = "__salt", "__salts", "__hot_key"


def salts_of_hot_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``(__hot_key, __salts)``: keys with more than a task's even share of the rows, and over how many
    tasks to spread each.

    There are fewer than ``tasks`` such keys, whatever the data: each has more than
    ``1 / tasks`` of the rows. That is what bounds the broadcasts of ``skew_join``.
    """
    counts = df.groupBy(F.col(key).alias(_HOT)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    share = F.ceil(F.col("n") * tasks / total).cast("int")
    return counts.where(F.col("n") * tasks > total).select(_HOT, share.alias(_SALTS))


def skew_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str], how: str = "left", tasks: int | None = None
) -> DataFrame:
    """Equi join on ``key`` in which a hot key of ``left`` is split by a hash of ``spread_by``.

    Rows of ``right`` with a hot key are copied once for each part, so ``right`` should have few
    rows per key. Null keys match nothing and are spread like a hot key. The result has the
    rows and columns of ``left.join(right, key, how)`` for an inner or left join.
    """
    if how not in ("left", "inner"):
        raise ValueError("only inner and left joins keep their rows when the right side is copied")
    left = written(left, "skew-join")  # counted and then joined, so computed once
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(salts_of_hot_keys(left, key, tasks))
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col(_SALTS), F.lit(1))).cast("int")
    dealt = left.join(hot, F.col(key).eqNullSafe(F.col(_HOT)), "left").withColumn(_SALT, part).drop(_HOT, _SALTS)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
    copied = right.join(hot, F.col(key) == F.col(_HOT), "left").withColumn(_SALT, copies).drop(_HOT, _SALTS)
    return dealt.join(copied, [key, _SALT], how).drop(_SALT)
