"""Hash values that stand in for random numbers and repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *keys: Column) -> Column:
    """md5 text of ``seed|key|...``: a shuffle order that depends on nothing but the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def seeded_percent(seed: int, *keys: Column) -> Column:
    """Whole number 0..99 from the first 32 bits of the hash."""
    return F.conv(F.substring(seeded_hash(seed, *keys), 1, 8), 16, 10).cast("long") % 100
