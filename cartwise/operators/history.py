"""Who has how much history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: users with fewer events than this are cold-start users.
WARM_FROM = 6


def user_history(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events of the users in a request table."""
    return events.join(users.select("user_id").distinct(), "user_id", "left_semi").select(*events.columns)


def user_tiers(events: DataFrame, users: DataFrame, warm_from: int = WARM_FROM) -> DataFrame:
    """``(user_id, n_events, tier)`` for every user: ``new``, ``cold_start`` or ``warm``."""
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    n = F.coalesce(F.col("n_events"), F.lit(0).cast("long"))
    tier = F.when(n == 0, "new").when(n < warm_from, "cold_start").otherwise("warm")
    return (
        users.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", n.alias("n_events"), tier.alias("tier"))
    )
