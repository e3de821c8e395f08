"""Popular and trending products."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.sampling import seeded_hash
from cartwise.functions.scoring import WEIGHT_OF, interest_weight
from cartwise.operators.ranking import first_by_priority, top_k

NEWEST = "newest"


def recent(events: DataFrame, days: int | None, as_of: str | datetime | None = NEWEST) -> DataFrame:
    """Events no older than ``days`` before ``as_of``, bound included.

    ``as_of`` is ``"newest"`` (latest event in the table), a timestamp, or ``None``
    for the clock. The bound is a scalar subquery or a constant, so it reaches the
    scan as a filter. ``days=None`` keeps all.
    """
    if days is None:
        return events
    kind = events.schema["event_time"].dataType.simpleString()
    span = F.make_dt_interval(F.lit(days))
    if as_of is None:
        oldest = F.current_timestamp().cast(kind) - span
    elif as_of == NEWEST:
        oldest = events.select(F.max("event_time") - span).scalar()
    else:
        oldest = F.lit(as_of).cast(kind) - span
    return events.where(F.col("event_time") >= oldest)


def count_by_type(events: DataFrame, types: Sequence[str] = tuple(WEIGHT_OF)) -> DataFrame:
    """Events per product and type, 0 where absent. Rows without product or type do not count."""
    usable = events.where(F.col("product_id").isNotNull() & F.col("event_type").isNotNull())
    return usable.groupBy("product_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(kind) for kind in types]
    )


def _pivot_score() -> Column:
    terms = [F.col(kind) * F.lit(weight).cast("long") for kind, weight in WEIGHT_OF.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def popularity_scores(events: DataFrame, top_n: int | None = 10, name: str = "score") -> DataFrame:
    """Weighted event counts over all time, best first."""
    scored = count_by_type(events).select("product_id", _pivot_score().alias(name))
    return scored if top_n is None else top_k(scored, top_n, _best_first(name))


def trending_scores(
    events: DataFrame, recent_days: int = 7, top_n: int | None = 10, as_of: str | datetime | None = NEWEST
) -> DataFrame:
    """Weighted event counts of the last ``recent_days``."""
    return popularity_scores(recent(events, recent_days, as_of), top_n, name="trend_score")


def popular_items(events: DataFrame, top_k_items: int | None = None) -> DataFrame:
    """Purchases per product, tagged ``popular``; all purchased products unless cut."""
    counted = (
        events.where((F.col("event_type") == "purchase") & F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("score"))
        .withColumn("source", F.lit("popular"))
    )
    return counted if top_k_items is None else top_k(counted, top_k_items, _best_first("score"))


def trending_items(
    events: DataFrame,
    top_k_items: int | None = 50,
    days: int | None = 3650,
    as_of: str | datetime | None = None,
) -> DataFrame:
    """Summed weights of recent events per product, tagged ``trending``; types without weight add 0."""
    scored = (
        recent(events, days, as_of)
        .where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.coalesce(F.sum(interest_weight(F.col("event_type"))), F.lit(0)).cast("long").alias("score"))
        .withColumn("source", F.lit("trending"))
    )
    return scored if top_k_items is None else top_k(scored, top_k_items, _best_first("score"))


def trending_and_popular(
    events: DataFrame, top_k_items: int = 10, days: int | None = 3650, as_of: str | datetime | None = None
) -> DataFrame:
    """Both lists added up per product; a product on both is tagged ``both``."""
    merged = union_lists(trending_items(events, top_k_items * 2, days, as_of), popular_items(events))
    combined = merged.groupBy("product_id").agg(
        F.sum("score").alias("score"),
        F.when(F.min("source") != F.max("source"), F.lit("both")).otherwise(F.min("source")).alias("source"),
    )
    return top_k(combined, top_k_items, _best_first("score"))


def union_lists(*lists: DataFrame) -> DataFrame:
    """Bag union of ranked lists; a column one list lacks is null there."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def seeded_sample(df: DataFrame, n: int, seed: int = 42, per: Sequence[str] = ()) -> DataFrame:
    """``n`` products in seeded hash order, or all there are; per group when ``per`` is given."""
    order = [seeded_hash(seed, F.col("product_id")), F.col("product_id")]
    return top_k(df, n, order, per)


def first_source_wins(*lists: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Union in which each key keeps the row of the earliest list that has it."""
    tagged = [part.withColumn("_priority", F.lit(at)) for at, part in enumerate(lists)]
    return first_by_priority(union_lists(*tagged), list(keys), "_priority").drop("_priority")


def diversified_items(
    events: DataFrame,
    top_k_each: int = 5,
    seed: int = 42,
    days: int | None = 3650,
    as_of: str | datetime | None = None,
) -> DataFrame:
    """Top trending products plus a sample of purchased ones; vary ``seed`` per run for variety."""
    return first_source_wins(
        trending_items(events, top_k_each, days, as_of), seeded_sample(popular_items(events), top_k_each, seed)
    )


def _best_first(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("product_id").asc()]
