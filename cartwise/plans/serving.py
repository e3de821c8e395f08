"""Recommendation lists for every user, as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.history import WARM_FROM, user_tiers
from cartwise.operators.hybrid import recommendations_for
from cartwise.operators.metadata import FOLDED_COLUMNS, add_folded_metadata, add_metadata
from cartwise.operators.popularity import diversified_items, first_source_wins, seeded_sample, union_lists
from cartwise.session import dealt, materialise


def shared_lists(trending: DataFrame, popular: DataFrame, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The part of a list that all users of a tier share, for new and for cold-start users."""
    half = k // 2
    from_trending = int(k * 0.3)
    from_popular = k - int(k * 0.4) - from_trending
    # One draw serves both tiers: the smaller sample is the start of the larger one.
    trending = materialise(seeded_sample(trending, max(half, from_trending), seed))
    popular = materialise(seeded_sample(popular, max(k - half, from_popular), seed))
    for_new = first_source_wins(seeded_sample(trending, half, seed), seeded_sample(popular, k - half, seed))
    for_cold = first_source_wins(
        seeded_sample(trending, from_trending, seed), seeded_sample(popular, from_popular, seed)
    )
    return for_new, for_cold


def recommend_all_users(
    users: DataFrame,
    history: DataFrame,
    scored: DataFrame,
    trending: DataFrame,
    popular: DataFrame,
    metadata: DataFrame,
    k: int = 10,
    seed: int = 42,
    warm_from: int = WARM_FROM,
    folded: bool = False,
) -> DataFrame:
    """Lists by tier, with metadata: a row for each variant, or one with the variants folded (``add_folded_metadata``).

    New users: half trending, half popular. Cold-start users: 4 of their own hybrid
    products, 3 trending, 3 popular (for ``k=10``). Warm users: their top ``k``
    hybrid products.

    The shared part of a tier is a few products, collapsed to one row per tier and sent to the
    users along with their tier. All lists then meet the metadata in one join, in which the
    products that all users of a tier share are split over tasks. ``trending`` is the list cut to
    ``k``; ``popular`` holds all purchased products. ``scored`` may have several rows per user and
    product; the best usable one counts.
    """
    tiers = materialise(user_tiers(history, users, warm_from).select("user_id", "tier"))
    for_new, for_cold = shared_lists(trending, popular, k, seed)
    known = tiers.where(F.col("tier") != "new")
    # At most k rows per user, read three times below. Best scores and lists are made in tasks of so many scores.
    own = materialise(recommendations_for(dealt(scored, "user_id"), known, k).join(known, "user_id"))

    warm = own.where(F.col("tier") == "warm")
    cold_own = seeded_sample(own.where(F.col("tier") == "cold_start"), int(k * 0.4), seed, ["user_id"])
    shared = union_lists(for_new.withColumn("tier", F.lit("new")), for_cold.withColumn("tier", F.lit("cold_start")))
    given = _give(tiers, shared)
    repeated = cold_own.select("user_id", "product_id")
    cold_given = given.where(F.col("tier") == "cold_start").join(repeated, ["user_id", "product_id"], "left_anti")
    lists = union_lists(warm, cold_own, given.where(F.col("tier") == "new"), cold_given)
    add, columns = (add_folded_metadata, FOLDED_COLUMNS) if folded else (add_metadata, ["brand", "category_code", "price"])
    return add(lists, metadata, spread_by=["user_id"]).select(
        "user_id", "tier", "product_id", *columns, "final_score", "score", "source"
    )


def _give(tiers: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared list of its tier for each user. One row per tier, of at most ``k`` products, is broadcast."""
    columns = [c for c in shared.columns if c != "tier"]
    collapsed = materialise(shared.groupBy("tier").agg(F.collect_list(F.struct(*columns)).alias("list")))
    return tiers.join(F.broadcast(collapsed), "tier").select("user_id", "tier", F.inline("list"))


def recommend_anonymous(
    events: DataFrame, metadata: DataFrame | None = None, top_k_each: int = 5, seed: int = 42, as_of=None
) -> DataFrame:
    """The diversified list for a visitor without an id, with metadata if given."""
    items = diversified_items(events, top_k_each, seed, as_of=as_of)
    return items if metadata is None else add_metadata(items, metadata)


def as_json(lists: DataFrame) -> DataFrame:
    """One row per user with the list as a JSON array of records; null fields are left out."""
    record = ["product_id", "brand", "category_code", "price", "final_score", "score", "source"]
    order = F.struct(
        F.coalesce(-F.col("final_score"), F.lit(float("inf"))).alias("hybrid"),
        (F.col("source") == "popular").alias("popular"),
        (-F.col("score")).alias("score"),
        F.col("product_id").alias("product_id"),
    )
    rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), *record)))
    plain = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in record]))
    return lists.groupBy("user_id").agg(F.to_json(plain).alias("recommendations"))
