"""Blend of collaborative and content scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.scoring import blend
from cartwise.operators.joins import skew_join
from cartwise.operators.ranking import best_per_key, dedupe_across_users, top_k


def best_first() -> list[Column]:
    return [F.col("final_score").desc(), F.col("product_id").asc()]


def hybrid_scores(cf: DataFrame, content: DataFrame) -> DataFrame:
    """One row per CF row and content neighbour of its product (one row if it has none).

    For the table of all scored neighbours; ``best_hybrid`` gives the best score per user and
    product without it. A product that many users share is split over tasks.
    """
    return (
        skew_join(cf, content, "product_id", ["user_id"])
        .withColumn("cbf_score", F.coalesce("cbf_score", F.lit(0.0)))
        .withColumn("final_score", blend(F.col("predicted_rating"), F.col("cbf_score")))
        .select("user_id", "product_id", "recommended_product", "cbf_score", "final_score")
    )


def best_hybrid(cf: DataFrame, content: DataFrame) -> DataFrame:
    """``(user_id, product_id, final_score)``: the best usable score of each user and product.

    The blend rises with both of its scores, so the best blend of a pair is the blend of the
    best: both sides are reduced before they meet (a product to one content score, a pair to
    one rating), and nothing has to be aggregated after the join. Equal to the best row per
    (user, product) of ``hybrid_scores`` whose score is neither null nor NaN.
    """
    usable = lambda name: F.col(name).isNotNull() & ~F.isnan(name)
    rated = cf.where(usable("predicted_rating")).groupBy("user_id", "product_id").agg(
        F.max("predicted_rating").alias("predicted_rating")
    )
    # As in ``hybrid_scores``, a null content score counts as 0; NaN is left out unless a product has no other.
    score = F.coalesce("cbf_score", F.lit(0.0))
    best = F.coalesce(F.max(F.when(~F.isnan(score), score)), F.lit(float("nan")))
    nearest = content.groupBy("product_id").agg(best.alias("cbf_score"))
    joined = skew_join(rated, nearest, "product_id", ["user_id"])
    final = blend(F.col("predicted_rating"), F.coalesce("cbf_score", F.lit(0.0)))
    return joined.select("user_id", "product_id", final.alias("final_score")).where(usable("final_score"))


def top_per_user(scored: DataFrame, k: int = 10, across_users: bool = False) -> DataFrame:
    """Best score per (user, product), then the ``k`` best products of each user."""
    rows = scored.select("user_id", "product_id", "final_score")
    if across_users:
        rows = dedupe_across_users(rows)
    return top_best(best_per_key(rows, ["user_id", "product_id"], "final_score"), k)


def top_best(best: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best products of each user from one row per (user, product)."""
    return top_k(best.select("user_id", "product_id", "final_score"), k, best_first(), ["user_id"])


def of_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the users in a request table."""
    return rows.join(users.select("user_id").distinct(), "user_id", "left_semi").select(*rows.columns)


def recommendations_for(scored: DataFrame, users: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``top_per_user`` over usable scores only, for the users of a request table or for all."""
    usable = scored.where(F.col("final_score").isNotNull() & ~F.isnan("final_score"))
    return top_per_user(usable if users is None else of_users(usable, users), k)
