"""Implicit ratings, dense ids and the training split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.sampling import seeded_percent
from cartwise.functions.scoring import implicit_rating
from cartwise.operators.cleaning import training_rows
from cartwise.operators.ranking import number_rows
from cartwise.session import materialise, tasks_for


def rate_events(events: DataFrame) -> DataFrame:
    return events.withColumn("rating", implicit_rating(F.col("event_type")))


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name)`` with ``name`` = 0..n-1 in key order; a join table in both directions."""
    return number_rows(df.select(key).distinct(), [F.col(key).asc()], name=name, start=0)


def index_ratings(
    rated: DataFrame, users: DataFrame, products: DataFrame, aggregate: str | None = None
) -> DataFrame:
    """``(user_index, product_index, rating)`` as ALS takes it.

    ``aggregate`` is ``None`` (one row per event), ``"sum"`` or ``"max"`` per pair. Pairs are folded in tasks
    of a size; ``rated`` is counted for that, so it should be a stored table. In the id joins each task holds
    its share of an index, not of the ratings, which are neither sorted nor kept.
    """
    if aggregate:
        fold = {"sum": F.sum, "max": F.max}[aggregate]
        pairs = rated.repartition(tasks_for(rated.count()), "user_id", "product_id")
        rated = pairs.groupBy("user_id", "product_id").agg(fold("rating").alias("rating"))
    return (
        rated.join(users.hint("shuffle_hash"), "user_id")
        .join(products.hint("shuffle_hash"), "product_id")
        .select(
            F.col("user_index").cast("int").alias("user_index"),
            F.col("product_index").cast("int").alias("product_index"),
            F.col("rating").cast("float").alias("rating"),
        )
    )


def rating_matrix(
    events: DataFrame, aggregate: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings plus the user and product index they use.

    The cleaned rows feed both indexes and the join, so they are written out once,
    cut to the three columns needed.
    """
    rated = rate_events(training_rows(events)).select("user_id", "product_id", "rating")
    rated = materialise(rated)
    users = dense_index(rated, "user_id", "user_index")
    products = dense_index(rated, "product_id", "product_index")
    return index_ratings(rated, users, products, aggregate), users, products


def split_rows(
    df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the row key: disjoint, complete and the same on every run."""
    in_train = seeded_percent(seed, *[F.col(k) for k in keys]) < train_percent
    return df.where(in_train), df.where(~in_train)


def catalog_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_distinct("user_id").alias("n_users"), F.count_distinct("product_id").alias("n_products")
    )
