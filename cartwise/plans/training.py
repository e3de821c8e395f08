"""The training job: events to the recommendation table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cartwise.operators.cleaning import fill_missing, identified
from cartwise.operators.collaborative import cross_validate_als, fit_als, recommend_from_model, rmse
from cartwise.operators.hybrid import best_hybrid, hybrid_scores, top_best, top_per_user
from cartwise.operators.ratings import rating_matrix, split_rows
from cartwise.operators.similarity import content_scores, later_similar_items, nest_neighbours
from cartwise.operators.tfidf import product_documents
from cartwise.session import materialise
from cartwise.sources.tables import write_csv, write_recommendations


@dataclass
class Training:
    recommendations: DataFrame
    rmse: DataFrame
    users: DataFrame
    products: DataFrame


def content_table(events: DataFrame) -> DataFrame:
    """Content score of each product's neighbours, from one document per product."""
    return content_scores(nest_neighbours(later_similar_items(product_documents(events))))


def train(
    events: DataFrame,
    k: int = 10,
    aggregate: str | None = None,
    cross_validate: bool = False,
    across_users: bool = False,
    seed: int = 42,
    blocks: int | None = None,
    keep_unidentified: bool = False,
) -> Training:
    """Ratings, ALS, content similarity, blend and the top ``k`` per user.

    The one-point grid of the original set-up needs no cross-validation to pick a
    model, so it runs only when asked for. Events without user or product are left out;
    ``keep_unidentified`` counts them for user 0 and product 0.
    """
    filled = fill_missing(events if keep_unidentified else identified(events))
    ratings, users, products = rating_matrix(filled, aggregate)
    # ALS reads its input many times; the split must be the same each time.
    ratings = materialise(ratings)
    train_rows, test_rows = split_rows(ratings, ["user_index", "product_index", "rating"], seed=seed)
    if cross_validate:
        model, _ = cross_validate_als(train_rows, seed=seed, blocks=blocks)
    else:
        model = fit_als(train_rows, seed=seed, blocks=blocks)
    cf = recommend_from_model(model, users, products, k)
    content = content_table(filled)
    if across_users:  # compares all scores of a product, not only each user's best
        recommendations = top_per_user(hybrid_scores(cf, content), k, across_users=True)
    else:
        recommendations = top_best(best_hybrid(cf, content), k)
    return Training(
        recommendations=recommendations,
        rmse=rmse(model.transform(test_rows)),
        users=users,
        products=products,
    )


def run_training_job(events: DataFrame, path: str, csv_path: str | None = None, **options) -> str:
    """Train and save; executors write, nothing passes through the driver."""
    result = materialise(train(events, **options).recommendations)
    write_recommendations(result, path)
    if csv_path:
        write_csv(result, csv_path)
    return path
