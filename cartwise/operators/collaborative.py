"""Collaborative filtering with MLlib ALS."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.sampling import seeded_hash
from cartwise.operators.factor_search import top_products
from cartwise.session import shared_root

# The model's parameters.
RANK = 10
REG_PARAM = 0.01
FOLDS = 3


def _als(spark, rank: int, reg_param: float, seed: int, blocks: int | None) -> ALS:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    als = ALS(
        userCol="user_index",
        itemCol="product_index",
        ratingCol="rating",
        coldStartStrategy="drop",
        rank=rank,
        regParam=reg_param,
        seed=seed,
    )
    return als.setNumBlocks(blocks) if blocks else als


def _rmse() -> RegressionEvaluator:
    return RegressionEvaluator(predictionCol="prediction", labelCol="rating", metricName="rmse")


def fit_als(
    train: DataFrame, rank: int = RANK, reg_param: float = REG_PARAM, seed: int = 42, blocks: int | None = None
) -> ALSModel:
    """Explicit-feedback ALS. Raise ``blocks`` with the data; keep it low for small tables."""
    return _als(train.sparkSession, rank, reg_param, seed, blocks).fit(train)


def cross_validate_als(
    train: DataFrame,
    ranks: tuple[int, ...] = (RANK,),
    reg_params: tuple[float, ...] = (REG_PARAM,),
    folds: int = FOLDS,
    seed: int = 42,
    blocks: int | None = None,
) -> tuple[ALSModel, DataFrame]:
    """Best model of the grid, and ``(rank, reg_param, avg_rmse)`` per grid point."""
    als = _als(train.sparkSession, RANK, REG_PARAM, seed, blocks)
    grid = ParamGridBuilder().addGrid(als.rank, list(ranks)).addGrid(als.regParam, list(reg_params)).build()
    search = CrossValidator(estimator=als, estimatorParamMaps=grid, evaluator=_rmse(), numFolds=folds, seed=seed)
    model = search.fit(train)
    points = [
        (int(point[als.rank]), float(point[als.regParam]), float(rmse))
        for point, rmse in zip(grid, model.avgMetrics)
    ]
    metrics = train.sparkSession.createDataFrame(points, "rank int, reg_param double, avg_rmse double")
    return model.bestModel, metrics


def rmse(predictions: DataFrame) -> DataFrame:
    """Root mean squared error as a one-row table."""
    error = F.col("prediction") - F.col("rating")
    return predictions.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def recommend_from_model(
    model: ALSModel, users: DataFrame, products: DataFrame, k: int = 10, only: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` per user with original ids: ``(user_id, product_id, predicted_rating)``.

    ``only`` is a table of ``user_id`` to limit the work to. The lists are those that the model
    itself recommends, found by exact search in the factors (``factor_search``), which does not
    score every user with every product. Equal scores go to the smaller product index.
    """
    factors = model.userFactors.select(F.col("id").cast("long").alias("user_index"), "features")
    if only is not None:
        wanted = users.join(only.select("user_id").distinct(), "user_id", "left_semi").select("user_index")
        factors = factors.join(wanted, "user_index", "left_semi")
    items = model.itemFactors.select(F.col("id").cast("long").alias("product_index"), "features")
    return (
        top_products(factors, items, k)
        .join(users, "user_index", "left")
        .join(products, "product_index", "left")
        .select("user_id", "product_id", "predicted_rating")
    )


def folds_of(ratings: DataFrame, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``ratings`` with ``fold``: 0 to ``folds - 1`` by a hash of the row, so equal rows share a fold."""
    number = F.conv(F.substring(seeded_hash(seed, *[F.col(c) for c in ratings.columns]), 1, 8), 16, 10).cast("long")
    return ratings.withColumn("fold", number % folds)


def fold_metrics(
    ratings: DataFrame,
    rank: int = RANK,
    reg_param: float = REG_PARAM,
    folds: int = FOLDS,
    seed: int = 42,
    blocks: int | None = None,
) -> DataFrame:
    """Cross-validation as one table: ``(fold, n_train, n_test, n_scored, rmse, train_rmse, mean_rmse)``.

    Every row carries its fold; a model is fitted on the rows of all other folds, and the scored
    rows of all folds, each with its fold, are evaluated by one aggregation. ``mean_rmse`` is the
    error of the training rows' mean on the training rows, to hold against ``train_rmse``. Rows
    of users or products that the model has not seen are not scored.
    """
    dealt = folds_of(ratings, folds, seed)
    scored = []
    for fold in range(folds):
        train = dealt.where(F.col("fold") != fold)
        model = fit_als(train.drop("fold"), rank, reg_param, seed, blocks)
        scored.append(model.transform(dealt).withColumns({"own": F.col("fold") == fold, "fold": F.lit(fold).cast("long")}))
    rows = scored[0]
    for part in scored[1:]:
        rows = rows.unionByName(part)
    error = F.pow(F.col("prediction") - F.col("rating"), F.lit(2))
    errors = rows.groupBy("fold").agg(
        F.count_if("own").alias("n_scored"),
        F.sqrt(F.avg(F.when(F.col("own"), error))).alias("rmse"),
        F.sqrt(F.avg(F.when(~F.col("own"), error))).alias("train_rmse"),
    )
    sums = [F.sum(x).alias(n) for n, x in (("n", F.lit(1)), ("s", F.col("rating").cast("double")), ("q", F.pow(F.col("rating").cast("double"), F.lit(2))))]
    each = dealt.groupBy("fold").agg(*sums)
    # What a fold holds, and what the others hold.
    n, s, q = (each.select(F.sum(c)).scalar() - F.col(c) for c in ("n", "s", "q"))
    spread = F.sqrt(F.greatest(q / n - F.pow(s / n, F.lit(2)), F.lit(0.0)))
    sizes = each.select("fold", n.alias("n_train"), F.col("n").alias("n_test"), spread.alias("mean_rmse"))
    return sizes.join(errors, "fold").select("fold", "n_train", "n_test", "n_scored", "rmse", "train_rmse", "mean_rmse")


def normal_equations(model: ALSModel, ratings: DataFrame, reg_param: float = REG_PARAM) -> DataFrame:
    """How well the model solves its own equations: ``(user_index, n_ratings, residual)`` per rated user.

    The last step of a fit solves, for each user, ``(G + reg_param * n * I) x = b`` with the Gram
    matrix ``G`` of the factors of the ``n`` products rated and ``b`` their sum weighted by rating.
    ``G`` and ``b`` are summed here by one aggregation, apart from the solver; ``residual`` is the
    length of the difference relative to that of ``b`` (absolute where ``b`` is 0).
    """
    rank = model.rank
    items = model.itemFactors.select(F.col("id").alias("product_index"), F.col("features").alias("v"))
    cell = lambda i: F.col("v")[i].cast("double")
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    summed = (
        ratings.join(items, "product_index")
        .groupBy("user_index")
        .agg(
            F.count(F.lit(1)).alias("n_ratings"),
            *[F.sum(cell(i) * cell(j)).alias(f"g{i}_{j}") for i, j in pairs],
            *[F.sum(cell(i) * F.col("rating").cast("double")).alias(f"b{i}") for i in range(rank)],
        )
    )
    users = model.userFactors.select(F.col("id").alias("user_index"), F.col("features").alias("x"))
    x = lambda i: F.col("x")[i].cast("double")
    total = lambda terms: sum(terms[1:], terms[0])
    left = [
        total([F.col(f"g{min(i, j)}_{max(i, j)}") * x(j) for j in range(rank)]) + F.lit(reg_param) * F.col("n_ratings") * x(i)
        for i in range(rank)
    ]
    gap = F.sqrt(total([F.pow(left[i] - F.col(f"b{i}"), F.lit(2)) for i in range(rank)]))
    size = F.sqrt(total([F.pow(F.col(f"b{i}"), F.lit(2)) for i in range(rank)]))
    residual = gap / F.when(size > 0, size).otherwise(F.lit(1.0))
    return summed.join(users, "user_index").select("user_index", "n_ratings", residual.alias("residual"))


def list_report(model: ALSModel, lists: DataFrame, ratings: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """What holds of each user's list: ``(user_id, n_products, consistent)``.

    A list is consistent if it names no product twice, each rating is the inner product of the
    two factors (to 1e-4), and no product that the user has rated scores above the list's last
    one without being on it.
    """
    user_vectors = model.userFactors.select(F.col("id").alias("user_index"), F.col("features").alias("u"))
    item_vectors = model.itemFactors.select(F.col("id").alias("product_index"), F.col("features").alias("v"))
    terms = F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double"))
    product = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    indexed = lists.join(users, "user_id").join(products, "product_id")
    on_list = indexed.select("user_index", "product_index", "predicted_rating", F.lit(True).alias("listed"))
    rated = ratings.select("user_index", "product_index").distinct()
    rows = (
        rated.join(on_list.select("user_index", "product_index"), ["user_index", "product_index"], "left_anti")
        .withColumns({"predicted_rating": F.lit(None).cast("double"), "listed": F.lit(False)})
        .unionByName(on_list)
        .join(user_vectors, "user_index")
        .join(item_vectors, "product_index")
        .withColumn("score", product)
    )
    facts = rows.groupBy("user_index").agg(
        F.count_if("listed").alias("n_products"),
        F.count_distinct(F.when(F.col("listed"), F.col("product_index"))).alias("n_distinct"),
        F.max(F.when(F.col("listed"), F.abs(F.col("score") - F.col("predicted_rating")))).alias("gap"),
        F.min(F.when(F.col("listed"), F.col("score"))).alias("least"),
        F.max(F.when(~F.col("listed"), F.col("score"))).alias("missed"),
    )
    kept = (F.col("n_products") == F.col("n_distinct")) & (F.col("gap") < 1e-4)
    better = F.coalesce(F.col("missed") > F.col("least") + 1e-4, F.lit(False))
    return facts.join(users, "user_index").select("user_id", "n_products", F.coalesce(kept & ~better, F.lit(False)).alias("consistent"))
