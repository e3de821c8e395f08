from cartwise.operators.collaborative import cross_validate_als, fit_als, recommend_from_model, rmse
from cartwise.operators.ratings import catalog_counts, index_ratings, rate_events, rating_matrix, split_rows
from pyspark.sql import functions as F
from tests.helpers import events, rows


def test_rating_of_each_type(spark):
    df = rate_events(events(spark, [(1, k, 1) for k in ("view", "cart", "purchase", "signup", None)]))
    assert [r.rating for r in df.orderBy("event_id").collect()] == [0.1, 0.3, 0.5, 0.0, 0.0]


def test_matrix_keeps_repeats_unless_aggregated(spark):
    log = events(spark, [(10, "view", 7), (10, "cart", 7), (20, "purchase", 9)])
    plain, users, products = rating_matrix(log)
    assert [(u, p, round(r, 6)) for u, p, r in rows(plain)] == [(0, 0, 0.1), (0, 0, 0.3), (1, 1, 0.5)]
    assert rows(users) == [(10, 0), (20, 1)] and rows(products) == [(7, 0), (9, 1)]
    rated = rate_events(log)
    assert round(index_ratings(rated, users, products, "sum").agg(F.max("rating")).first()[0], 6) == 0.5
    assert index_ratings(rated, users, products, "max").count() == 2
    assert dict(plain.dtypes) == {"user_index": "int", "product_index": "int", "rating": "float"}


def test_split_is_complete_disjoint_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "event_id")
    train, test = split_rows(df, ["event_id"])
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert a | b == set(range(5000)) and not a & b
    assert 0.77 < len(a) / 5000 < 0.83
    assert {r[0] for r in split_rows(df.repartition(9), ["event_id"])[0].collect()} == a


def test_counts(spark):
    assert tuple(catalog_counts(events(spark, [(1, "view", 5), (1, "view", 6), (2, "cart", 5)])).first()) == (2, 2)


def _blocks(spark):
    """Two groups of users, each liking its own half of the products."""
    data = [
        (u, p, 1.0 if (u < 15) == (p < 10) else 0.0)
        for u in range(30)
        for p in range(20)
        if (u * 7 + p * 3) % 4
    ]
    return spark.createDataFrame(data, "user_index int, product_index int, rating float")


def test_als_beats_the_mean_and_repeats(spark):
    train, test = split_rows(_blocks(spark), ["user_index", "product_index"])
    train.cache()
    model = fit_als(train, blocks=2)
    mean = train.select(F.avg("rating")).first()[0]
    als_error = rmse(model.transform(test)).first()[0]
    assert als_error < rmse(test.withColumn("prediction", F.lit(mean))).first()[0] / 2

    users = spark.createDataFrame([(u, 100 + u) for u in range(30)], "user_index int, user_id long")
    products = spark.createDataFrame([(p, 500 + p) for p in range(20)], "product_index int, product_id long")
    recs = recommend_from_model(model, users, products, 5)
    again = recommend_from_model(fit_als(train, blocks=2), users, products, 5)
    assert recs.count() == 150 and recs.where("user_id is null or product_id is null or isnan(predicted_rating)").count() == 0
    assert {r[:2] for r in rows(recs)} == {r[:2] for r in rows(again)}
    one = recommend_from_model(model, users, products, 5, only=users.where("user_id = 103"))
    assert {r[0] for r in rows(one)} == {103}


def test_cross_validation_reports_each_grid_point(spark):
    model, metrics = cross_validate_als(_blocks(spark), ranks=(2, 4), folds=2, blocks=2)
    assert metrics.count() == 2 and model.rank in (2, 4)
