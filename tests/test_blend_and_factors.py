"""Blend with hot products, numbering in one exchange, exact factor search, facts of the ALS models."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from cartwise.operators.collaborative import (
    fit_als,
    fold_metrics,
    folds_of,
    list_report,
    normal_equations,
    recommend_from_model,
)
from cartwise.operators.factor_search import search, top_products
from cartwise.operators.hybrid import best_hybrid, hybrid_scores, recommendations_for, top_best
from cartwise.operators.joins import salts_of_hot_keys, skew_join
from cartwise.operators.ranking import number_rows
from tests.helpers import rows

CF = "user_id long, product_id long, predicted_rating double"
CONTENT = "product_id long, recommended_product long, cbf_score double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_cf(spark, n=4000, hot=7):
    """Eight of ten rows are of one product."""
    rng = random.Random(2)
    made = [(u, hot if rng.random() < 0.8 else rng.randint(0, 30), rng.random()) for u in range(n)]
    made += [(-1, None, 0.5), (-2, 999, 0.25), (-3, 3, None), (-4, 3, float("nan")), (-5, 3, 0.1), (-5, 3, 0.9)]
    return spark.createDataFrame(made, CF)


def content(spark):
    rng = random.Random(3)
    made = [(p, q, rng.random() / 3) for p in range(25) for q in range(p + 1, p + 1 + rng.randint(1, 10))]
    made += [(3, 900, None), (4, 901, float("nan")), (26, 902, float("nan"))]
    return spark.createDataFrame(made, CONTENT)


def cells(df):
    return Counter(tuple(None if v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_skew_join_equals_join(spark):
    cf, near = hot_cf(spark), content(spark)
    for how in ("left", "inner"):
        plain = cf.join(near, "product_id", how)
        assert cells(skew_join(cf, near, "product_id", ["user_id"], how)) == cells(plain)
    with pytest.raises(ValueError):
        skew_join(cf, near, "product_id", ["user_id"], "outer")
    assert skew_join(cf.limit(0), near, "product_id", ["user_id"]).count() == 0
    assert cells(skew_join(cf, near.limit(0), "product_id", ["user_id"])) == cells(cf.join(near.limit(0), "product_id", "left"))


def test_hot_product_is_spread_over_tasks(spark):
    cf = hot_cf(spark)
    salts = dict(rows(salts_of_hot_keys(cf, "product_id", 8)))
    assert list(salts) == [7] and salts[7] >= 6  # at most 7 keys can have more than an eighth
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        near = content(spark).groupBy("product_id").agg(F.max("cbf_score").alias("cbf_score"))
        joined = skew_join(cf, near, "product_id", ["user_id"]).where("product_id = 7")
        parts = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) >= 4 and max(parts) < 0.6 * sum(parts)


def test_best_hybrid_equals_the_fan_out(spark):
    cf, near = hot_cf(spark), content(spark)
    scored = hybrid_scores(cf, near)
    usable = scored.where("final_score IS NOT NULL AND NOT isnan(final_score)")
    want = usable.groupBy("user_id", "product_id").agg(F.max("final_score").alias("final_score"))
    best = best_hybrid(cf, near)
    assert cells(best) == cells(want)
    assert cells(top_best(best, 3)) == cells(recommendations_for(scored, None, 3))


def test_nothing_is_aggregated_after_the_blend_join(spark):
    plan = best_hybrid(hot_cf(spark), content(spark))._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "Aggregate" not in top


# Numbering


def grouped(spark, n=3000):
    rng = random.Random(4)
    made = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randint(0, 50), i, rng.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(made, "g int, v int, i long, c boolean"), made


def plain_numbers(made, per_group, counted):
    key = lambda r: (r[0] is not None, r[0] or 0) if per_group else 0
    out, seen = {}, Counter()
    for r in sorted(made, key=lambda r: (key(r), r[1], r[2])):
        seen[key(r)] += r[3] if counted else 1
        out[r[2]] = seen[key(r)]
    return out


@pytest.mark.parametrize("per_group", [False, True])
@pytest.mark.parametrize("counted", [False, True])
def test_numbers_over_many_ranges(spark, per_group, counted):
    df, made = grouped(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges
    try:
        placed = number_rows(
            df, [F.col("v").asc(), F.col("i").asc()], ["g"] if per_group else (), counted=F.col("c") if counted else None
        )
        assert placed.columns == [*df.columns, "rank"]
        assert {r.i: r["rank"] for r in placed.collect()} == plain_numbers(made, per_group, counted)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert number_rows(df.limit(0), [F.col("i").asc()], ["g"]).count() == 0


def test_numbering_has_no_second_exchange(spark):
    df, _ = grouped(spark, 200)
    plan = plan_of(number_rows(df, [F.col("v").asc(), F.col("i").asc()], ["g"]))
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
    assert "ExistingRDD" not in plan.replace("Scan ExistingRDD[__part", "")  # a table, not a row-wise checkpoint


# Factor search


def factor_tables(spark, users, items):
    u = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(users)], "user_index long, features array<float>")
    v = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(items)], "product_index long, features array<float>")
    return u, v


def plain_search(users, items, k):
    out = {}
    scores = np.asarray(users, np.float32).astype(float) @ np.asarray(items, np.float32).astype(float).T
    for i, s in enumerate(scores):
        out[i] = [(p, round(s[p], 9)) for p in sorted(range(len(s)), key=lambda p: (-s[p], p))[:k]]
    return out


def lists_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.user_index, -r.predicted_rating, r.product_index)):
        out.setdefault(r.user_index, []).append((r.product_index, round(r.predicted_rating, 9)))
    return out


def test_search_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    users = np.concatenate([rng.normal(size=(90, 6)), np.zeros((1, 6)), -np.ones((2, 6))])
    items = np.concatenate([rng.normal(size=(150, 6)), np.abs(rng.normal(size=(30, 6))) * 5, np.ones((5, 6)), np.zeros((2, 6))])
    for k, block in ((10, 16), (3, 64), (500, 1024)):
        found, report = search(*factor_tables(spark, users, items), k, block)
        assert lists_of(found) == plain_search(users, items, k)
        total = -(-len(items) // block)
        assert all(r.visited + r.skipped == total for r in report.collect())


def test_search_skips_short_products(spark):
    rng = np.random.default_rng(6)
    users = np.abs(rng.normal(size=(200, 4))) + 0.5
    items = np.abs(rng.normal(size=(400, 4))) * np.geomspace(50, 0.01, 400)[:, None]
    found, report = search(*factor_tables(spark, users, items), 5, 16)
    assert lists_of(found) == plain_search(users, items, 5)
    skipped, visited = report.agg(F.sum("skipped"), F.sum("visited")).first()
    assert skipped > 3 * visited
    assert sum(r.n_users for r in report.collect()) == 200


def test_search_without_rows(spark):
    users, items = factor_tables(spark, np.ones((3, 2)), np.ones((2, 2)))
    assert top_products(users, items.limit(0)).count() == 0
    assert top_products(users.limit(0), items).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    made = [(u, p, float(rng.choice([0.1, 0.3, 0.5]))) for u in range(40) for p in range(25) if rng.random() < 0.4]
    ratings = spark.createDataFrame(made + made[:20], "user_index int, product_index int, rating float")
    users = spark.createDataFrame([(u, 1000 + u) for u in range(40)], "user_index long, user_id long")
    products = spark.createDataFrame([(p, 2000 + p) for p in range(25)], "product_index long, product_id long")
    return fit_als(ratings, rank=5, blocks=2), ratings.cache(), users, products


def test_lists_are_those_of_the_model(spark, model):
    als, _, users, products = model
    ours = recommend_from_model(als, users, products, 6)
    assert "CartesianProduct" not in plan_of(ours) and "BroadcastNestedLoop" not in plan_of(ours)
    theirs = {
        r.user_index + 1000: [(p.product_index + 2000, p.rating) for p in r.recommendations]
        for r in als.recommendForAllUsers(6).collect()
    }
    found = {}
    for r in sorted(ours.collect(), key=lambda r: (r.user_id, -r.predicted_rating)):
        found.setdefault(r.user_id, []).append((r.product_id, r.predicted_rating))
    assert found.keys() == theirs.keys()
    for user, own in found.items():
        assert [p for p, _ in own] == [p for p, _ in theirs[user]]
        assert np.allclose([s for _, s in own], [s for _, s in theirs[user]], atol=1e-5)
    one = spark.createDataFrame([(1003,), (1003,), (5,)], "user_id long")
    assert {r.user_id for r in recommend_from_model(als, users, products, 6, only=one).collect()} == {1003}


def test_list_report_sees_wrong_lists(spark, model):
    als, ratings, users, products = model
    lists = recommend_from_model(als, users, products, 6)
    assert all(r.consistent and r.n_products == 6 for r in list_report(als, lists, ratings, users, products).collect())
    off = lists.withColumn("predicted_rating", F.col("predicted_rating") + 0.01)
    assert not any(r.consistent for r in list_report(als, off, ratings, users, products).collect())
    worst = als.userFactors.select(F.col("id").cast("long").alias("user_index")).join(users, "user_index")
    low = lists.groupBy("user_id").agg(F.min_by("product_id", "predicted_rating").alias("product_id"), F.min("predicted_rating").alias("predicted_rating"))
    missed = list_report(als, low, ratings, users, products)
    assert missed.where(~F.col("consistent")).count() > 0 and worst.count() == 40


def test_normal_equations_hold_for_the_fit_and_not_for_another(spark, model):
    als, ratings, _, _ = model
    solved = normal_equations(als, ratings, 0.01)
    assert solved.count() == ratings.select("user_index").distinct().count()
    assert solved.agg(F.max("residual")).first()[0] < 1e-3
    assert solved.agg(F.sum("n_ratings")).first()[0] == ratings.count()
    assert normal_equations(als, ratings, 0.5).agg(F.min("residual")).first()[0] > 1e-3
    changed = ratings.withColumn("rating", F.col("rating") * 2)
    assert normal_equations(als, changed, 0.01).agg(F.min("residual")).first()[0] > 0.1


def test_folds_are_disjoint_and_complete(spark, model):
    _, ratings, _, _ = model
    dealt = folds_of(ratings)
    assert sorted(r.fold for r in dealt.select("fold").distinct().collect()) == [0, 1, 2]
    assert dealt.groupBy("user_index", "product_index", "rating").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    metrics = {r.fold: r for r in fold_metrics(ratings, rank=5, blocks=2).collect()}
    assert sum(r.n_test for r in metrics.values()) == ratings.count()
    for fold, r in metrics.items():
        train, test = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        assert (r.n_train, r.n_test) == (train.count(), test.count())
        scores = ALS(
            userCol="user_index", itemCol="product_index", ratingCol="rating", rank=5, regParam=0.01, seed=42, coldStartStrategy="drop",
            numUserBlocks=2, numItemBlocks=2,
        ).fit(train).transform(test)
        rmse = scores.select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)))).first()[0]
        assert abs(rmse - r.rmse) < 1e-4 and r.train_rmse < r.mean_rmse
