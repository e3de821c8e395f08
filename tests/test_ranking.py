import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwise.operators.hybrid import best_first, recommendations_for, top_per_user
from cartwise.operators.ranking import (
    best_per_key,
    dedupe_across_users,
    first_by_priority,
    number_rows,
    top_k,
)
from cartwise.operators.ratings import dense_index
from tests.helpers import rows

SCORED = "user_id long, product_id long, final_score double"


def test_numbers_match_a_plain_sort_when_one_group_is_most_of_the_table(spark):
    rng = random.Random(1)
    data = [(1 if i % 3 else rng.randrange(50), i, rng.randrange(20) / 10) for i in range(3000)]
    df = spark.createDataFrame(data, SCORED).repartition(7)
    groups = defaultdict(list)
    for user, product, score in data:
        groups[user].append((-score, product))
    expected = sorted(
        (user, product, -score, at)
        for user, items in groups.items()
        for at, (score, product) in enumerate(sorted(items), 1)
    )
    assert rows(number_rows(df, best_first(), per=["user_id"])) == expected


def test_numbering_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(50)], SCORED)
    assert sorted(r["rank"] for r in number_rows(df, best_first(), per=["user_id"]).collect()) == list(range(1, 51))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=200))
def test_dense_index_is_a_bijection_in_key_order(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "user_id long").repartition(6)
    got = rows(dense_index(df, "user_id", "user_index"))
    assert got == [(k, i) for i, k in enumerate(sorted(set(keys)))]


def test_top_k_ties_short_groups_and_overall(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 3, 0.9), (2, 9, 0.1)], SCORED)
    assert rows(top_k(df, 2, best_first(), ["user_id"])) == [(1, 3, 0.9), (1, 4, 0.5), (2, 9, 0.1)]
    assert rows(top_k(df, 2, best_first())) == [(1, 3, 0.9), (1, 4, 0.5)]


def test_top_k_cuts_groups_before_the_shuffle(spark):
    columns = [(F.col("id") % 2).alias("user_id"), F.col("id").alias("product_id"), F.rand().alias("final_score")]
    df = spark.range(100).select(*columns)
    plan = top_k(df, 3, best_first(), ["user_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_missing_scores_are_ignored(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, float("nan")), (1, 3, 0.2), (1, 3, 0.4), (2, 1, None)], SCORED)
    assert rows(recommendations_for(df)) == [(1, 3, 0.4)]
    assert rows(recommendations_for(df, spark.createDataFrame([(2,)], "user_id long"))) == []


def test_across_user_dedupe_takes_one_of_two_equal_rows(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.5), (2, 8, 0.5)], SCORED)
    assert rows(dedupe_across_users(df)) == [(1, 7, 0.5), (2, 8, 0.5)]
    assert rows(top_per_user(df)) == [(1, 7, 0.5), (2, 7, 0.5), (2, 8, 0.5)]
    assert rows(top_per_user(df, across_users=True)) == [(1, 7, 0.5), (2, 8, 0.5)]


def test_best_per_key_and_priority(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 7, 0.9)], SCORED)
    assert rows(best_per_key(df, ["user_id", "product_id"], "final_score")) == [(1, 7, 0.9)]
    tagged = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", 3.0)], "k long, p int, v string, x double")
    assert rows(first_by_priority(tagged, ["k"], "p")) == [(1, 0, "a", 3.0)]
