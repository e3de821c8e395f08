import json

from pyspark.sql import functions as F

from cartwise import session
from cartwise.operators.history import user_history, user_tiers
from cartwise.operators.hybrid import recommendations_for
from cartwise.operators.metadata import add_metadata, latest_metadata, metadata_variants
from cartwise.operators.popularity import popular_items, trending_items
from cartwise.plans import serving
from cartwise.plans.serving import as_json, recommend_all_users, recommend_anonymous
from tests.helpers import events, rows

SCORED = "user_id long, product_id long, final_score double"


def _log(spark):
    """User 10 has no events, 11 has 1, 15 has 5, 16 has 6."""
    mine = [(u, "view", 100 + i) for u, n in ((11, 1), (15, 5), (16, 6)) for i in range(n)]
    bought = [(99, "purchase", p) for p in range(1, 21) for _ in range(p)]
    return events(spark, mine + bought)


def _users(spark):
    return spark.createDataFrame([(u,) for u in (10, 11, 15, 16)], "user_id long")


def test_tiers(spark):
    assert rows(user_tiers(_log(spark), _users(spark))) == [
        (10, 0, "new"), (11, 1, "cold_start"), (15, 5, "cold_start"), (16, 6, "warm"),
    ]


def test_history_of_requested_users(spark):
    got = user_history(_log(spark), spark.createDataFrame([(11,), (15,), (15,)], "user_id long"))
    assert sorted(r.user_id for r in got.collect()) == [11] + [15] * 5


def test_each_tier_gets_its_mix(spark):
    log = _log(spark)
    scored = spark.createDataFrame([(u, p, p / 100) for u in (11, 15, 16) for p in range(10, 25)], SCORED)
    lists = recommend_all_users(
        _users(spark), log, scored, trending_items(log, 10, days=None), popular_items(log), latest_metadata(log)
    )
    by_user = {}
    for r in lists.collect():
        by_user.setdefault(r.user_id, []).append(r)
    assert set(by_user) == {10, 11, 15, 16}
    for got in by_user.values():
        assert len({r.product_id for r in got}) == len(got) <= 10
        assert all((r.final_score is None) == (r.source is not None) for r in got)
    assert {r.source for r in by_user[10]} <= {"trending", "popular"}
    assert sum(r.source == "trending" for r in by_user[10]) == 5
    for user in (11, 15):
        assert sum(r.final_score is not None for r in by_user[user]) == 4
        assert {r.tier for r in by_user[user]} == {"cold_start"}
    assert sorted(r.product_id for r in by_user[16]) == list(range(15, 25))
    # Products 21-24 never occur in the events, so their metadata is unknown.
    assert {r.brand for r in by_user[16] if r.product_id > 20} == {"Unknown"}

    answers = {r.user_id: json.loads(r.recommendations) for r in as_json(lists).collect()}
    assert [item["product_id"] for item in answers[16]] == list(range(24, 14, -1))
    assert "score" not in answers[16][0] and set(answers[10][0]) >= {"score", "source", "price"}
    assert "final_score" in answers[11][0] and answers[11][4]["source"] == "trending"


def test_lists_meet_the_metadata_in_one_join(spark):
    log = _log(spark).withColumn("price", F.col("event_id") / 4.0)
    scored = spark.createDataFrame([(u, p, p / 100) for u in (11, 15, 16) for p in range(10, 25)], SCORED)
    inputs = (_users(spark), log, scored, trending_items(log, 10, days=None), popular_items(log))
    lists = recommend_all_users(*inputs, latest_metadata(log))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    every = recommend_all_users(*inputs, metadata_variants(log))
    variants = {r.product_id: r.n for r in metadata_variants(log).groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = {(r.user_id, r.product_id): r.n for r in every.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counted == {(r.user_id, r.product_id): variants.get(r.product_id, 1) for r in lists.collect()}
    assert max(counted.values()) > 10


def test_folded_variants_equal_the_grouped_rows(spark):
    log = _log(spark).withColumn("price", F.col("event_id") / 4.0)
    log = log.withColumn("brand", F.when(F.col("event_id") % 3 != 0, F.concat("brand", (F.col("event_id") % 5).cast("string"))))
    scored = spark.createDataFrame([(u, p, p / 100) for u in (11, 15, 16) for p in range(10, 25)], SCORED)
    inputs = (_users(spark), log, scored, trending_items(log, 10, days=None), popular_items(log), metadata_variants(log))
    folded = recommend_all_users(*inputs, folded=True)
    assert folded.count() == folded.select("user_id", "product_id").distinct().count()
    names = ["user_id", "tier", "product_id", "n_variants", "n_brands", "max_price"]
    grouped = recommend_all_users(*inputs).groupBy("user_id", "tier", "product_id").agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_distinct("brand").alias("n_brands"), F.max("price").alias("max_price")
    )
    assert {r.n_variants for r in folded.collect()} > {1}
    assert rows(folded.select(names)) == rows(grouped.select(names))


def test_scores_of_users_are_ranked_in_tasks_of_a_size(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    log, tasks = _log(spark), []
    scored = spark.createDataFrame([(u, p, p / 100) for u in range(10, 60) for p in range(10, 25)], SCORED)

    def counting(scored, *args):
        tasks.append(scored.rdd.getNumPartitions())
        return recommendations_for(scored, *args)

    monkeypatch.setattr(serving, "recommendations_for", counting)
    lists = recommend_all_users(
        _users(spark), log, scored, trending_items(log, 10, days=None), popular_items(log), latest_metadata(log)
    )
    assert sorted(r.product_id for r in lists.where("user_id = 16").collect()) == list(range(15, 25))
    assert tasks == [15]


def test_variants_fan_out_and_latest_does_not(spark):
    log = events(spark, [(1, "view", 5), (1, "view", 5), (2, "view", 5)])
    log = log.withColumn("price", F.col("event_id") / 2.0)
    items = spark.createDataFrame([(5, 1), (6, 2)], "product_id long, score long")
    assert add_metadata(items, metadata_variants(log)).where("product_id = 5").count() == 3
    latest = rows(add_metadata(items, latest_metadata(log)))
    assert latest == [(5, 1, "home.item5", "acme", 1.0), (6, 2, "Unknown", "Unknown", None)]


def test_anonymous_list_with_and_without_metadata(spark):
    log = _log(spark)
    plain = recommend_anonymous(log, as_of="2024-02-01 00:00:00")
    assert plain.columns == ["product_id", "score", "source"] and 5 <= plain.count() <= 10
    rich = recommend_anonymous(log, latest_metadata(log), as_of="2024-02-01 00:00:00")
    assert rich.count() == plain.count() and "brand" in rich.columns
