from pyspark.sql import functions as F

from cartwise import session
from cartwise.operators import ratings
from tests.helpers import rows
from workload import views


def _per_task(df):
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return {r.part: r.n for r in parts.collect()}


def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    df = spark.range(2000).select((F.col("id") % 40).alias("user_id"), (F.col("id") % 900).alias("product_id"), "id")
    got = session.dealt(df, "user_id", "product_id")
    assert got.rdd.getNumPartitions() == 20 and max(_per_task(got).values()) < 300
    assert rows(got) == rows(df)
    assert session.dealt(df.limit(0), "user_id").count() == 0


def test_ratings_of_pairs_are_averaged_in_tasks_of_a_size(spark, monkeypatch):
    """However well the rows compress, they are not joined to a few large tasks."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    log = spark.range(3000).select(
        (F.col("id") % 300).alias("user_id"),
        (F.col("id") % 7).alias("product_id"),
        F.when(F.col("id") % 2 == 0, "view").otherwise("purchase").alias("event_type"),
    )
    got = views.cf_standin(log)
    assert len(_per_task(got)) > 15
    assert got.count() == 2100 and {r.predicted_rating for r in got.collect()} == {0.1, 0.5}


def test_order_lines_meet_their_orders_in_tasks_of_a_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(2000).select((F.col("id") % 500).alias("l_orderkey"), F.col("id").alias("l_partkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = views._order_lines(spark, str(tmp_path))
    assert got.count() == 1600 and got.where("l_orderkey <> o_orderkey").count() == 0
    assert len(_per_task(got)) > 10
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_folded_in_tasks_of_a_size_and_joined_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    log = spark.range(2000).select((F.col("id") % 50).alias("user_id"), (F.col("id") % 30).alias("product_id"), F.lit(0.5).alias("rating"))
    index = lambda key, name: log.select(key).distinct().select(key, F.col(key).alias(name))
    got = ratings.index_ratings(log, index("user_id", "user_index"), index("product_id", "product_index"), "sum")
    assert {tuple(r) for r in got.collect()} == {(k % 50, k % 30, 2000 // 150 * 0.5 + (0.5 if k < 2000 % 150 else 0)) for k in range(150)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in plan
