import random

from pyspark.sql import functions as F

from cartwise.operators.hybrid import hybrid_scores
from cartwise.plans.training import run_training_job, train
from cartwise.sources.tables import read_recommendations
from tests.helpers import events, rows


def _log(spark):
    rng = random.Random(4)
    kinds = ["view", "view", "cart", "purchase"]
    return events(spark, [(rng.randrange(30), rng.choice(kinds), rng.randrange(25)) for _ in range(900)])


def test_blend_fans_out_over_neighbours(spark):
    cf = spark.createDataFrame([(1, 5, 0.5), (1, 6, 1.0)], "user_id long, product_id long, predicted_rating double")
    content = spark.createDataFrame(
        [(5, 8, 0.3), (5, 9, 0.15)], "product_id long, recommended_product long, cbf_score double"
    )
    got = [(u, p, r, round(s, 9)) for u, p, r, _, s in hybrid_scores(cf, content).orderBy("final_score").collect()]
    assert got == [(1, 5, 9, 0.5), (1, 5, 8, 0.65), (1, 6, None, 0.7)]


def test_training_job_writes_whole_lists(spark, tmp_path):
    path, csv = str(tmp_path / "recs"), str(tmp_path / "csv")
    run_training_job(_log(spark), path, csv, blocks=2)
    recs = read_recommendations(spark, path)
    per_user = recs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("products")
    )
    assert per_user.count() == 30
    assert per_user.where("n > 10 or n <> products").count() == 0
    assert recs.where("final_score is null or isnan(final_score)").count() == 0
    assert rows(read_recommendations(spark, csv, "csv")) == rows(recs)


def test_training_reports_its_error(spark):
    result = train(_log(spark), k=3, cross_validate=True, aggregate="max", blocks=2)
    assert 0 < result.rmse.first().rmse < 1
    assert result.recommendations.groupBy("user_id").count().where("count > 3").count() == 0
