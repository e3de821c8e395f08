from datetime import datetime, timedelta

import pytest

from cartwise.operators.popularity import (
    count_by_type,
    diversified_items,
    first_source_wins,
    popular_items,
    popularity_scores,
    recent,
    seeded_sample,
    trending_and_popular,
    trending_items,
    trending_scores,
    union_lists,
)
from cartwise.schema import KEYED_EVENTS
from tests.helpers import events, rows

RANKED = "product_id long, score long, source string"
LOG = [(1, "view", 5), (1, "cart", 5), (2, "purchase", 5), (2, "purchase", 6), (3, "signup", 7), (3, None, 8), (3, "view", None)]


def test_counts_skip_null_type_and_product(spark):
    assert rows(count_by_type(events(spark, LOG))) == [(5, 1, 1, 1), (6, 0, 0, 1), (7, 0, 0, 0)]


def test_scores_and_ties(spark):
    log = events(spark, LOG + [(9, "view", 4), (9, "cart", 4)])
    popular, trending = popularity_scores(log, 3), trending_scores(log, top_n=3)
    assert [tuple(r) for r in popular.collect()] == [(5, 6), (4, 3), (6, 3)]
    assert [tuple(r) for r in trending.collect()] == [(5, 6), (4, 3), (6, 3)]


def test_recent_window_includes_its_bound(spark):
    newest = datetime(2024, 1, 10)
    edge = newest - timedelta(days=7)
    times = [newest, edge, edge - timedelta(microseconds=1)]
    data = [(i, t, "view", i, 1, "c", "b", 1.0, 1, "s") for i, t in enumerate(times)]
    log = spark.createDataFrame(data, KEYED_EVENTS)
    assert [r.event_id for r in recent(log, 7).orderBy("event_id").collect()] == [0, 1]
    assert recent(log, 7, as_of="2024-01-10 00:00:01").count() == 1
    assert recent(log, 7, as_of=None).count() == 0
    assert recent(log, None).count() == 3
    assert rows(trending_scores(log)) == [(0, 1), (1, 1)]


def test_popular_is_all_purchased_unless_cut(spark):
    log = events(spark, LOG + [(1, "purchase", 5)])
    assert rows(popular_items(log)) == [(5, 2, "popular"), (6, 1, "popular")]
    assert rows(popular_items(log, 1)) == [(5, 2, "popular")]


def test_trending_keeps_products_without_weight(spark):
    assert rows(trending_items(events(spark, LOG), days=None)) == [
        (5, 6, "trending"), (6, 3, "trending"), (7, 0, "trending"), (8, 0, "trending"),
    ]
    assert rows(trending_items(events(spark, LOG), 1, days=None)) == [(5, 6, "trending")]


def test_both_lists_add_up(spark):
    got = rows(trending_and_popular(events(spark, LOG), days=None))
    assert got == [(5, 7, "both"), (6, 4, "both"), (7, 0, "trending"), (8, 0, "trending")]


def test_union_keeps_repeats_and_first_source_wins(spark):
    a = spark.createDataFrame([(1, 9, "trending"), (2, 8, "trending")], RANKED)
    b = spark.createDataFrame([(2, 50, "popular"), (3, 1, "popular")], RANKED)
    assert union_lists(a, b).count() == 4
    assert rows(first_source_wins(a, b)) == [(1, 9, "trending"), (2, 8, "trending"), (3, 1, "popular")]


@pytest.mark.parametrize("n,expected", [(3, 3), (50, 10)])
def test_sample_takes_what_exists_and_repeats(spark, n, expected):
    df = spark.createDataFrame([(i, 1, "popular") for i in range(10)], RANKED)
    got = rows(seeded_sample(df, n))
    assert len(got) == expected and got == rows(seeded_sample(df.repartition(5), n))


def test_sample_follows_the_seed(spark):
    df = spark.createDataFrame([(i, 1, "popular") for i in range(100)], RANKED)
    assert rows(seeded_sample(df, 5, 1)) != rows(seeded_sample(df, 5, 2))


def test_diversified_has_no_repeats(spark):
    got = rows(diversified_items(events(spark, LOG), 2, days=None))
    assert got == [(5, 6, "trending"), (6, 3, "trending")]


def test_newest_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, LOG).write.parquet(path)
    plan = trending_scores(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_time" in plan
    assert "struct<event_time:timestamp,event_type:string,product_id:bigint>" in plan
