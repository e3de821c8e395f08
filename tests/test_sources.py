import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cartwise.schema import EVENT_COLUMNS, EVENTS
from cartwise.session import materialise, scratch_path, shared_root
from cartwise.sources import tables
from tests.helpers import events, rows

SCORED = "user_id long, product_id long, final_score double"


def test_csv_events_with_zone_suffix_bad_time_and_odd_text(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        ",".join(EVENT_COLUMNS)
        + '\n2019-10-01 00:00:00 UTC,view,1,2,a.b,"ac""me, inc",1.5,3,s1\nsoon,cart,,2,,,,3,s2\n'
    )
    df = tables.read_events(spark, str(path))
    assert df.schema == EVENTS
    first, second = df.orderBy("user_session").collect()
    assert first.brand == 'ac"me, inc' and first.event_time.isoformat() == "2019-10-01T00:00:00"
    assert second.event_time is None and second.product_id is None and second.price is None


def test_csv_and_parquet_round_trips(spark, tmp_path):
    log = events(spark, [(1, "view", 5), (2, "cart", None)]).withColumn("brand", F.lit('a "b", c'))
    back = tables.read_events(spark, tables.write_csv(log.drop("event_id"), str(tmp_path / "c")))
    assert rows(back.fillna(0)) == rows(log.drop("event_id").fillna(0))
    assert rows(tables.read_table(spark, tables.write_parquet(log, str(tmp_path / "p"))).fillna(0)) == rows(log.fillna(0))
    inferred = dict(tables.read_inferred_csv(spark, str(tmp_path / "c")).dtypes)
    assert inferred["price"] == "double" and inferred["event_time"] == "timestamp"


def test_recommendations_by_user_bucket(spark, tmp_path):
    path = str(tmp_path / "recs")
    recs = spark.createDataFrame([(u, p, u / 10) for u in range(40) for p in range(3)], SCORED)
    for buckets, files in ((8, 1), (5, 3)):
        tables.write_recommendations(recs, path, buckets, files)
        assert tables.buckets_of(spark, path) == buckets
        assert rows(tables.read_recommendations(spark, path)) == rows(recs)
        for user in range(40):  # no reader is told the number of buckets
            one = tables.read_user_recommendations(spark, path, user)
            assert rows(one.select("user_id", "product_id")) == [(user, p) for p in range(3)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_bucket" in plan
    assert tables.read_user_recommendations(spark, path, 99).count() == 0


def test_recommendations_of_a_request_table(spark, tmp_path):
    path = str(tmp_path / "recs")
    recs = spark.createDataFrame([(u, p, u / 10) for u in range(60) for p in range(2)], SCORED)
    tables.write_recommendations(recs, path, 16)
    asked = spark.createDataFrame([(3,), (3,), (17,), (999,), (None,)], "user_id int")
    found = tables.read_recommendations_of(spark, path, asked)
    assert rows(found) == rows(recs.where("user_id IN (3, 17)"))
    assert "PartitionFilters: [user_bucket" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(user_bucket#", "")
    assert len({r[0] for r in found.select(F.input_file_name()).distinct().collect()}) <= 2
    assert tables.read_recommendations_of(spark, path, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tables.buckets_of(spark, str(tmp_path / "nothing"))


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path / "nothing"))


def test_only_a_missing_path_is_absent(spark, tmp_path):
    assert tables.read_if_present(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):  # a folder without a table is a fault, not an absent table
        tables.read_if_present(spark, str(tmp_path / "empty"), "parquet")
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):
        tables.read_if_present(spark, str(tmp_path / "empty"), "no-such-format")
    tables.write_csv(spark.range(3), str(tmp_path / "t"))
    assert tables.read_if_present(spark, str(tmp_path / "t")).count() == 3


def test_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_root(spark))
    df = materialise(spark.range(3))
    assert df.count() == 3 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
