from datetime import datetime

from cartwise.operators.cleaning import distinct_rows, drop_incomplete, fill_missing, first_rows, training_rows
from cartwise.schema import EVENTS

FULL = (datetime(2024, 1, 1), "view", 7, 3, "a.b", "acme", 2.5, 9, "s")
FILL = {2: 0, 3: 0, 4: "", 5: "", 6: 0.0, 7: 0, 8: ""}


def _with_null(at):
    return tuple(None if i == at else v for i, v in enumerate(FULL))


def test_fill_replaces_each_null_and_leaves_time_and_type(spark):
    for at in range(len(FULL)):
        got = tuple(fill_missing(spark.createDataFrame([_with_null(at)], EVENTS)).first())
        assert got == tuple(FILL.get(i) if i == at else v for i, v in enumerate(FULL))


def test_drop_any_and_subset(spark):
    df = spark.createDataFrame([FULL] + [_with_null(at) for at in range(len(FULL))], EVENTS)
    assert drop_incomplete(df).count() == 1
    assert drop_incomplete(df, ["category_code", "brand"]).count() == len(FULL) + 1 - 2


def test_blank_after_fill_is_not_dropped(spark):
    df = fill_missing(spark.createDataFrame([_with_null(4), _with_null(5)], EVENTS))
    assert drop_incomplete(df, ["category_code", "brand"]).count() == 2


def test_duplicates_and_cap(spark):
    df = spark.createDataFrame([FULL, FULL, _with_null(0)], EVENTS)
    assert distinct_rows(df).count() == 2
    assert training_rows(df).count() == 1
    numbered = spark.createDataFrame([(i % 7, i) for i in range(20)], "a int, event_id long")
    assert sorted(r.event_id for r in first_rows(numbered, 5, ["event_id"]).collect()) == [0, 1, 2, 3, 4]
    assert first_rows(numbered, 50, ["event_id"]).count() == 20
