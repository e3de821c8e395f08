import pytest
from pyspark.sql import functions as F

from cartwise.operators.popularity import popularity_scores
from cartwise.schema import EVENT_COLUMNS, EVENTS, KEYED_EVENTS
from cartwise.sources import messages
from cartwise.streaming.ingest import append_stream, dead_letters, decode, drop_repeats, good_events, ingest
from cartwise.sources.tables import folders
from cartwise.streaming.dedupe import dedupe_stream, read_deduped, read_late
from cartwise.streaming.popularity import (
    daily_scores,
    day_folder,
    product_bucket,
    read_snapshot,
    running_scores,
    snapshot_stream,
)
from tests.helpers import events, rows

GOOD = '{"event_time":"2024-01-01 10:00:00 UTC","event_type":" view ","product_id":%s,"price":%s,"user_id":3,"extra":1}'


def _decode(spark, *values):
    return decode(spark.createDataFrame([(v,) for v in values], "value string"))


def test_good_message_is_trimmed_and_missing_fields_filled(spark):
    row = good_events(_decode(spark, GOOD % ('"12"', '"1.5"'))).first()
    assert row.event_type == "view" and row.product_id == 12 and row.price == 1.5
    assert row.category_id == 0 and row.brand is None
    assert good_events(_decode(spark, '{"user_id": 1}')).first().price == 0.0
    assert good_events(_decode(spark, GOOD % ("12.0", "1e2"))).first().product_id == 12


@pytest.mark.parametrize(
    "value,reason",
    [
        ("not json", "not_an_object"),
        ("[1,2]", "not_an_object"),
        ("5", "not_an_object"),
        ("", "not_an_object"),
        (None, "not_an_object"),
        (GOOD % (1, "null"), "null_price"),
        (GOOD % (1, '"abc"'), "bad_price"),
        (GOOD % (1, '"1.5d"'), "bad_price"),
        (GOOD % ('"x"', 1), "bad_product_id"),
        ('{"event_time":"soon"}', "bad_event_time"),
    ],
)
def test_bad_messages_are_kept_with_a_reason(spark, value, reason):
    decoded = _decode(spark, value)
    assert rows(dead_letters(decoded)) == [(value, reason)]
    assert good_events(decoded).count() == 0


def _send(df, path):
    messages.to_messages(df).write.mode("append").text(path)


def _log(spark):
    return events(spark, [(u, k, p) for u in range(3) for k in ("view", "cart", "purchase") for p in (5, 6)])


def test_restart_appends_only_what_is_new(spark, tmp_path):
    log = _log(spark).withColumn("event_time", F.col("event_time").cast("string"))
    base = str(tmp_path)
    for part in (log.where("event_id < 7"), log.where("event_id >= 7")):
        _send(part, f"{base}/in")
        streams = ingest(
            messages.read_message_files(spark, f"{base}/in"),
            f"{base}/events", f"{base}/dead", f"{base}/state", KEYED_EVENTS, available_now=True,
        )
        for stream in streams:
            stream.awaitTermination()
    assert rows(spark.read.parquet(f"{base}/events").select(KEYED_EVENTS.names)) == rows(_log(spark))
    assert spark.read.schema("value string, reason string").parquet(f"{base}/dead").count() == 0


def test_repeats_across_batches_are_dropped(spark, tmp_path):
    log = _log(spark).withColumn("event_time", F.col("event_time").cast("string"))
    base = str(tmp_path)
    for _ in range(2):
        _send(log, f"{base}/in")
        decoded = decode(messages.read_message_files(spark, f"{base}/in", 1), KEYED_EVENTS)
        unique = drop_repeats(good_events(decoded, KEYED_EVENTS), "10 days", ["event_id"])
        append_stream(unique, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == _log(spark).count()


TABLES = (
    ("total", running_scores, ["product_id"], lambda: product_bucket(4)),
    ("daily", daily_scores, ["day_start", "product_id"], day_folder),
)


def _advance(spark, base, part, tables=TABLES):
    _send(part.withColumn("event_time", F.col("event_time").cast("string")), f"{base}/in")
    for name, table, keys, folder in tables:
        decoded = decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
        scores = table(good_events(decoded, KEYED_EVENTS))
        stream = snapshot_stream(scores, f"{base}/{name}", f"{base}/{name}-state", keys, folder(), True)
        stream.awaitTermination()
        yield name, stream


def test_running_scores_equal_the_batch_after_every_restart(spark, tmp_path):
    log, base = _log(spark), str(tmp_path)
    for upto in (7, 12, 1000):
        arriving = log.where(f"event_id < {upto} AND event_id >= {dict([(7, 0), (12, 7), (1000, 12)])[upto]}")
        list(_advance(spark, base, arriving))
        batch = popularity_scores(log.where(f"event_id < {upto}"), top_n=None)
        assert rows(read_snapshot(spark, f"{base}/total")) == rows(batch)
        daily = read_snapshot(spark, f"{base}/daily").groupBy("product_id").agg(F.sum("trend_score"))
        assert rows(daily) == rows(batch)
    for part in range(4):  # the newest version and the one before
        assert len(folders(spark, f"{base}/total/version=*/part={part}")) <= 2


def test_only_changed_parts_are_written_and_closed_days_leave_the_state(spark, tmp_path):
    base = str(tmp_path)
    days = [events(spark, [(1, "cart", 5, 24 * d), (2, "view", 6, 24 * d + 1)]) for d in range(12)]
    state = []
    for day in days:
        for _, stream in _advance(spark, base, day, TABLES[1:]):
            state.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(state[4:]) <= 6  # two products on the open days, however many days have passed
    assert read_snapshot(spark, f"{base}/daily").count() == 24
    assert len(folders(spark, f"{base}/daily/version=*/part=2024-01-03")) == 1  # written once, never again


def test_a_repeated_trigger_gives_the_same_snapshot(spark, tmp_path):
    from cartwise.streaming.popularity import merge_batch

    path = str(tmp_path / "s")
    table = "product_id long, score long"
    for batch_id, made in ((0, [(1, 5), (2, 6)]), (1, [(1, 9)]), (1, [(1, 9)]), (2, [(3, 1)]), (2, [(3, 1)])):
        merge_batch(spark.createDataFrame(made, table), batch_id, path, ["product_id"], product_bucket(1))
    assert rows(read_snapshot(spark, path)) == [(1, 9), (2, 6), (3, 1)]


def _deduped(spark, base, arriving, keys=None):
    """One trigger for each table that arrives."""
    for part in arriving:
        _send(part.withColumn("event_time", F.col("event_time").cast("string")), f"{base}/in")
        decoded = decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
        stream = dedupe_stream(good_events(decoded, KEYED_EVENTS), f"{base}/out", f"{base}/state", "1 day", keys, True)
        stream.awaitTermination()
    return read_deduped(spark, f"{base}/out", KEYED_EVENTS), read_late(spark, f"{base}/out", KEYED_EVENTS)


def test_late_rows_are_kept_with_a_reason(spark, tmp_path):
    first = events(spark, [(1, "view", 5, 0), (1, "view", 6, 30), (1, "view", 7, 50), (1, "view", 7, 50)])
    again = events(spark, [(1, "view", 5, 0), (1, "view", 6, 30), (1, "view", 7, 26), (9, "cart", 9, 25), (2, "view", 8, 80)])
    untimed = again.where("event_id = 4").withColumn("event_time", F.lit(None).cast("timestamp"))
    unique, late = _deduped(spark, str(tmp_path), [first.union(first), again, untimed, untimed])
    assert sorted(r.event_id for r in unique.collect()) == [0, 1, 2, 2, 3, 4, 4]  # 4 with a time and without, each once
    # Newest so far: hour 50; what is older than hour 26 is late. Hour 26 itself repeats nothing.
    assert sorted((r.event_id, r.product_id, r.reason) for r in late.collect()) == [(0, 5, "late"), (3, 9, "late")]
    assert {(r.event_id, r.product_id) for r in unique.collect()} >= {(2, 7), (1, 6)}


def test_earliest_of_equal_keys_in_a_trigger_stays(spark, tmp_path):
    made = events(spark, [(1, "view", 5, 7), (1, "view", 5, 3), (2, "view", 5, 4)])
    later = events(spark, [(1, "cart", 8, 9)])
    unique, late = _deduped(spark, str(tmp_path), [made, later], keys=["user_id"])
    assert sorted((r.user_id, r.event_id) for r in unique.collect()) == [(1, 1), (2, 2)]
    assert late.count() == 0


def test_json_round_trip_and_schema(spark):
    log = _log(spark).withColumn("event_time", F.col("event_time").cast("string"))
    back = good_events(decode(messages.to_messages(log)))
    assert back.schema.names == EVENT_COLUMNS and back.schema.simpleString() == EVENTS.simpleString()
    assert rows(back) == rows(_log(spark).select(EVENT_COLUMNS))
    assert '"price":null' in messages.to_messages(log.withColumn("price", F.lit(None)), keep_nulls=True).first().value
