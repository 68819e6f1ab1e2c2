import datetime

from palimpsest.sources import record
from palimpsest.streaming import poll


def entries(spark, rows, folder):
    df = spark.createDataFrame([(i, datetime.datetime(*at), u, k) for i, at, u, k in rows], "event_id long, ts timestamp, user_id long, event_type string")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_a_poll_goes_on_after_a_restart(spark, tmp_path):
    feed, base = str(tmp_path / "feed"), f"file://{tmp_path}/poll"
    entries(spark, [(1, (2024, 1, 1), 7, "a"), (2, (2024, 1, 2), 7, "a"), (2, (2024, 1, 2), 7, "a"), (3, (2024, 1, 3), 8, "b")], feed)
    assert {(r.user_id, r.event_id, r.n_entries) for r in poll.polled(spark, feed, base).collect()} == {(7, 1, 2), (8, 3, 1)}
    again = {(r.user_id, r.event_id, r.n_entries) for r in poll.polled(spark, feed, base).collect()}
    assert again == {(7, 1, 2), (8, 3, 1)}  # nothing new: nothing counted twice
    entries(spark, [(2, (2024, 1, 2), 7, "a"), (4, (2024, 1, 20), 7, "a")], feed)  # a repeat, and a new one
    assert {(r.user_id, r.event_id, r.n_entries) for r in poll.polled(spark, feed, base).collect()} == {(7, 1, 3), (8, 3, 1)}
    entries(spark, [(5, (2025, 1, 10), 9, "c")], feed)  # 8 was last seen more than 365 days before
    assert {r.user_id for r in poll.polled(spark, feed, base).collect()} == {7, 9}


def test_one_event_is_replaced_and_others_stay(spark, tmp_path):
    path = f"file://{tmp_path}/record"

    def event(version, kind):
        rows = [("1.3", "eu", "A/1", "v0", version, None, [], [("AR 1", kind, None, "x", None, [], [("AN I", 1, "k", 1, "added", False)])])]
        return spark.createDataFrame(rows, record.EVENT_SCHEMA)

    for version, kind in (("v1", "inserted"), ("v2", "inserted"), ("v1", "modified")):
        record.write_events(event(version, kind), path)
    found = {(r.event_key, r.change_type, r.table_entries[0].key) for r in record.event_changes(record.read_events(spark, path)).collect()}
    assert found == {("eu/A/1@v1", "modified", "k"), ("eu/A/1@v2", "inserted", "k")}
