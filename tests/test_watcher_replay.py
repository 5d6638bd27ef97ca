import datetime

from pyspark.sql import functions as F

from notespark.plans import reports_feeds


def _folder(tmp_path, spark, rows):
    start = datetime.datetime(2024, 1, 1)
    events = [(k, start + datetime.timedelta(seconds=s), user, kind, 1.0, "{}") for k, (s, user, kind) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    return str(tmp_path)


def _applied(spark, folder):
    rows = reports_feeds.watcher_replay(spark, folder).select("path", "event_type", (F.col("ts") / 1_000_000).cast("long").alias("s"))
    return sorted((r["path"], r["event_type"], r["s"] - int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()))
                  for r in rows.collect())


def test_the_last_period_closes_before_the_empty_batch_where_views_end_the_log(spark, tmp_path):
    folder = _folder(tmp_path, spark, [(0, 1, "click"), (10, 2, "click"), (500, 1, "click"), (900, 3, "view"), (1000, 3, "view")])
    assert _applied(spark, folder) == [
        ("notes/user-1.md", "modified", 0), ("notes/user-1.md", "modified", 500), ("notes/user-2.md", "modified", 10)]


def test_a_batch_that_closes_nothing_applies_nothing(spark, tmp_path):
    folder = _folder(tmp_path, spark, [(k, k % 3, "click") for k in range(0, 100, 5)])
    assert len(_applied(spark, folder)) == 3


def test_without_events_on_notes_nothing_is_applied(spark, tmp_path):
    assert _applied(spark, _folder(tmp_path / "views", spark, [(k, 1, "view") for k in range(5)])) == []
    assert _applied(spark, _folder(tmp_path / "none", spark, [])) == []
