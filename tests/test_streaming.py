"""Streams in several triggers against the same rows in one, and state that outlasts a trigger."""

from tidemark.operators import snapshots
from tidemark.streaming import alerts


def streamed(spark, folder, parts, schema):
    """A stream that takes one file a trigger, in the order of parts."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_cooldown_keeps_its_clock_over_triggers(spark, tmp_path):
    parts = [[("a", 0), ("a", 300), ("b", 5)], [("a", 600), ("a", 720), ("a", None), (None, 9)], [("a", 1260), ("a", 1140), ("a", 1260), ("b", 604)]]
    stream = streamed(spark, tmp_path / "in", parts, "code string, at long")
    found = sorted(map(tuple, alerts.drained(alerts.cooldown(stream)).collect()))
    assert found == [("a", 0), ("a", 600), ("a", 1260), ("b", 5)]
    whole = spark.createDataFrame([r for p in parts for r in p], "code string, at long").selectExpr("code", "timestamp_seconds(at) as at")
    assert sorted(map(tuple, snapshots.cooldown(whole, "code", "at").collect())) == found


def test_rates_against_the_snapshot_before(spark, tmp_path):
    parts = [[(1, 0, "x", 5), (1, 0, "y", 1), (2, 0, "x", 0)], [(1, 10, "x", 25), (1, 0, "x", 99), (1, 10, "z", 3)], [(1, 30, "x", 5), (1, 30, "z", 4), (1, 30, "y", 9), (2, 4, "x", 1), (None, 4, "x", 1)]]
    stream = streamed(spark, tmp_path / "in", parts, "profile long, snap_at long, metric string, counter long")
    found = sorted(map(tuple, alerts.drained(alerts.rates(stream)).collect()))
    assert found == [(1, "x", 10, 2.0), (1, "z", 30, 0.05), (2, "x", 4, 0.25)]


def test_no_rows_no_alerts(spark):
    empty = spark.createDataFrame([], "code string, at long")
    assert alerts.drained(alerts.cooldown(alerts.arrivals(empty))).count() == 0
