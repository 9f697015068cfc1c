"""The operational store and the collection of snapshots: defects, days, pruned reads, retention, poisoned profiles, restarts."""

import datetime
import os

from pyspark.sql import functions as F

from tidemark.sources.store import OperationalStore, newest
from tidemark.streaming.collection import KIND, Collection

UTC = datetime.timezone.utc
SCHEMA = "kind string, profile_id string, engine string, collected_at timestamp, data string, day string"


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 3, day, hour, minute, tzinfo=UTC)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_append_refuses_what_lacks_something(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/s")
    assert store.records().count() == 0 and store.days() == []
    rows = [("k", "p", None, at(1), "{}", "x"), ("k", "p", "e", at(1), "3", "x"), (" ", "p", "e", at(1), "{}", "x"), ("k", None, "e", at(1), "{}", "x"), ("k", "p", "e", None, "{}", "x"), ("k", "p", "e", at(1), None, "x"), ("k", "p", "e", at(1), '{"a":', "x"), ("k", "p", "e", at(1), "", "x"), ("k", "p", "e", at(2), '[1, "x"]', "x")]
    store.append(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.data for r in store.records().collect()) == ["3", '[1, "x"]', "{}"]
    assert sorted(r.defect for r in store.rejected().collect()) == ["collected_at", "data", "data", "data", "kind", "profile_id"]
    assert store.days() == ["20240301", "20240302"]
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.records().count() == 3


def test_a_batch_replaces_itself(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("k", "p", "e", at(1), "1", ""), ("k", "p", "e", at(2), "2", ""), ("", "p", "e", at(2), "2", "")], SCHEMA)
    for _ in range(3):
        store.append(rows, "b1")
    store.append(rows, "b2")
    assert store.records().count() == 4 and store.rejected().count() == 2


def test_reads_are_newest_first_and_pruned(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/s")
    rows = [("k" if i % 3 else "other", f"p{i % 2}", "e", at(1 + i // 10, i % 10), str(i), "") for i in range(60)]
    store.append(spark.createDataFrame(rows, SCHEMA))
    got = store.query("k", "p1", at(4, 5), 5)
    want = sorted((r for r in rows if r[0] == "k" and r[1] == "p1" and r[3] >= at(4, 5)), key=lambda r: -int(r[4]))[:5]
    assert [r.data for r in got.collect()] == [r[4] for r in want]
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    partition = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "day" in partition and "20240304" in partition
    many = spark.range(12_000).select(F.lit("k").alias("kind"), F.lit("p").alias("profile_id"), F.timestamp_seconds("id").alias("collected_at"), F.col("id").cast("string").alias("data"), F.lit("20240101").alias("day"))
    assert [newest(many, limit=n).count() for n in (0, -1, 10_001, 10_000, 3)] == [1000, 1000, 1000, 10_000, 3]


def test_days_are_utc_days(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("k", "p", "e", at(1, 23, 59), "1", ""), ("k", "p", "e", at(2, 0, 1), "2", ""), ("k", "old", "e", datetime.datetime(1969, 12, 31, 23, tzinfo=UTC), "3", "")], SCHEMA)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        store.append(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {(r.day, r.data) for r in store.records().collect()} == {("20240301", "1"), ("20240302", "2"), ("19691231", "3")}


def test_prune_drops_whole_days_and_touches_no_others(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([("k", "p", "e", at(d, h), f"{d}{h}", "") for d in range(1, 7) for h in (1, 23)], SCHEMA))
    os.makedirs(tmp_path / "s" / "day=odd")
    before = files(tmp_path / "s")
    assert store.prune(datetime.datetime(2024, 3, 4, 1, tzinfo=datetime.timezone(datetime.timedelta(hours=3)))) == 2  # still the 3rd in UTC
    assert store.days() == ["20240303", "20240304", "20240305", "20240306"]
    after = files(tmp_path / "s")
    assert after == {f: t for f, t in before.items() if f in after} and len(after) == 4
    assert store.prune(at(3, 12)) == 0 and store.prune(at(30)) == 4 and store.records().count() == 0


def _answer(row):
    if row["value"] is None or row["value"] != row["value"] or row["value"] < 0:
        raise RuntimeError("poisoned")
    return {"queries": row["value"], "commits": row["value"] / 2, "rollbacks": 4}


DUE = "profile_id string, engine string, collected_at timestamp, value double"


def test_a_poisoned_profile_stops_nobody_else(spark, tmp_path):
    def due(rows):
        spark.createDataFrame([(p, "e", t, v) for p, t, v in rows], DUE).coalesce(1).write.mode("append").parquet(str(tmp_path / "due"))
        return spark.readStream.schema(DUE).parquet(str(tmp_path / "due"))

    path = f"file://{tmp_path}/c"
    Collection(spark, path, _answer).drain(due([("a", at(1, 0, 0), 10.0), ("b", at(1, 0, 0), -1.0), ("c", at(1), 7.0), ("a", at(1, 0, 1), 70.0)]))
    # Another process goes on from the stored progress: a was collected before, b never, c falls, d is too early for a rate.
    again = Collection(spark, path, _answer)
    again.drain(due([("a", at(1, 0, 2), 100.0), ("b", at(1, 0, 2), 5.0), ("c", at(1, 0, 2), 1.0), ("a", at(1, 0, 2), -1.0)]))
    again.drain(spark.readStream.schema(DUE).parquet(str(tmp_path / "due")))  # nothing new
    got = {(r.profile_id, r.collected_at.strftime("%M"), r.status): (r.rates, r.error) for r in again.results().collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("a", "00", "partial"): None,
        ("c", "00", "partial"): None,
        ("b", "00", "error"): None,
        ("a", "01", "ok"): {"qps": 1.0, "commits_per_second": 0.5, "rollbacks_per_second": 0.0, "tps": 0.5},
        ("a", "02", "ok"): {"qps": 0.5, "commits_per_second": 0.25, "rollbacks_per_second": 0.0, "tps": 0.25},
        ("a", "02", "error"): None,
        ("b", "02", "partial"): None,
        ("c", "02", "ok"): {"rollbacks_per_second": 0.0, "tps": 0.0},
    }
    assert got["b", "00", "error"][1] == "RuntimeError: poisoned"
    assert again.store.records().count() == 6 and again.store.previous(KIND).count() == 3


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    made = Collection(spark, f"file://{tmp_path}/c", _answer, retention_days=2)
    first = spark.createDataFrame([("a", "e", at(1), 10.0), ("b", "e", at(5), -1.0)], DUE)
    second = spark.createDataFrame([("a", "e", at(1, 1), 3610.0), ("b", "e", at(5), 8.0)], DUE)
    made._batch(first, 0)
    made._batch(second, 1)
    rows = lambda df: sorted((str(r) for r in df.collect()))
    results, records = rows(made.results()), rows(made.store.records())
    made._batch(second, 1)  # as after a loss between the work and the note of it
    assert rows(made.results()) == results and rows(made.store.records()) == records
    assert {r.status for r in made.results().filter("batch LIKE '%1'").collect()} == {"ok", "partial"}
    made._batch(second.limit(0), 2)
    assert made.store.days() == ["20240305"]  # the day of a's snapshots went with the retention of two days
