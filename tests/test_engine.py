"""Lateral lock edges, wraparound with its one setting, maintenance findings, ranked incidents and sources of alerts, on rows for each limit."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import engine, health
from tidemark.streaming import alerts

T = datetime.datetime(2024, 5, 1, 12, tzinfo=datetime.timezone.utc)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lock_edges(spark):
    rows = [(1, "a", "IO", T - datetime.timedelta(seconds=90), [2, 9]), (2, None, None, None, [3]), (3, "c", "x", T, []), (4, "d", "x", T, None)]
    got = engine.lock_edges(spark.createDataFrame(rows, "pid long, user string, wait string, started timestamp, blocking array<long>"), T)
    assert {tuple(r) for r in got.collect()} == {(2, 1, "", "a", "IO", 90), (9, 1, "", "a", "IO", 90), (3, 2, "c", "", "Lock", 0)}
    assert "Generate explode" in plan(got)


def test_wraparound_reads_its_setting_once(spark):
    settings = spark.createDataFrame([("autovacuum_freeze_max_age", "200"), ("other", "x")], "name string, setting string")
    databases = spark.createDataFrame([("d1", 50, True), ("d2", 900, False)], "object string, xid_age long, connects boolean")
    relations = spark.createDataFrame([("t", 70, "r", "s"), ("i", 99, "i", "s"), ("p", 99, "r", "pg_catalog"), ("m", 10, "m", "s"), ("n", None, "t", "s")], "object string, xid_age long, relkind string, schema string")
    got = engine.wraparound(settings, databases, relations)
    assert [tuple(r) for r in got.collect()] == [("table", "t", 70, 200), ("database", "d1", 50, 200), ("table", "m", 10, 200)]
    assert "scalar-subquery" in plan(got)
    assert [r.freeze_max_age for r in engine.wraparound(settings.limit(0), databases, relations, 1).collect()] == [None]


def test_maintenance_findings(spark):
    ages = spark.createDataFrame([("table", "ok", 179, 200), ("table", "warn", 180, 200), ("table", "late", 220, 200), ("database", "end", 1_717_986_919, 0), ("table", "none", 1, 0), ("table", "neg", -5, 200)], "kind string, object string, xid_age long, freeze_max_age long")
    tuples = spark.createDataFrame([("few", 1, 99_999), ("fifth", 400_000, 100_000), ("less", 410_000, 100_000), ("most", 0, 100_000)], "object string, live long, dead long")
    gb = 1 << 30
    slots = spark.createDataFrame([("on", True, 99 * gb), ("small", False, gb - 1), ("big", False, gb), ("huge", None, 8 * gb)], "object string, active boolean, retained long")
    got = {(r.category, r.object, r.value, r.severity) for r in engine.maintenance_findings(ages, tuples, slots).collect()}
    assert got == {
        ("wraparound", "table warn", 180.0, "warning"),
        ("wraparound", "table late", 220.0, "critical"),
        ("wraparound", "database end", 1717986919.0, "critical"),
        ("bloat", "fifth", 20.0, "warning"),
        ("bloat", "most", 100.0, "warning"),
        ("replication_slot", "big", float(gb), "warning"),
        ("replication_slot", "huge", float(8 * gb), "critical"),
    }


def test_incidents(spark):
    schema = "instance string, maint_critical int, maint_warning int, lock_edges int, regressions int, drifted int, long_running int, waiting int, pool_status string"
    signals = spark.createDataFrame([("all", 1, 1, 1, 1, 1, 1, 1, "critical"), ("change", 0, None, 0, 0, 0, 0, 0, None), ("wait", 0, 0, 0, 0, 0, None, 2, "ok"), ("pool", 0, 0, 0, 0, 0, 0, 0, "warning"), ("fine", 0, 0, 0, 0, 0, 0, 0, "ok")], schema)
    changes = spark.createDataFrame([("change", 1, "completed"), ("change", 2, "failed"), ("change", 3, "executing"), ("change", 4, "rolled_back"), ("change", 5, "draft"), ("only", 1, "rolling_back")], "instance string, seq int, state string")
    by = {}
    for r in health.incidents(signals, changes, "instance").orderBy("instance", "rank").collect():
        by.setdefault(r.instance, []).append((r.score, r.category, r.confidence, r.status))
    assert [(s, c) for s, c, *_ in by["all"]] == [(95, "maintenance"), (90, "lock_contention"), (80, "connection_pool"), (65, "workload_regression"), (55, "config_drift"), (50, "maintenance"), (45, "long_running_sessions")]
    assert [x[2] for x in by["all"]] == ["high", "high", "medium", "medium", "medium", "low", "low"]
    assert by["change"] == [(88, "recent_change", "high", "critical")] * 2 + [(75, "recent_change", "medium", "critical"), (68, "recent_change", "medium", "critical")]
    assert by["wait"] == [(40, "waiting_sessions", "low", "degraded")] and by["pool"] == [(60, "connection_pool", "medium", "degraded")]
    assert by["only"] == [(75, "recent_change", "medium", "degraded")] and "fine" not in by


def test_a_worse_level_of_the_same_thing_is_quiet(spark):
    day = lambda i: datetime.datetime(2024, 5, i)
    events = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    capacity = spark.createDataFrame([("disk", day(1), 85), ("disk", day(3), 95), ("disk", day(9), 95), ("tape", day(1), 79)], "object string, day timestamp, used long")
    limits = spark.createDataFrame([("disk", 100), ("tape", 100)], "object string, max long")
    warnings = spark.createDataFrame([("Schema DRIFT", day(1)), ("replica diverged " + "x" * 60, day(1)), ("slow", day(1))], "text string, day timestamp")
    evidence = spark.createDataFrame([("LAG", "critical", day(2)), ("LAG", "warning", day(1)), ("OK", "info", day(1))], "kind string, severity string, day timestamp")
    sources = alerts.alert_sources(events, capacity, limits, warnings, evidence)
    fired = alerts.drained(alerts.cooldown(alerts.arrivals(sources), 7 * 86400)).select("code", F.timestamp_seconds("fired_at").alias("t")).collect()
    assert sorted((r.code, r.t.day) for r in fired) == [("capacity:disk", 1), ("capacity:disk", 9), ("evidence:LAG", 1), ("schema_drift:Schema DRIFT", 1), ("schema_drift:replica diverged " + "x" * 40 + "...", 1)]


def test_compliance_controls(spark):
    kinds = "instance string, security_status string, login_superusers int, dangerous_privileges int, expired_accounts int, wildcard_hosts int, plaintext_secret boolean, config_baseline_set boolean, config_drifted int, backup_status_known boolean, archiving_enabled boolean, audit_chain_active boolean, tls string"
    rows = [("good", "ok", 0, 0, 0, 0, False, True, 0, True, True, True, "on"), ("bad", "critical", 1, 0, 0, 1, True, True, 2, True, False, True, "off"), ("blind", "permission_denied", 9, 9, 9, 9, None, False, 9, False, True, False, "unknown"), ("null", *[None] * 12)]
    by = {}
    for r in engine.compliance_controls(spark.createDataFrame(rows, kinds), "instance").collect():
        by.setdefault(r.instance, {})[r.control] = (r.result, r.severity)
    names = [c[0] for c in engine.CONTROLS]
    assert [by["good"][n] for n in names] == [("pass", None)] * 7
    assert [by["bad"][n] for n in names] == [("fail", "critical"), ("fail", "warning"), ("fail", "critical"), ("fail", "warning"), ("fail", "warning"), ("pass", None), ("fail", "warning")]
    assert [by["blind"][n][0] for n in names] == ["manual", "manual", "pass", "manual", "manual", "manual", "manual"]
    assert [by["null"][n][0] for n in names] == ["pass", "pass", "pass", "manual", "manual", "manual", "manual"]
