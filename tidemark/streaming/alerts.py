"""Streaming twins of the snapshot operators: rates from counters and alerts with a cooldown, as keyed state.

Each takes and returns a streaming DataFrame and gives what its batch twin gives, as long as files arrive in the order of
their times: rows of one trigger may come in any order, but what is not newer than a key's state is passed over.
A key holds one snapshot or one firing, so the state grows with the keys and not with the input.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators import snapshots
from tidemark.sources.tables import table


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def arrivals(df: DataFrame) -> DataFrame:
    """df, written as Parquet files, as a stream of these files."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the files that are there now: appended to a Parquet table, with its own checkpoint."""
    spark, path = stream.sparkSession, _scratch(stream.sparkSession)
    done = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stateful(stream: DataFrame, key: str, step: Callable, out: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def rates(stream: DataFrame) -> DataFrame:
    """(profile, metric, snap_at, rate) of snapshots (profile, snap_at, metric, counter), snap_at in seconds.

    The difference a second against the profile's snapshot before; none where a metric lacks there or falls. Rows with
    nulls are left out; of repeated rows the largest counter counts.
    """

    def step(key, chunks, state):
        rows = pd.concat(chunks)
        at, old = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
        out = []
        for now, group in rows.groupby("snap_at", sort=True):
            if at is not None and now <= at:
                continue
            new = {m: int(c) for m, c in group.groupby("metric")["counter"].max().items()}
            out += [(key[0], m, int(now), float(np.floor((c - old[m]) / (now - at) * 1000 + 0.5) / 1000)) for m, c in new.items() if m in old and c >= old[m]]
            at, old = int(now), new
        if at is not None:
            state.update((at, json.dumps(old)))
        yield pd.DataFrame(out, columns=["profile", "metric", "snap_at", "rate"])

    kind = stream.schema["profile"].dataType.simpleString()
    return _stateful(stream.dropna(), "profile", step, f"profile {kind}, metric string, snap_at long, rate double", "at long, counters string")


def cooldown(stream: DataFrame, seconds: int = snapshots.COOLDOWN_S) -> DataFrame:
    """(code, fired_at) of alerts (code, at), at in seconds: the first of a code, then each `seconds` or more after the last that fired.

    The clock starts anew on firing only. Rows with nulls are left out; repeated rows are one.
    """

    def step(key, chunks, state):
        last, fired = state.get[0] if state.exists else None, []
        for t in np.unique(pd.concat(chunks)["at"].to_numpy()).tolist():
            if last is None or t - last >= seconds:
                last = t
                fired.append(t)
        if fired:
            state.update((last,))
        yield pd.DataFrame({"code": [key[0]] * len(fired), "fired_at": fired})

    kind = stream.schema["code"].dataType.simpleString()
    return _stateful(stream.dropna(), "code", step, f"code {kind}, fired_at long", "last long")


def daily_snapshots(events: DataFrame) -> DataFrame:
    """Events as snapshots of users: for each day and event type the running count of that type since the start."""
    daily = events.groupBy(F.col("user_id").alias("profile"), F.col("event_type").alias("metric"), F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    counter = F.sum("k").over(Window.partitionBy("profile", "metric").orderBy("day"))
    return daily.select("profile", F.unix_seconds(F.col("day").cast("timestamp")).alias("snap_at"), "metric", counter.alias("counter"))


def alert_sources(events: DataFrame, capacity: DataFrame, limits: DataFrame, warnings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(code, at) of every source: what an alert is about, and not how bad it is, so that a worse level of the same thing is quiet too.

    Latency regressions by fingerprint; objects at 80 % of their limit or more; warnings (text, day) that speak of
    drift, by their first 60 characters (57 and dots); evidence (kind, severity, day) that is a warning or critical.
    """
    seconds = F.unix_seconds(F.col("day").cast("timestamp")).alias("at")
    slower = snapshots.regressions(events).select(F.concat(F.lit("latency:"), F.col("fingerprint").cast("string")).alias("code"), seconds)
    full = capacity.join(limits, "object").filter("max > 0 AND used * 100 >= max * 80").select(F.concat(F.lit("capacity:"), "object").alias("code"), seconds)
    short = F.when(F.length("text") > 60, F.concat(F.left("text", F.lit(57)), F.lit("..."))).otherwise(F.col("text"))
    drift = warnings.filter("lower(text) LIKE '%drift%' OR lower(text) LIKE '%diverge%'").select(F.concat(F.lit("schema_drift:"), short).alias("code"), seconds)
    shown = evidence.filter("severity IN ('warning', 'critical')").select(F.concat(F.lit("evidence:"), "kind").alias("code"), seconds)
    return slower.unionByName(full).unionByName(drift).unionByName(shown)


def newest(alerts: DataFrame, n: int = 100) -> DataFrame:
    """The bounded log of alerts: the n newest, newest first, ties by code."""
    return alerts.orderBy(F.desc("fired_at"), "code").limit(n)


#: Days between two firings of a code where alerts are dated by the day.
QUIET_S = 7 * 86400


def _stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(rates(arrivals(daily_snapshots(table(spark, sf_dir, "events")))))


def _stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    found = errors.select(F.col("user_id").alias("code"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return drained(cooldown(arrivals(found), 86400))


def _fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = snapshots.capacity(table(spark, sf_dir, "orders"))
    limits = stored.groupBy("object").agg((F.max("used") + F.expr("max(used) div 50")).alias("max"))
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("day", F.date_trunc("day", "ts"))
    text = "CASE WHEN k < 3 THEN 'Schema Drift on a table whose name is long enough to be cut, number ' || k WHEN k < 6 THEN 'replica ' || k || ' diverged' ELSE 'slow' END AS text"
    severity = "CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'warning' ELSE 'info' END AS severity"
    sources = alert_sources(events.drop("k", "day"), stored, limits, events.filter("event_type = 'view'").selectExpr(text, "day"), events.filter("event_type = 'error'").selectExpr("'E' || k % 5 AS kind", severity, "day"))
    return drained(cooldown(arrivals(sources), QUIET_S))


QUERIES = {
    "stream_counter_rates": _stream_rates,
    "stream_alert_cooldown": _stream_cooldown,
    "stream_alert_union": _fired,
    "stream_alert_log": lambda s, d: newest(_fired(s, d)),
}

_COOL = "WITH RECURSIVE e AS ({e}), f AS (SELECT code, min(t) AS fired_at FROM e GROUP BY 1 UNION ALL SELECT f.code, (SELECT min(t) FROM e WHERE e.code = f.code AND e.t >= f.fired_at + {s}) FROM f WHERE f.fired_at IS NOT NULL) SELECT code, fired_at FROM f WHERE fired_at IS NOT NULL"
_SLOWER = "SELECT 'latency:' || fingerprint AS code, epoch(day)::BIGINT AS t FROM (" + snapshots.ORACLE_SQL["latency_regression"] + ")"
_FULL = "SELECT 'capacity:' || object AS code, epoch(day)::BIGINT AS t FROM (" + snapshots._CAP + "SELECT object, day, used, max(used) OVER (PARTITION BY object) + max(used) OVER (PARTITION BY object) // 50 AS most FROM c) WHERE used * 100 >= most * 80"
_DRIFT = "SELECT 'schema_drift:' || CASE WHEN k < 3 THEN left('Schema Drift on a table whose name is long enough to be cut, number ' || k, 57) || '...' ELSE 'replica ' || k || ' diverged' END AS code, epoch(date_trunc('day', ts))::BIGINT AS t FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) WHERE event_type = 'view' AND k < 6"
_EVIDENCE = "SELECT 'evidence:E' || (props->>'$.k')::BIGINT % 5 AS code, epoch(date_trunc('day', ts))::BIGINT AS t FROM events WHERE event_type = 'error' AND value > 100"
_UNION = _COOL.format(e=f"{_SLOWER} UNION ALL {_FULL} UNION ALL {_DRIFT} UNION ALL {_EVIDENCE}", s=QUIET_S)

ORACLE_SQL = {
    "stream_counter_rates": "WITH h AS (SELECT user_id AS profile, event_type AS metric, date_trunc('day', ts) AS day, count(*) AS k FROM events GROUP BY 1, 2, 3), s AS (SELECT profile, metric, epoch(day)::BIGINT AS snap_at, sum(k) OVER (PARTITION BY profile, metric ORDER BY day) AS counter FROM h), t AS (SELECT profile, snap_at, lag(snap_at) OVER (PARTITION BY profile ORDER BY snap_at) AS prev FROM (SELECT DISTINCT profile, snap_at FROM s)) SELECT s.profile, s.metric, s.snap_at, floor((s.counter - o.counter)::DOUBLE / (s.snap_at - t.prev) * 1000 + 0.5) / 1000 AS rate FROM s JOIN t ON s.profile = t.profile AND s.snap_at = t.snap_at JOIN s o ON o.profile = s.profile AND o.metric = s.metric AND o.snap_at = t.prev WHERE s.counter >= o.counter",
    "stream_alert_cooldown": _COOL.format(e="SELECT DISTINCT user_id AS code, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'", s=86400),
    "stream_alert_union": _UNION,
    "stream_alert_log": f"SELECT code, fired_at FROM ({_UNION}) ORDER BY fired_at DESC, code LIMIT 100",
}
