"""Series of snapshots: rates from counters, growth, forecasts, regressions, alerts with a cooldown, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

COOLDOWN_S = 600


def hourly_counters(events: DataFrame) -> DataFrame:
    """Events as snapshots: for each hour and event type the running count of that type since the start."""
    hourly = events.groupBy(F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("snap_at")).agg(F.count(F.lit(1)).alias("k"))
    return hourly.select("metric", "snap_at", F.sum("k").over(Window.partitionBy("metric").orderBy("snap_at")).alias("counter"))


def counter_rates(snapshots: DataFrame) -> DataFrame:
    """Counter differences a second against the snapshot just before; none where the metric lacks there, falls, or no time has passed.

    The previous snapshot is that of the whole series: a metric missing in it has no rate, and an older one isn't used.
    """
    times = snapshots.select("snap_at").distinct()
    before = times.select("snap_at", F.lag("snap_at").over(Window.orderBy("snap_at")).alias("prev"))
    now = snapshots.join(before, "snap_at")
    old = snapshots.select("metric", F.col("snap_at").alias("prev"), F.col("counter").alias("old"))
    seconds = F.unix_seconds(F.col("snap_at").cast("timestamp")) - F.unix_seconds(F.col("prev").cast("timestamp"))
    rates = now.join(old, ["metric", "prev"]).filter((seconds > 0) & (F.col("counter") >= F.col("old")))
    return rates.select("metric", "snap_at", half_up((F.col("counter") - F.col("old")) / seconds, 3).alias("rate"))


def capacity(orders: DataFrame) -> DataFrame:
    """Orders as storage: for each priority and month the amount stored so far, in whole units."""
    m = orders.groupBy(F.col("o_orderpriority").alias("object"), F.trunc("o_orderdate", "month").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("k"))
    return m.select("object", "day", F.sum("k").over(Window.partitionBy("object").orderBy("day")).cast("long").alias("used"))


def growth(series: DataFrame) -> DataFrame:
    """Units a day since the snapshot before."""
    w = Window.partitionBy("object").orderBy("day")
    days = F.datediff("day", F.lag("day").over(w))
    return series.select("object", "day", "used", half_up((F.col("used") - F.lag("used").over(w)) / days, 3).alias("per_day")).filter("per_day is not null")


def forecast(series: DataFrame, limits: DataFrame) -> DataFrame:
    """Days until an object's size reaches its limit (object, max): critical to 7 days, a warning to 30; only what grows and has a limit."""
    w = Window.partitionBy("object").orderBy(F.desc("day"))
    last = growth(series).withColumn("rn", F.row_number().over(w)).filter("rn = 1 and per_day > 0")
    days = half_up(F.greatest(F.col("max") - F.col("used"), F.lit(0)) / F.col("per_day"), 2)
    return last.join(limits, "object").filter("max > 0").select("object", "per_day", days.alias("days")).withColumn("level", F.expr("CASE WHEN days <= 7 THEN 'critical' WHEN days <= 30 THEN 'warning' ELSE 'ok' END"))


def regressions(events: DataFrame, times: float = 2.0, least: float = 100.0) -> DataFrame:
    """Fingerprints whose mean of a day is over `times` that of the snapshot before, and over `least`.

    The snapshot before is that of the whole series: a fingerprint that lacks there isn't compared with an older one.
    """
    daily = events.groupBy(F.col("user_id").alias("fingerprint"), F.to_date("ts").alias("day")).agg((F.sum(F.col("value").cast("decimal(18,2)")) / F.count(F.lit(1))).cast("decimal(18,4)").cast("double").alias("mean"))
    days = daily.select("day").distinct()
    before = days.select("day", F.lag("day").over(Window.orderBy("day")).alias("prev"))
    old = daily.select("fingerprint", F.col("day").alias("prev"), F.col("mean").alias("before"))
    found = daily.join(before, "day").join(old, ["fingerprint", "prev"]).select("fingerprint", "day", "mean", "before")
    return found.filter((F.col("mean") > times * F.col("before")) & (F.col("mean") > least))


def cooldown(alerts: DataFrame, key: str, at: str, seconds: int = COOLDOWN_S) -> DataFrame:
    """The alerts that fire: the first of a key, then each that comes `seconds` or more after the last that fired.

    Each firing depends on the one before, so a key's distinct seconds are streamed in order through one task, which
    holds the last firing only.
    """
    times = alerts.select(key, F.unix_seconds(F.col(at).cast("timestamp")).alias("t")).dropna().distinct()

    def fire(batches):
        name = last = None
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch["t"]):
                keep.append(last is None or k != name or t - last >= seconds)
                if keep[-1]:
                    name, last = k, t
            yield batch[keep].rename(columns={"t": "fired_at"})

    kind = times.schema[key].dataType.simpleString()
    return times.repartition(key).sortWithinPartitions(key, "t").mapInPandas(fire, f"`{key}` {kind}, fired_at long")


def freshness(events: DataFrame, interval_s: int = 3600) -> DataFrame:
    """Keys whose newest row is older than twice the interval against the newest of all."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    age = events.agg(F.unix_seconds(F.max("ts").cast("timestamp"))).scalar() - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.select("user_id", age.alias("age_s"), (age > 2 * interval_s).alias("stale"))


def retained(events: DataFrame, days: int = 7) -> DataFrame:
    """Rows of whole days not before the cutoff day."""
    cutoff = events.agg(F.date_sub(F.to_date(F.max("ts")), days)).scalar()
    return events.filter(F.to_date("ts") >= cutoff).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def latest_and_previous(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    two = orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 2")
    return two.groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, F.col("o_orderkey"))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("o_orderkey"))).alias("previous"))


_ev = lambda s, d: table(s, d, "events")

QUERIES = {
    "counter_rates": lambda s, d: counter_rates(hourly_counters(_ev(s, d))),
    "capacity_growth": lambda s, d: growth(capacity(table(s, d, "orders"))),
    "exhaustion_forecast": lambda s, d: forecast(capacity(table(s, d, "orders")), capacity(table(s, d, "orders")).groupBy("object").agg((F.max("used") + F.expr("max(used) div 50")).alias("max"))),
    "latency_regression": lambda s, d: regressions(_ev(s, d)),
    "alert_cooldown": lambda s, d: cooldown(_ev(s, d).filter("event_type = 'error'"), "user_id", "ts", 86400),
    "freshness": lambda s, d: freshness(_ev(s, d)),
    "retention_days": lambda s, d: retained(_ev(s, d)),
    "latest_and_previous": lambda s, d: latest_and_previous(table(s, d, "orders")),
}

_CAP = "WITH m AS (SELECT o_orderpriority AS object, date_trunc('month', o_orderdate)::DATE AS day, sum(o_totalprice::DECIMAL(18,2)) AS k FROM orders GROUP BY 1, 2), c AS (SELECT object, day, trunc(sum(k) OVER (PARTITION BY object ORDER BY day))::BIGINT AS used FROM m), g AS (SELECT object, day, used, floor((used - lag(used) OVER w) / (day - lag(day) OVER w) * 1000 + 0.5) / 1000 AS per_day FROM c WINDOW w AS (PARTITION BY object ORDER BY day)) "

ORACLE_SQL = {
    "counter_rates": "WITH h AS (SELECT event_type AS metric, date_trunc('hour', ts) AS snap_at, count(*) AS k FROM events GROUP BY 1, 2), s AS (SELECT metric, snap_at, sum(k) OVER (PARTITION BY metric ORDER BY snap_at) AS counter FROM h), t AS (SELECT snap_at, lag(snap_at) OVER (ORDER BY snap_at) AS prev FROM (SELECT DISTINCT snap_at FROM s)) SELECT s.metric, s.snap_at, floor((s.counter - o.counter)::DOUBLE / (epoch(s.snap_at) - epoch(t.prev)) * 1000 + 0.5) / 1000 AS rate FROM s JOIN t ON s.snap_at = t.snap_at JOIN s o ON o.metric = s.metric AND o.snap_at = t.prev WHERE s.counter >= o.counter",
    "capacity_growth": _CAP + "SELECT object, day, used, per_day FROM g WHERE per_day IS NOT NULL",
    "exhaustion_forecast": _CAP + ", l AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY day DESC) AS rn FROM g), f AS (SELECT object, per_day, floor((used + used // 50 - used) / per_day * 100 + 0.5) / 100 AS days FROM l WHERE rn = 1 AND per_day > 0) SELECT object, per_day, days, CASE WHEN days <= 7 THEN 'critical' WHEN days <= 30 THEN 'warning' ELSE 'ok' END AS level FROM f",
    "latency_regression": "WITH d AS (SELECT user_id AS fingerprint, ts::DATE AS day, round(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 4) AS mean FROM events GROUP BY 1, 2), t AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT day FROM d)) SELECT d.fingerprint, d.day, d.mean, o.mean AS before FROM d JOIN t ON d.day = t.day JOIN d o ON o.fingerprint = d.fingerprint AND o.day = t.prev WHERE d.mean > 2 * o.mean AND d.mean > 100",
    "alert_cooldown": "WITH RECURSIVE e AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'), f AS (SELECT user_id, min(t) AS fired_at FROM e GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(t) FROM e WHERE e.user_id = f.user_id AND e.t >= f.fired_at + 86400) FROM f WHERE f.fired_at IS NOT NULL) SELECT user_id, fired_at FROM f WHERE fired_at IS NOT NULL",
    "freshness": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS newest FROM events) SELECT user_id, (floor(epoch(newest)) - floor(epoch(last)))::BIGINT AS age_s, floor(epoch(newest)) - floor(epoch(last)) > 7200 AS stale FROM l, n",
    "retention_days": "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE - 7 FROM events) GROUP BY 1",
    "latest_and_previous": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, max(CASE WHEN rn = 1 THEN o_orderkey END) AS latest, max(CASE WHEN rn = 2 THEN o_orderkey END) AS previous FROM r WHERE rn <= 2 GROUP BY 1",
}
