"""Reports over an audit log: totals, exact percentiles, top lists, peak hour, worst statement of each hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import AUDIT_SQL, audit

SLOW_MS = 200


def summary(log: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    """One row of totals. Mean and slow calls are those of successful calls; the mean is an integer quotient, as are all means of these reports."""
    ok = F.col("success")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(half_up(F.count_if(~ok) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.expr("sum(if(success, elapsed_ms, 0)) div nullif(count_if(success), 0)"), F.lit(0).cast("long")).alias("avg_ms"),
        F.count_if(ok & (F.col("elapsed_ms") >= slow_ms)).alias("slow"),
    )


def percentiles(log: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The value of rank floor(p * (n - 1)) of the successful rows of each group, 0 for a group without any.

    Equal values are counted before they are ranked, so the window holds a row for each distinct value of a group.
    """
    counts = log.filter("success").groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"hi": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    pick = lambda p: F.min(F.when(F.col("hi") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    found = ranked.groupBy(*by).agg(*(pick(p).alias(name) for name, p in ps.items()))
    return log.select(*by).distinct().join(found, by, "left").na.fill(0, list(ps))


def top(log: DataFrame, key: str, n: int = 10) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def peak_hour(log: DataFrame) -> DataFrame:
    """The first hour of the most calls; -1 for an empty log."""
    hours = log.groupBy(F.hour("started_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.agg(F.max(F.struct("n", -F.col("hour"))).alias("x")).select(F.coalesce(-F.col("x.col2"), F.lit(-1)).cast("long").alias("hour"), F.coalesce("x.n", F.lit(0)).cast("long").alias("n"))


def worst_per_hash(log: DataFrame, n: int = 10) -> DataFrame:
    """The slowest successful call of each statement, the first on ties; the slowest n of them, ties by hash."""
    worst = log.filter("success").groupBy("sql_hash").agg(F.max(F.struct("elapsed_ms", (-F.col("event_id")).alias("first"))).alias("w"))
    return worst.select("sql_hash", F.col("w.elapsed_ms").alias("elapsed_ms"), (-F.col("w.first")).alias("event_id")).orderBy(F.desc("elapsed_ms"), "sql_hash").limit(n)


def breakdowns(log: DataFrame) -> DataFrame:
    """Counts by tool, by hour, and over all, in one pass."""
    hour = F.hour("started_at").cast("long").alias("hour")
    return log.select("tool", hour, "success").groupingSets([["tool"], ["hour"], []], "tool", "hour").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"))


def slow_by_profile(log: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    """Slow successful calls of each profile: count, total, worst, and the score count * (total div count)."""
    slow = log.filter(F.col("success") & (F.col("elapsed_ms") >= slow_ms))
    return slow.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("total_ms"), F.max("elapsed_ms").alias("worst_ms"), F.expr("count(1) * (sum(elapsed_ms) div count(1))").alias("score"))


def timeline(log: DataFrame, days: int = 14) -> DataFrame:
    """Calls of each of the last days up to the newest row, days without calls included."""
    last = log.agg(F.max(F.to_date("started_at")).alias("last"))
    every = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    calls = log.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(calls, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("calls"))


def tool_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.sum("elapsed_ms").alias("duration_ms"))


_A = f"WITH a AS ({AUDIT_SQL}) "
_PS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}

QUERIES = {
    "workload_summary": lambda s, d: summary(audit(s, d)),
    "latency_percentiles": lambda s, d: percentiles(audit(s, d), ["profile"], "elapsed_ms", _PS),
    "top_tools": lambda s, d: top(audit(s, d), "tool"),
    "errors_by_profile": lambda s, d: top(audit(s, d).filter(~F.col("success")), "profile"),
    "peak_hour": lambda s, d: peak_hour(audit(s, d)),
    "worst_per_hash": lambda s, d: worst_per_hash(audit(s, d)),
    "workload_breakdowns": lambda s, d: breakdowns(audit(s, d)),
    "slow_by_profile": lambda s, d: slow_by_profile(audit(s, d)),
    "timeline_zero_fill": lambda s, d: timeline(audit(s, d)),
    "tool_counters": lambda s, d: tool_counters(audit(s, d)),
}

ORACLE_SQL = {
    "workload_summary": _A + "SELECT count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, floor(count(*) FILTER (WHERE NOT success) / count(*) * 10000 + 0.5) / 10000 AS error_rate, (sum(elapsed_ms) FILTER (WHERE success) // count(*) FILTER (WHERE success))::BIGINT AS avg_ms, count(*) FILTER (WHERE success AND elapsed_ms >= 200) AS slow FROM a",
    "latency_percentiles": _A + ", r AS (SELECT profile, elapsed_ms, row_number() OVER (PARTITION BY profile ORDER BY elapsed_ms) - 1 AS k, count(*) OVER (PARTITION BY profile) AS n FROM a WHERE success) SELECT profile, " + ", ".join(f"coalesce(max(CASE WHEN k = floor({p} * (n - 1)) THEN elapsed_ms END), 0) AS {name}" for name, p in _PS.items()) + " FROM r RIGHT JOIN (SELECT DISTINCT profile FROM a) USING (profile) GROUP BY profile",
    "top_tools": _A + "SELECT tool, count(*) AS n FROM a GROUP BY tool ORDER BY n DESC, tool LIMIT 10",
    "errors_by_profile": _A + "SELECT profile, count(*) AS n FROM a WHERE NOT success GROUP BY profile ORDER BY n DESC, profile LIMIT 10",
    "peak_hour": _A + "SELECT hour(started_at)::BIGINT AS hour, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, hour LIMIT 1",
    "worst_per_hash": _A + ", r AS (SELECT *, row_number() OVER (PARTITION BY sql_hash ORDER BY elapsed_ms DESC, event_id) AS k FROM a WHERE success) SELECT sql_hash, elapsed_ms, event_id FROM r WHERE k = 1 ORDER BY elapsed_ms DESC, sql_hash LIMIT 10",
    "workload_breakdowns": _A + ", b AS (SELECT tool, hour(started_at)::BIGINT AS hour, success FROM a) SELECT tool, hour, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS errors FROM b GROUP BY GROUPING SETS ((tool), (hour), ())",
    "slow_by_profile": _A + "SELECT profile, count(*) AS n, sum(elapsed_ms)::BIGINT AS total_ms, max(elapsed_ms) AS worst_ms, (count(*) * (sum(elapsed_ms) // count(*)))::BIGINT AS score FROM a WHERE success AND elapsed_ms >= 200 GROUP BY profile",
    "timeline_zero_fill": _A + ", l AS (SELECT max(started_at)::DATE AS last FROM a), d AS (SELECT unnest(generate_series(last - 13, last, INTERVAL 1 DAY))::DATE AS day FROM l), c AS (SELECT started_at::DATE AS day, count(*) AS n FROM a GROUP BY 1) SELECT day, coalesce(n, 0)::BIGINT AS calls FROM d LEFT JOIN c USING (day)",
    "tool_counters": _A + "SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS errors, sum(elapsed_ms)::BIGINT AS duration_ms FROM a GROUP BY tool",
}
