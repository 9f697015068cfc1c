"""Health of a fleet: sessions, replication, pools, maintenance windows, configuration drift, risk scores and incidents.

All take rows of any number of instances and give a row an instance, a finding or a group, by aggregation and CASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_order(column: str = "severity") -> Column:
    """Sort key: critical first, then high, medium, low, info, then what is unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column)), F.lit(0)) + F.when(F.col(column).isin(*SEVERITIES), 0).otherwise(99)


def sessions(rows: DataFrame, by: str, long_s: int = 300) -> DataFrame:
    """Per instance: sessions, active ones, waiting ones (a wait event that is neither idle nor the client's), long-running ones, and the status."""
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.lower("state").isin("active", "query")).alias("active"),
        F.count_if(F.expr("coalesce(wait_event, '') <> '' and not contains(lower(coalesce(wait_class, '')), 'idle') and not contains(lower(wait_event), 'client')")).alias("waiting"),
        F.count_if(F.col("duration_s") >= long_s).alias("long_running"),
    )
    return out.withColumn("status", F.when((F.col("waiting") > 0) | (F.col("long_running") > 0), "warning").otherwise("ok"))


def replication(nodes: DataFrame, by: str, lag_s: float = 300) -> DataFrame:
    """Per instance: nodes, unhealthy and lagging ones, those of unknown lag (below zero), and the worst lag (0 where none is known)."""
    return nodes.groupBy(by).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(~F.col("healthy")).alias("unhealthy"),
        F.count_if(F.col("lag_s") >= lag_s).alias("lagging"),
        F.count_if(F.col("lag_s") < 0).alias("unknown"),
        F.greatest(F.coalesce(F.max("lag_s"), F.lit(0.0)), F.lit(0.0)).alias("worst_lag"),
    )


def rollup(findings: DataFrame, by: str) -> DataFrame:
    """Per instance: findings by severity, and the status: critical before warning before ok, partial where nothing was collected."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("critical", "warning")}
    out = findings.groupBy(by).agg(n["critical"].alias("critical"), n["warning"].alias("warning"), F.count("severity").alias("findings"))
    return out.withColumn("status", F.expr("CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' WHEN findings > 0 THEN 'ok' ELSE 'partial' END"))


def pool_diagnosis(pools: DataFrame, warn_ms: float = 50, critical_ms: float = 500, saturated: float = 0.9) -> DataFrame:
    """(…, avg_wait_ms, code, suggested_max): contention of connection pools by waits and saturation; waits come first."""
    p = pools.withColumn("avg_wait_ms", F.when(F.col("waits") > 0, half_up(F.col("wait_ms") / F.col("waits"), 3)).otherwise(0.0))
    full = f"max_open > 0 AND in_use / max_open >= {saturated}D"
    code = F.expr(f"CASE WHEN waits > 0 AND avg_wait_ms >= {critical_ms} THEN 'POOL_EXHAUSTION' WHEN waits > 0 AND avg_wait_ms < {warn_ms} AND max_open > 0 AND NOT ({full}) THEN 'POOL_TRANSIENT_WAIT' WHEN waits > 0 THEN 'POOL_CONTENTION' WHEN {full} THEN 'POOL_NEAR_SATURATION' ELSE 'POOL_HEALTHY' END")
    more = F.expr("CASE WHEN code = 'POOL_HEALTHY' OR max_open <= 0 THEN 0 ELSE greatest(max_open + max_open div 2, max_open + 1) END").cast("long")
    return p.withColumn("code", code).withColumn("suggested_max", more)


def config_value(c: Column) -> Column:
    """Trimmed and lower-cased, with the usual words for true and false as one each."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("on", "true", "yes", "1"), "true").when(low.isin("off", "false", "no", "0"), "false").otherwise(low)


def config_drift(baseline: DataFrame, current: DataFrame, by: str) -> DataFrame:
    """Each declared parameter against its current value: match, drift, or unknown where the server lacks it; names are compared without case."""
    want = baseline.select(by, "parameter", F.trim("value").alias("baseline"), F.lower("parameter").alias("name"))
    have = current.select(by, F.lower("parameter").alias("name"), F.col("value").alias("current"), F.lit(True).alias("present"))
    status = F.when(F.col("present").isNull(), "unknown").when(config_value(F.col("baseline")).eqNullSafe(config_value(F.col("current"))), "match").otherwise("drift")
    return want.join(have, [by, "name"], "left").select(by, "parameter", "baseline", "current", status.alias("status"))


def in_window(at: Column, start: str, end: str, days: list[str]) -> Column:
    """Whether a UTC time lies in [start, end) of HH:MM on one of the days (mon to sun; none: every day).

    A window that ends before it starts goes on after midnight, and the day is then that of its start.
    """
    minute = F.hour(at) * 60 + F.minute(at)
    lo, hi = (int(t[:2]) * 60 + int(t[3:]) for t in (start, end))
    names = F.array(*map(F.lit, ("mon", "tue", "wed", "thu", "fri", "sat", "sun")))
    allowed = lambda shift: F.lit(True) if not days else F.get(names, (F.weekday(at) + 7 - shift) % 7).isin(*[d.strip().lower() for d in days])
    if lo <= hi:
        return (minute >= lo) & (minute < hi) & allowed(0)
    return ((minute >= lo) & allowed(0)) | ((minute < hi) & allowed(1))


def fleet_scores(signals: DataFrame, by: str) -> DataFrame:
    """Per instance the worst of its signals (score, status, ord), the first of equal ones, as risk, level, health and grade; worst first."""
    best = signals.groupBy(by).agg(F.max(F.struct("score", (-F.col("ord")).alias("first"), "status")).alias("x"))
    out = best.select(by, F.when(F.col("x.score") > 0, F.col("x.status")).otherwise("healthy").alias("status"), F.greatest("x.score", F.lit(0)).cast("long").alias("risk"))
    level = "CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END"
    grade = "CASE WHEN health >= 90 THEN 'A' WHEN health >= 75 THEN 'B' WHEN health >= 60 THEN 'C' WHEN health >= 40 THEN 'D' ELSE 'F' END"
    return out.withColumn("level", F.expr(level)).withColumn("health", F.greatest(100 - F.col("risk"), F.lit(0)).cast("long")).withColumn("grade", F.expr(grade)).orderBy(F.desc("risk"), by)


def fleet_summary(scores: DataFrame) -> DataFrame:
    """By status and grade and over all: instances, integer mean of health, least health."""
    return scores.groupingSets([["status"], ["grade"], []], "status", "grade").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(health) div count(1)").alias("mean_health"), F.min("health").alias("min_health"))


# What a signal says of an incident, in the order in which equal scores stand; changes come after locks.
HYPOTHESES = (
    ("maint_critical > 0", 95, "maintenance"),
    ("lock_edges > 0", 90, "lock_contention"),
    (None, None, "recent_change"),
    ("pool_status = 'critical'", 80, "connection_pool"),
    ("pool_status = 'warning'", 60, "connection_pool"),
    ("regressions > 0", 65, "workload_regression"),
    ("drifted > 0", 55, "config_drift"),
    ("maint_warning > 0", 50, "maintenance"),
    ("long_running > 0", 45, "long_running_sessions"),
    ("waiting > 0 AND NOT coalesce(long_running > 0, false)", 40, "waiting_sessions"),
)
CHANGE_SCORES = {"failed": 88, "rolled_back": 88, "rollback_required": 88, "executing": 75, "rolling_back": 75, "completed": 68}


def incidents(signals: DataFrame, changes: DataFrame, by: str) -> DataFrame:
    """(by, rank, category, score, confidence, status): the hypotheses of each instance, the likeliest first.

    signals: by, maint_critical, maint_warning, lock_edges, regressions, drifted, long_running, waiting (counts; nulls
    are 0) and pool_status; changes: by, seq, state, each of which is a hypothesis of its own; other states are none.
    Sessions that wait count only where none runs long. confidence: high from 85, medium from 55. status: critical from
    a best score of 85, degraded from 40; an instance without a hypothesis has no row and is ok.
    """
    made = [F.when(F.expr(when), F.struct(F.lit(s).alias("score"), F.lit(i).alias("place"), F.lit(0).cast("long").alias("seq"), F.lit(k).alias("category"))) for i, (when, s, k) in enumerate(HYPOTHESES) if when]
    rows = signals.select(by, F.explode(F.array_compact(F.array(*made))).alias("x")).select(by, "x.*")
    score = F.try_element_at(F.create_map(*(F.lit(x) for kv in CHANGE_SCORES.items() for x in kv)), F.col("state"))
    place = next(i for i, h in enumerate(HYPOTHESES) if h[0] is None)
    rows = rows.unionByName(changes.select(by, score.alias("score"), F.lit(place).alias("place"), F.col("seq").cast("long").alias("seq"), F.lit("recent_change").alias("category")).filter("score IS NOT NULL"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "place", "seq")
    best = F.max("score").over(Window.partitionBy(by))
    status = F.when(best >= 85, "critical").when(best >= 40, "degraded").otherwise("ok")
    return rows.select(by, F.row_number().over(w).cast("long").alias("rank"), "category", F.col("score").cast("long").alias("score"), F.when(F.col("score") >= 85, "high").when(F.col("score") >= 55, "medium").otherwise("low").alias("confidence"), status.alias("status"))


def compliance(controls: DataFrame, by: str) -> DataFrame:
    """Per instance: controls passed, failed and left to a person, and the score pass * 100 div (pass + fail), 100 where none was tested."""
    n = controls.groupBy(by).agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("pass", "fail", "manual")))
    return n.withColumn("score", F.coalesce(F.expr("(pass * 100) div nullif(pass + fail, 0)"), F.lit(100)).cast("long"))


def tps(rates: DataFrame) -> DataFrame:
    """Transactions a second, from commits and rollbacks where a snapshot has no such figure."""
    wide = rates.groupBy("object").pivot("metric", ["tps", "commit", "rollback"]).agg(F.first("rate"))
    return wide.select("object", F.coalesce("tps", F.coalesce("commit", F.lit(0.0)) + F.coalesce("rollback", F.lit(0.0))).alias("tps"))


def prometheus(counters: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """Text exposition lines of a counter, one a label value."""
    return counters.select(F.concat(F.lit(metric + "{" + label + '="'), F.col(label).cast("string"), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def _events(s, d):
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _sessions(s, d):
    return _events(s, d).selectExpr("user_id AS instance", "CASE event_type WHEN 'view' THEN 'Active' WHEN 'click' THEN 'query' ELSE 'idle' END AS state", "CASE k % 3 WHEN 0 THEN 'ClientRead' WHEN 1 THEN 'DataFileRead' END AS wait_event", "IF(k % 5 = 0, 'Idle', 'IO') AS wait_class", "value * 10 AS duration_s")


def _nodes(s, d):
    return _events(s, d).selectExpr("user_id AS instance", "event_type <> 'error' AS healthy", "IF(k % 7 = 0, -1D, k * 10D) AS lag_s")


def _findings(s, d):
    return _events(s, d).selectExpr("user_id AS instance", "CASE WHEN event_type = 'error' AND k > 90 THEN 'critical' WHEN event_type = 'error' THEN 'warning' WHEN event_type = 'view' THEN 'info' END AS severity")


def _pools(s, d):
    return _events(s, d).groupBy(F.col("user_id").alias("pool")).agg(F.count_if(F.expr("event_type = 'error' and k > 80")).alias("waits"), F.sum(F.when(F.expr("event_type = 'error' and k > 80"), F.floor(F.col("value") * 5))).alias("wait_ms"), F.max("k").alias("in_use"), F.lit(100).alias("max_open")).na.fill(0)


def _config(s, d):
    e = _events(s, d)
    base = e.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("instance"), F.concat(F.lit("Param_"), (F.col("k") % 9).cast("string")).alias("parameter")).agg(F.max(F.expr("CASE k % 4 WHEN 0 THEN ' ON ' WHEN 1 THEN 'off' ELSE cast(k AS string) END")).alias("value"))
    now = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("instance"), F.concat(F.lit("param_"), (F.col("k") % 9).cast("string")).alias("parameter")).agg(F.max(F.expr("CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE cast(k AS string) END")).alias("value"))
    return base, now


def _signals(s, d):
    return _events(s, d).selectExpr("user_id AS instance", "CASE WHEN event_type = 'error' THEN k WHEN event_type = 'view' THEN k div 2 ELSE 0 END AS score", "CASE event_type WHEN 'error' THEN 'down' ELSE 'degraded' END AS status", "event_id AS ord")


def _incident_signals(s, d):
    c = lambda x: F.count_if(F.expr(x))
    pool = F.when(F.max("value") > 250, "critical").when(F.max("value") > 180, "warning")
    counts = {"maint_critical": "event_type = 'error' and k = 99", "maint_warning": "event_type = 'error' and k in (97, 98)", "lock_edges": "event_type = 'view' and k = 98", "regressions": "value > 200", "drifted": "event_type = 'click' and k < 2", "long_running": "event_type = 'signup' and k = 7", "waiting": "event_type = 'signup' and k < 5"}
    signals = _events(s, d).groupBy(F.col("user_id").alias("instance")).agg(*(c(x).alias(n) for n, x in counts.items()), pool.alias("pool_status"))
    changes = _events(s, d).filter("event_type = 'purchase'").selectExpr("user_id AS instance", "event_id AS seq", "CASE k WHEN 1 THEN 'failed' WHEN 2 THEN 'rolled_back' WHEN 3 THEN 'executing' WHEN 4 THEN 'completed' WHEN 5 THEN 'rollback_required' WHEN 6 THEN 'rolling_back' ELSE 'draft' END AS state")
    return signals, changes


_WINDOWS = [("22:30", "03:15", ["fri", "sat"]), ("09:00", "12:00", [])]

QUERIES = {
    "session_summary": lambda s, d: sessions(_sessions(s, d), "instance"),
    "replication_summary": lambda s, d: replication(_nodes(s, d), "instance"),
    "severity_rollup": lambda s, d: rollup(_findings(s, d), "instance"),
    "pool_diagnosis": lambda s, d: pool_diagnosis(_pools(s, d)),
    "config_drift": lambda s, d: config_drift(*_config(s, d), "instance"),
    "maintenance_window": lambda s, d: table(s, d, "events").select("event_id", in_window(F.col("ts"), *_WINDOWS[0]).alias("weekend_night"), in_window(F.col("ts"), *_WINDOWS[1]).alias("morning")),
    "fleet_scores": lambda s, d: fleet_scores(_signals(s, d), "instance"),
    "fleet_summary": lambda s, d: fleet_summary(fleet_scores(_signals(s, d), "instance")),
    "incident_rank": lambda s, d: incidents(*_incident_signals(s, d), "instance"),
    "compliance_counts": lambda s, d: compliance(_events(s, d).selectExpr("user_id AS instance", "CASE WHEN event_type = 'error' THEN 'fail' WHEN k % 4 = 0 THEN 'manual' ELSE 'pass' END AS result"), "instance"),
    "tps_fallback": lambda s, d: tps(_events(s, d).filter("event_type IN ('view', 'click', 'purchase')").groupBy(F.col("user_id").alias("object"), F.expr("CASE event_type WHEN 'view' THEN 'commit' WHEN 'click' THEN 'rollback' ELSE 'tps' END").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("m")).filter("metric <> 'tps' OR m > 90").select("object", "metric", (F.col("n") / 4).alias("rate"))),
    "prometheus_text": lambda s, d: prometheus(table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "calls_total", "event_type", "n"),
    "severity_sort": lambda s, d: _findings(s, d).filter("severity IS NOT NULL").groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("position", severity_order().cast("long")),
}

_EV = "WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events)"
_F = "CASE WHEN event_type = 'error' AND k > 90 THEN 'critical' WHEN event_type = 'error' THEN 'warning' WHEN event_type = 'view' THEN 'info' END"
_SC = _EV + ", s AS (SELECT user_id AS instance, CASE WHEN event_type = 'error' THEN k WHEN event_type = 'view' THEN k // 2 ELSE 0 END AS score, CASE event_type WHEN 'error' THEN 'down' ELSE 'degraded' END AS status, event_id AS ord FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY score DESC, ord) AS rn FROM s), f AS (SELECT instance, CASE WHEN score > 0 THEN status ELSE 'healthy' END AS status, score::BIGINT AS risk, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level, (100 - score)::BIGINT AS health, CASE WHEN score <= 10 THEN 'A' WHEN score <= 25 THEN 'B' WHEN score <= 40 THEN 'C' WHEN score <= 60 THEN 'D' ELSE 'F' END AS grade FROM b WHERE rn = 1) "
_CFG = "SELECT user_id AS instance, '{0}' || (k % 9)::VARCHAR AS parameter, max(CASE k % 4 WHEN 0 THEN '{1}' WHEN 1 THEN '{2}' ELSE k::VARCHAR END) AS value FROM e WHERE event_type = '{3}' GROUP BY 1, 2"
_NORM = "CASE WHEN lower(trim({0})) IN ('on', 'true', 'yes', '1') THEN 'true' WHEN lower(trim({0})) IN ('off', 'false', 'no', '0') THEN 'false' ELSE lower(trim({0})) END"

ORACLE_SQL = {
    "session_summary": _EV + ", s AS (SELECT user_id AS instance, count(*) AS total, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS active, count(*) FILTER (WHERE k % 3 = 1 AND k % 5 <> 0) AS waiting, count(*) FILTER (WHERE value * 10 >= 300) AS long_running FROM e GROUP BY 1) SELECT *, CASE WHEN waiting > 0 OR long_running > 0 THEN 'warning' ELSE 'ok' END AS status FROM s",
    "replication_summary": _EV + ", n AS (SELECT user_id AS instance, event_type <> 'error' AS healthy, CASE WHEN k % 7 = 0 THEN -1 ELSE k * 10.0 END::DOUBLE AS lag_s FROM e) SELECT instance, count(*) AS nodes, count(*) FILTER (WHERE NOT healthy) AS unhealthy, count(*) FILTER (WHERE lag_s >= 300) AS lagging, count(*) FILTER (WHERE lag_s < 0) AS unknown, greatest(max(lag_s), 0.0::DOUBLE) AS worst_lag FROM n GROUP BY 1",
    "severity_rollup": _EV + f", f AS (SELECT user_id AS instance, {_F} AS severity FROM e), c AS (SELECT instance, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(severity) AS findings FROM f GROUP BY 1) SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' WHEN findings > 0 THEN 'ok' ELSE 'partial' END AS status FROM c",
    "pool_diagnosis": _EV + ", p AS (SELECT user_id AS pool, count(*) FILTER (WHERE event_type = 'error' AND k > 80) AS waits, coalesce(sum(floor(value * 5)) FILTER (WHERE event_type = 'error' AND k > 80), 0)::BIGINT AS wait_ms, max(k) AS in_use, 100 AS max_open FROM e GROUP BY 1), a AS (SELECT *, CASE WHEN waits > 0 THEN floor(wait_ms::DOUBLE / waits * 1000 + 0.5) / 1000 ELSE 0 END AS avg_wait_ms FROM p), c AS (SELECT *, CASE WHEN waits > 0 AND avg_wait_ms >= 500 THEN 'POOL_EXHAUSTION' WHEN waits > 0 AND avg_wait_ms < 50 AND NOT in_use >= 90 THEN 'POOL_TRANSIENT_WAIT' WHEN waits > 0 THEN 'POOL_CONTENTION' WHEN in_use >= 90 THEN 'POOL_NEAR_SATURATION' ELSE 'POOL_HEALTHY' END AS code FROM a) SELECT *, CASE WHEN code = 'POOL_HEALTHY' THEN 0 ELSE 150 END::BIGINT AS suggested_max FROM c",
    "config_drift": _EV + ", b AS (" + _CFG.format("Param_", " ON ", "off", "signup") + "), c AS (" + _CFG.format("param_", "true", "0", "click") + ") SELECT b.instance, b.parameter, trim(b.value) AS baseline, c.value AS current, CASE WHEN c.instance IS NULL THEN 'unknown' WHEN " + _NORM.format("b.value") + " = " + _NORM.format("c.value") + " THEN 'match' ELSE 'drift' END AS status FROM b LEFT JOIN c ON b.instance = c.instance AND lower(b.parameter) = lower(c.parameter)",
    "maintenance_window": "WITH m AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS t, isodow(ts) AS day FROM events) SELECT event_id, (t >= 1350 AND day IN (5, 6)) OR (t < 195 AND day IN (6, 7)) AS weekend_night, t >= 540 AND t < 720 AS morning FROM m",
    "fleet_scores": _SC + "SELECT * FROM f",
    "fleet_summary": _SC + "SELECT status, grade, count(*) AS n, (sum(health) // count(*))::BIGINT AS mean_health, min(health) AS min_health FROM f GROUP BY GROUPING SETS ((status), (grade), ())",
    "incident_rank": _EV + ", c AS (SELECT user_id AS instance, count(*) FILTER (WHERE event_type = 'error' AND k = 99) AS mc, count(*) FILTER (WHERE event_type = 'error' AND k IN (97, 98)) AS mw, count(*) FILTER (WHERE event_type = 'view' AND k = 98) AS l, count(*) FILTER (WHERE value > 200) AS q, count(*) FILTER (WHERE event_type = 'click' AND k < 2) AS dr, count(*) FILTER (WHERE event_type = 'signup' AND k = 7) AS lr, count(*) FILTER (WHERE event_type = 'signup' AND k < 5) AS wa, max(value) AS top FROM e GROUP BY 1), h AS (SELECT instance, 'maintenance' AS category, 95 AS score, 0 AS seq FROM c WHERE mc > 0 UNION ALL SELECT instance, 'lock_contention', 90, 0 FROM c WHERE l > 0 UNION ALL SELECT user_id, 'recent_change', CASE WHEN k IN (1, 2, 5) THEN 88 WHEN k IN (3, 6) THEN 75 ELSE 68 END, event_id FROM e WHERE event_type = 'purchase' AND k BETWEEN 1 AND 6 UNION ALL SELECT instance, 'connection_pool', CASE WHEN top > 250 THEN 80 ELSE 60 END, 0 FROM c WHERE top > 180 UNION ALL SELECT instance, 'workload_regression', 65, 0 FROM c WHERE q > 0 UNION ALL SELECT instance, 'config_drift', 55, 0 FROM c WHERE dr > 0 UNION ALL SELECT instance, 'maintenance', 50, 0 FROM c WHERE mw > 0 UNION ALL SELECT instance, 'long_running_sessions', 45, 0 FROM c WHERE lr > 0 UNION ALL SELECT instance, 'waiting_sessions', 40, 0 FROM c WHERE wa > 0 AND lr = 0) SELECT instance, row_number() OVER (PARTITION BY instance ORDER BY score DESC, seq) AS rank, category, score::BIGINT AS score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN max(score) OVER (PARTITION BY instance) >= 85 THEN 'critical' ELSE 'degraded' END AS status FROM h",
    "compliance_counts": _EV + ", r AS (SELECT user_id AS instance, CASE WHEN event_type = 'error' THEN 'fail' WHEN k % 4 = 0 THEN 'manual' ELSE 'pass' END AS result FROM e), n AS (SELECT instance, count(*) FILTER (WHERE result = 'pass') AS pass, count(*) FILTER (WHERE result = 'fail') AS fail, count(*) FILTER (WHERE result = 'manual') AS manual FROM r GROUP BY 1) SELECT *, coalesce(pass * 100 // nullif(pass + fail, 0), 100)::BIGINT AS score FROM n",
    "tps_fallback": _EV + ", m AS (SELECT user_id AS object, event_type, count(*) / 4 AS rate, max(k) AS m FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2) SELECT object, coalesce(max(rate) FILTER (WHERE event_type = 'purchase' AND m > 90), coalesce(max(rate) FILTER (WHERE event_type = 'view'), 0) + coalesce(max(rate) FILTER (WHERE event_type = 'click'), 0))::DOUBLE AS tps FROM m WHERE event_type <> 'purchase' OR m > 90 GROUP BY 1",
    "prometheus_text": "SELECT 'calls_total{event_type=\"' || event_type || '\"} ' || count(*)::VARCHAR AS line FROM events GROUP BY event_type",
    "severity_sort": _EV + f", f AS (SELECT {_F} AS severity FROM e) SELECT severity, count(*) AS n, CASE severity WHEN 'critical' THEN 1 WHEN 'info' THEN 5 ELSE 99 END::BIGINT AS position FROM f WHERE severity IS NOT NULL GROUP BY 1",
}
