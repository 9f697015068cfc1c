"""Figures of a running engine from tables of its sessions and objects: who blocks whom, and what maintenance is due."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

# The end of transaction numbers, and the limits from which a finding is one.
XID_CEILING = 2_147_483_648
FREEZE_WARN, FREEZE_CRITICAL, CEILING_CRITICAL = 0.90, 1.10, 0.80
BLOAT_WARN, BLOAT_MIN_DEAD = 20.0, 100_000
SLOT_WARN, SLOT_CRITICAL = 1 << 30, 8 << 30


def lock_edges(sessions: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
    """(blocker, blocked, blocker_user, blocked_user, lock_type, wait_s) of sessions (pid, user, wait, started, blocking: an array of pids).

    Each blocked session is laid beside every pid that blocks it; the blocker's user is '' where it isn't a session. A
    wait without a type is Lock, one without a start 0 seconds long.
    """
    return sessions.sparkSession.sql(
        """
        SELECT blocker, b.pid AS blocked, coalesce(o.user, '') AS blocker_user, coalesce(b.user, '') AS blocked_user, coalesce(b.wait, 'Lock') AS lock_type,
          coalesce(timestampdiff(SECOND, b.started, coalesce(:now, current_timestamp())), 0) AS wait_s
        FROM {sessions} b JOIN LATERAL explode(b.blocking) AS t(blocker) LEFT JOIN {sessions} o ON o.pid = blocker
        """,
        args={"now": now},
        sessions=sessions,
    )


def wraparound(settings: DataFrame, databases: DataFrame, relations: DataFrame, top: int = 25) -> DataFrame:
    """(kind, object, xid_age, freeze_max_age): the objects nearest to the end of transaction numbers, the oldest first.

    settings: name, setting; databases: object, xid_age, connects; relations: object, xid_age, relkind, schema. The one setting
    is read once and is beside every row; without it freeze_max_age is null.
    """
    return databases.sparkSession.sql(
        """
        WITH s AS (SELECT CAST(setting AS BIGINT) AS freeze_max_age FROM {settings} WHERE name = 'autovacuum_freeze_max_age')
        SELECT 'database' AS kind, object, xid_age, (SELECT freeze_max_age FROM s) AS freeze_max_age FROM {databases} WHERE connects
        UNION ALL
        SELECT 'table', object, xid_age, (SELECT freeze_max_age FROM s) FROM {relations}
        WHERE relkind IN ('r', 'm', 't') AND xid_age IS NOT NULL AND schema NOT IN ('pg_catalog', 'information_schema')
        ORDER BY xid_age DESC, kind, object LIMIT {top}
        """,
        settings=settings,
        databases=databases,
        relations=relations,
        top=top,
    )


def maintenance_findings(ages: DataFrame, tuples: DataFrame, slots: DataFrame) -> DataFrame:
    """(category, object, metric, value, threshold, severity) of what is due.

    ages as wraparound gives them: critical from 0.8 of all numbers or 1.1 of freeze_max_age, warning from 0.9 of that;
    tuples (object, live, dead): a fifth or more dead of at least 100,000, never more than a warning; slots (object,
    active, retained): inactive ones that hold back 1 GiB, critical from 8.
    """
    age, most = F.col("xid_age"), F.coalesce(F.nullif("freeze_max_age", F.lit(0)).cast("double"), F.lit(float("inf")))
    due = F.when((age / XID_CEILING >= CEILING_CRITICAL) | (age / most >= FREEZE_CRITICAL), "critical").when(age / most >= FREEZE_WARN, "warning")
    row = lambda category, obj, metric, value, threshold, severity: (F.lit(category).alias("category"), obj.alias("object"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), severity.alias("severity"))
    old = ages.filter("xid_age > 0").select(*row("wraparound", F.concat_ws(" ", "kind", "object"), "xid_age", age, F.coalesce("freeze_max_age", F.lit(0)), due))
    ratio = F.round(100.0 * F.col("dead") / F.nullif(F.col("live") + F.col("dead"), F.lit(0)), 1)
    bloat = tuples.filter(F.col("dead") >= BLOAT_MIN_DEAD).select(*row("bloat", F.col("object"), "dead_ratio_pct", ratio, F.lit(BLOAT_WARN), F.when(ratio >= BLOAT_WARN, "warning")))
    held = slots.filter(~F.coalesce("active", F.lit(False))).select(*row("replication_slot", F.col("object"), "retained_bytes", F.col("retained"), F.lit(SLOT_WARN), F.when(F.col("retained") >= SLOT_CRITICAL, "critical").when(F.col("retained") >= SLOT_WARN, "warning")))
    return old.unionByName(bloat).unionByName(held).filter("severity IS NOT NULL")


# Controls, by what fails them, how badly, and what leaves them to a person, who comes first.
_UNSEEN = "coalesce(security_status, '') IN ('permission_denied', 'unsupported')"
CONTROLS = (
    ("least-privilege", "login_superusers > 0 OR dangerous_privileges > 0", "critical", _UNSEEN),
    ("account-lifecycle", "expired_accounts > 0 OR wildcard_hosts > 0", "warning", _UNSEEN),
    ("secret-handling", "plaintext_secret", "critical", "false"),
    ("config-integrity", "config_drifted > 0", "warning", "NOT coalesce(config_baseline_set, false)"),
    ("backup-recovery", "NOT coalesce(archiving_enabled, false)", "warning", "NOT coalesce(backup_status_known, false)"),
    ("audit-logging", "false", None, "NOT coalesce(audit_chain_active, false)"),
    ("transport-tls", "tls = 'off'", "warning", "coalesce(tls, '') NOT IN ('on', 'off')"),
)


def compliance_controls(inputs: DataFrame, by: str) -> DataFrame:
    """(by, control, result, severity): each of the seven controls of an instance is pass, fail or manual; severity of failures.

    inputs: by, security_status, login_superusers, dangerous_privileges, expired_accounts, wildcard_hosts,
    plaintext_secret, config_baseline_set, config_drifted, backup_status_known, archiving_enabled, audit_chain_active,
    tls. What can't be seen is manual, whatever else is known; null counts and flags are 0 and false.
    """
    one = lambda name, bad, severity, unseen: F.struct(F.lit(name).alias("control"), F.when(F.expr(unseen), "manual").when(F.expr(bad), "fail").otherwise("pass").alias("result"), F.lit(severity).cast("string").alias("severity"))
    rows = inputs.select(by, F.explode(F.array(*(one(*c) for c in CONTROLS))).alias("x")).select(by, "x.*")
    return rows.withColumn("severity", F.when(F.col("result") == "fail", F.col("severity")))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    """Customers as sessions: those of suppliers of one nation and balance band are in each other's way."""
    c = table(s, d, "customer")
    blocking = "CASE WHEN c_custkey % 3 = 0 THEN array(c_custkey + 1, c_custkey * 2) WHEN c_custkey % 3 = 1 THEN array(c_custkey - 1) ELSE array() END"
    return c.selectExpr("c_custkey AS pid", "IF(c_custkey % 7 = 0, NULL, c_name) AS user", "IF(c_custkey % 5 = 0, NULL, c_mktsegment) AS wait", "IF(c_custkey % 11 = 0, NULL, timestamp_seconds(1700000000 - c_custkey * 3)) AS started", f"{blocking} AS blocking")


def _ages(s: SparkSession, d: str) -> DataFrame:
    part, nation = table(s, d, "part"), table(s, d, "nation")
    settings = part.selectExpr("'autovacuum_freeze_max_age' AS name", "CAST(max(p_partkey) * 90000 AS STRING) AS setting").unionByName(part.selectExpr("'work_mem' AS name", "max(p_brand) AS setting"))
    relations = part.selectExpr("p_name || p_partkey AS object", "IF(p_partkey % 9 = 0, NULL, p_partkey * 100000) AS xid_age", "CASE p_partkey % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'i' WHEN 2 THEN 'm' ELSE 't' END AS relkind", "IF(p_size % 10 = 0, 'pg_catalog', p_brand) AS schema")
    return wraparound(settings, nation.selectExpr("n_name AS object", "CAST(n_nationkey AS BIGINT) * 9000000 AS xid_age", "n_regionkey <> 2 AS connects"), relations, 40)


def _findings(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1000).otherwise(0)).alias("dead"), F.sum(F.when(F.col("l_returnflag") != "R", 1000 + F.col("l_suppkey") % 4 * 700).otherwise(0)).alias("live"))
    slots = table(s, d, "supplier").selectExpr("s_name AS object", "s_suppkey % 3 = 0 AS active", "CAST(floor(s_acctbal) AS BIGINT) * 1200000 AS retained")
    return maintenance_findings(_ages(s, d), orders.select(F.col("l_suppkey").cast("string").alias("object"), "live", "dead"), slots)


def _controls(s: SparkSession, d: str) -> DataFrame:
    k = "s_suppkey"
    return table(s, d, "supplier").selectExpr(f"{k} AS instance", f"CASE {k} % 9 WHEN 0 THEN 'permission_denied' WHEN 1 THEN 'unsupported' WHEN 2 THEN NULL ELSE 'ok' END AS security_status", f"{k} % 4 AS login_superusers", f"IF({k} % 8 = 0, 1, NULL) AS dangerous_privileges", f"{k} % 3 AS expired_accounts", f"IF({k} % 6 = 0, 2, 0) AS wildcard_hosts", f"IF({k} % 7 = 0, true, NULL) AS plaintext_secret", f"{k} % 5 > 1 AS config_baseline_set", f"{k} % 10 - 5 AS config_drifted", f"{k} % 4 <> 2 AS backup_status_known", f"{k} % 5 = 0 AS archiving_enabled", f"{k} % 2 = 0 AS audit_chain_active", f"CASE {k} % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' END AS tls")


QUERIES = {
    "compliance_controls": lambda s, d: compliance_controls(_controls(s, d), "instance"),
    "lock_edges": lambda s, d: lock_edges(_sessions(s, d), datetime.datetime.fromtimestamp(1_700_000_000, datetime.timezone.utc)),
    "wraparound": _ages,
    "maintenance_findings": _findings,
}

_AGES = "s AS (SELECT max(p_partkey) * 90000 AS m FROM part), ages AS (SELECT * FROM (SELECT 'database' AS kind, n_name AS object, n_nationkey::BIGINT * 9000000 AS xid_age, m AS freeze_max_age FROM nation, s WHERE n_regionkey <> 2 UNION ALL SELECT 'table', p_name || p_partkey, p_partkey * 100000, m FROM part, s WHERE p_partkey % 9 <> 0 AND p_partkey % 4 <> 1 AND p_size % 10 <> 0) ORDER BY xid_age DESC, kind, object LIMIT 40)"
ORACLE_SQL = {
    "compliance_controls": "WITH c AS (SELECT s_suppkey AS k, unnest(['least-privilege', 'account-lifecycle', 'secret-handling', 'config-integrity', 'backup-recovery', 'audit-logging', 'transport-tls']) AS control FROM supplier), r AS (SELECT k, control, CASE control WHEN 'least-privilege' THEN CASE WHEN k % 9 < 2 THEN 'manual' WHEN k % 4 > 0 OR k % 8 = 0 THEN 'fail' ELSE 'pass' END WHEN 'account-lifecycle' THEN CASE WHEN k % 9 < 2 THEN 'manual' WHEN k % 3 > 0 OR k % 6 = 0 THEN 'fail' ELSE 'pass' END WHEN 'secret-handling' THEN CASE WHEN k % 7 = 0 THEN 'fail' ELSE 'pass' END WHEN 'config-integrity' THEN CASE WHEN k % 5 <= 1 THEN 'manual' WHEN k % 10 > 5 THEN 'fail' ELSE 'pass' END WHEN 'backup-recovery' THEN CASE WHEN k % 4 = 2 THEN 'manual' WHEN k % 5 = 0 THEN 'pass' ELSE 'fail' END WHEN 'audit-logging' THEN CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'manual' END ELSE CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'manual' END END AS result FROM c) SELECT k AS instance, control, result, CASE WHEN result = 'fail' THEN CASE WHEN control IN ('least-privilege', 'secret-handling') THEN 'critical' ELSE 'warning' END END AS severity FROM r",
    "lock_edges": "WITH c AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS u, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS w, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 3 END AS s, CASE c_custkey % 3 WHEN 0 THEN [c_custkey + 1, c_custkey * 2] WHEN 1 THEN [c_custkey - 1] ELSE [] END AS blocking FROM customer), e AS (SELECT *, unnest(blocking) AS blocker FROM c) SELECT e.blocker, e.pid AS blocked, coalesce(o.u, '') AS blocker_user, coalesce(e.u, '') AS blocked_user, coalesce(e.w, 'Lock') AS lock_type, coalesce(e.s, 0) AS wait_s FROM e LEFT JOIN c o ON o.pid = e.blocker",
    "wraparound": f"WITH {_AGES} SELECT * FROM ages",
    "maintenance_findings": f"WITH {_AGES}, t AS (SELECT l_suppkey::VARCHAR AS object, sum(CASE WHEN l_returnflag = 'R' THEN 1000 ELSE 0 END) AS dead, sum(CASE WHEN l_returnflag <> 'R' THEN 1000 + l_suppkey % 4 * 700 ELSE 0 END) AS live FROM lineitem GROUP BY l_suppkey), f AS (SELECT 'wraparound' AS category, kind || ' ' || object AS object, 'xid_age' AS metric, xid_age::DOUBLE AS value, freeze_max_age::DOUBLE AS threshold, CASE WHEN xid_age / 2147483648 >= 0.8 OR xid_age / freeze_max_age >= 1.1 THEN 'critical' WHEN xid_age / freeze_max_age >= 0.9 THEN 'warning' END AS severity FROM ages WHERE xid_age > 0 UNION ALL SELECT 'bloat', object, 'dead_ratio_pct', round(100.0::DOUBLE * dead / (live + dead), 1), 20, 'warning' FROM t WHERE dead >= 100000 AND round(100.0::DOUBLE * dead / (live + dead), 1) >= 20 UNION ALL SELECT 'replication_slot', s_name, 'retained_bytes', floor(s_acctbal) * 1200000, 1073741824, CASE WHEN floor(s_acctbal) * 1200000 >= 8589934592 THEN 'critical' ELSE 'warning' END FROM supplier WHERE s_suppkey % 3 <> 0 AND floor(s_acctbal) * 1200000 >= 1073741824) SELECT * FROM f WHERE severity IS NOT NULL",
}
