"""Readers: Parquet tables, day-named JSON-lines audit logs, and the audit view of an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "ts string, tool string, entry struct<trace_id:string,execution_id:string,user_id:string,db_profile_id:string,sql_hash:string,sql_text:string,started_at:string,elapsed_ms:bigint,row_count:bigint,truncated:boolean,success:boolean,error_code:string,error_message:string>, _corrupt_record string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, folder: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Audit lines of files query-YYYYMMDD.jsonl, chosen by the day in the file's name and not by the row's time;
    malformed lines and lines without SQL are left out."""
    rows = spark.read.schema(AUDIT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/query-*.jsonl")
    day = F.regexp_extract(F.col("_metadata.file_name"), r"query-(\d{8})\.jsonl", 1)
    rows = rows.withColumn("day", day).filter("_corrupt_record is null and trim(entry.sql_text) <> ''")
    if first_day:
        rows = rows.filter(F.col("day") >= first_day)
    if last_day:
        rows = rows.filter(F.col("day") <= last_day)
    return rows.select("day", "ts", "tool", "entry.*")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an audit log: tool, profile, elapsed_ms, success, started_at, sql_hash."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").alias("started_at"),
        F.col("event_type").alias("tool"),
        F.col("user_id").alias("profile"),
        F.floor("value").cast("long").alias("elapsed_ms"),
        (F.col("event_type") != "error").alias("success"),
        F.substring(F.sha2(F.trim("props"), 256), 1, 16).alias("sql_hash"),
    )


AUDIT_SQL = "SELECT event_id, ts AS started_at, event_type AS tool, user_id AS profile, floor(value)::BIGINT AS elapsed_ms, event_type <> 'error' AS success, substr(sha256(trim(props)), 1, 16) AS sql_hash FROM events"
