"""A store of operational snapshots: validated appends, partitions by day, pruned reads newest first, retention by whole days.

A folder of Parquet files under day=YYYYMMDD/batch=NAME. A batch that is written again replaces itself, day by day, so
that a job that repeats after a loss adds nothing twice. Days are those of UTC.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "kind string, profile_id string, engine string, collected_at timestamp, data string"
#: Rows of a query by default, and the most that it may ask for.
ROWS, MOST_ROWS = 1000, 10_000


def utc_day(at: Column) -> Column:
    """The day of a timestamp in UTC as YYYYMMDD, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")), "yyyyMMdd")


def defects(records: DataFrame) -> DataFrame:
    """records with `defect`: null for a record that has a kind, a profile, a time and valid JSON, else the first that it lacks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.when(blank("kind"), "kind").when(blank("profile_id"), "profile_id").when(F.col("collected_at").isNull(), "collected_at").when(blank("data") | F.try_parse_json("data").isNull(), "data")
    return records.withColumn("defect", bad)


class OperationalStore:
    """Records in `path` and, beside it, what was refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.refused = spark, path.rstrip("/"), f"{path.rstrip('/')}-refused"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._fs.mkdirs(self._path(self.refused))

    def append(self, records: DataFrame, batch: str | None = None) -> None:
        """Adds records (RECORD; other columns are left out), those with a defect to the refused ones.

        A batch that is named replaces what was written under its name on the days it has now. Rows of a day are
        spread over as many files as they need.
        """
        name = batch or uuid.uuid4().hex
        marked = defects(records.select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ") for x in RECORD.split(", ")))))
        good = marked.filter("defect IS NULL").drop("defect").withColumn("day", utc_day(F.col("collected_at")))
        self._write(good.withColumn("batch", F.lit(name)).hint("rebalance", "day"), self.path, "day", "batch")
        self._write(marked.filter("defect IS NOT NULL").withColumn("batch", F.lit(name)), self.refused, "batch")

    def _write(self, df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def records(self) -> DataFrame:
        """All records with day and batch."""
        return self.spark.read.schema(f"{RECORD}, day string, batch string").parquet(self.path)

    def rejected(self) -> DataFrame:
        return self.spark.read.schema(f"{RECORD}, defect string, batch string").parquet(self.refused)

    def query(self, kind: str | None = None, profile_id: str | None = None, since: datetime.datetime | None = None, limit: int = 0) -> DataFrame:
        """Records of a kind and profile from `since` on, the newest first, at most limit; 1000 for a limit of 0 or above 10,000.

        Days before `since` are not read. Records of one time are ordered by profile, kind and data.
        """
        return newest(self.records().drop("batch"), kind, profile_id, since, limit)

    def previous(self, kind: str, but: str | None = None) -> DataFrame:
        """(profile_id, collected_at, data): each profile's newest record of a kind, the batch `but` left out."""
        rows = self.records().filter(F.col("kind") == kind)
        if but is not None:
            rows = rows.filter(F.col("batch") != but)
        return rows.groupBy("profile_id").agg(F.max(F.struct("collected_at", "data")).alias("x")).select("profile_id", "x.*")

    def days(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n[4:] for n in names if n.startswith("day=") and n[4:].isdigit() and len(n) == 12)

    def prune(self, before: datetime.datetime) -> int:
        """Removes the days wholly before that of `before` (UTC) and returns how many; other days' files aren't touched."""
        before = before.astimezone(datetime.timezone.utc) if before.tzinfo else before
        gone = [d for d in self.days() if d < before.strftime("%Y%m%d")]
        for day in gone:
            self._fs.delete(self._path(f"{self.path}/day={day}"), True)
        return len(gone)


def newest(records: DataFrame, kind: str | None = None, profile_id: str | None = None, since: datetime.datetime | None = None, limit: int = 0) -> DataFrame:
    """The rule of OperationalStore.query over records that have a day."""
    for column, value in (("kind", kind), ("profile_id", profile_id)):
        if value:
            records = records.filter(F.col(column) == value)
    if since is not None:
        since = since if since.tzinfo else since.replace(tzinfo=datetime.timezone.utc)
        at = F.timestamp_micros(F.lit(int(since.timestamp() * 1_000_000)))
        records = records.filter((F.col("day") >= since.astimezone(datetime.timezone.utc).strftime("%Y%m%d")) & (F.col("collected_at") >= at))
    return records.orderBy(F.desc("collected_at"), "profile_id", "kind", "data").limit(limit if 0 < limit <= MOST_ROWS else ROWS)
