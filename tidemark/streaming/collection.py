"""Periodic collection of snapshots, each profile on its own: a stream of due profiles, collected, derived and stored batch by batch."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import new_path
from tidemark.sources.store import OperationalStore
from tidemark.sources.tables import table

KIND = "workload"
# Rates that have names of their own, and those that tps is the sum of where there is no counter of it.
NAMED, SUMMED = {"queries": "qps", "transactions": "tps"}, ("commits_per_second", "rollbacks_per_second")
_RAW = "profile_id string, engine string, collected_at timestamp, counters map<string,double>, error string"


def collected(due: DataFrame, collect: Callable[[dict], dict]) -> DataFrame:
    """(profile_id, engine, collected_at, counters, error) of due profiles (profile_id, engine, collected_at, and what collect needs).

    collect makes a row into counters by name; whatever it raises is that row's error and no other's.
    """

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    found, error = {str(k): float(v) for k, v in collect(row).items()}, None
                except Exception as e:  # noqa: BLE001 - a profile's failure is a result
                    found, error = None, f"{type(e).__name__}: {e}"
                out.append((row["profile_id"], row["engine"], row["collected_at"], found, error))
            yield pd.DataFrame(out, columns=["profile_id", "engine", "collected_at", "counters", "error"])

    return due.mapInPandas(run, _RAW)


def derived(snapshots: DataFrame, previous: DataFrame) -> DataFrame:
    """snapshots with rates and status, against the snapshot before of the same profile: in the batch or of previous (profile_id, collected_at, data).

    The rate of a counter that the snapshot before has and that didn't fall is its difference a second, to three places.
    partial: the first of a profile or one not later than the one before has no rates; error: not collected, and passed
    over by the next.
    """
    before = previous.select("profile_id", "collected_at", F.from_json("data", "counters map<string,double>")["counters"].alias("counters"), F.lit(True).alias("old"))
    w = Window.partitionBy("profile_id").orderBy("collected_at", F.desc("old"))
    fine = snapshots.filter("error IS NULL").withColumn("old", F.lit(False)).unionByName(before, allowMissingColumns=True)
    fine = fine.withColumn("last", F.lag(F.struct("collected_at", "counters")).over(w)).filter("NOT old").drop("old")
    seconds = (F.unix_micros("collected_at") - F.unix_micros("last.collected_at")) / 1_000_000
    # Up to 0.0005 is half away from zero, as for all rates that aren't negative.
    rate = lambda k, v: F.floor((v - F.element_at("last.counters", k)) / seconds * 1000 + 0.5) / 1000
    grew = F.map_filter("counters", lambda k, v: F.coalesce(v >= F.try_element_at("last.counters", k), F.lit(False)))
    named = lambda k: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv)), k), F.concat(k, F.lit("_per_second")))
    rates = F.transform_keys(F.transform_values(grew, rate), lambda k, _: named(k))
    total = F.round(sum((F.coalesce(F.try_element_at("own", F.lit(n)), F.lit(0.0)) for n in SUMMED[1:]), F.coalesce(F.try_element_at("own", F.lit(SUMMED[0])), F.lit(0.0))), 3)
    fine = fine.withColumn("own", F.when(seconds > 0, rates))
    fine = fine.withColumn("rates", F.when(F.map_contains_key("own", "tps"), F.col("own")).otherwise(F.map_concat("own", F.create_map(F.lit("tps"), total))))
    fine = fine.withColumn("status", F.when(F.col("own").isNull(), "partial").otherwise("ok")).drop("last", "own")
    return fine.unionByName(snapshots.filter("error IS NOT NULL").withColumn("status", F.lit("error")), allowMissingColumns=True)


class Collection:
    """A stream of due profiles into a store; results has a row for each, under the batch that it came in."""

    def __init__(self, spark: SparkSession, path: str, collect: Callable[[dict], dict], retention_days: int | None = None):
        self.spark, self.path, self.collect, self.retention = spark, path.rstrip("/"), collect, retention_days
        self.store = OperationalStore(spark, f"{self.path}/store")

    def _batch(self, due: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        if self.retention is not None:
            # Before the batch and by what earlier ones have left, so that a batch that is run again finds the same.
            newest = self.store.records().filter(F.col("batch") < name).agg(F.max("day")).first()[0]
            if newest:
                self.store.prune(datetime.datetime.strptime(newest, "%Y%m%d") - datetime.timedelta(days=self.retention))
        found = derived(collected(due, self.collect), self.store.previous(KIND, but=name))
        # Written once, under the batch: a batch that is run again replaces its results and its records.
        done = found.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        done.partitionBy("batch").parquet(f"{self.path}/results")
        kept = self.results().filter((F.col("batch") == name) & (F.col("status") != "error"))
        data = F.to_json(F.struct("counters", "rates", "status"))
        self.store.append(kept.select(F.lit(KIND).alias("kind"), "profile_id", "engine", "collected_at", data.alias("data")), name)

    def drain(self, due: DataFrame) -> None:
        """Collects whatever is due now; the next call goes on from there, in this process or another."""
        query = due.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def results(self) -> DataFrame:
        return self.spark.read.schema(f"{_RAW}, rates map<string,double>, status string, batch string").parquet(f"{self.path}/results")


def _counters(row: dict) -> dict:
    """What a profile of the given events answers: counters in its payload; an error event doesn't answer."""
    if row["event_type"] == "error":
        raise ConnectionError("refused")
    return {"queries": float(row["units"]), "k": float(json.loads(row["props"])["k"]), "commits": float(row["units"] // 3)}


def _due(events: DataFrame) -> DataFrame:
    # Units grow with the event's number, and start again from time to time as those of a restarted server do.
    units = (F.col("event_id") % 997 * 10 + F.floor("value")).cast("long")
    return events.select((F.col("user_id") % 25).cast("string").alias("profile_id"), F.lit("any").alias("engine"), F.col("ts").alias("collected_at"), "event_id", "event_type", units.alias("units"), "props")


def run_collection(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> Collection:
    """Events as due profiles that arrive in four parts by time, each drained by itself from the same progress."""
    due, path = _due(table(spark, sf_dir, "events")), new_path(spark, "collection")
    bounds = due.agg(F.min("event_id").alias("a"), (F.max("event_id") + 1).alias("b")).first()
    made = Collection(spark, path, _counters)
    for i in range(arrivals if bounds.a is not None else 0):
        lo, hi = (bounds.a + (bounds.b - bounds.a) * k // arrivals for k in (i, i + 1))
        due.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).write.mode("append").parquet(f"{path}/due")
        made.drain(spark.readStream.schema(due.schema).parquet(f"{path}/due"))
    return made


def _results(s: SparkSession, d: str) -> DataFrame:
    rate = lambda n: F.try_element_at("rates", F.lit(n))
    return run_collection(s, d).results().select("profile_id", "collected_at", "status", rate("qps").alias("qps"), rate("k_per_second").alias("k_rate"), rate("tps").alias("tps"))


def _store(s: SparkSession, d: str) -> tuple[OperationalStore, DataFrame]:
    """Events as records; some lack what a record needs."""
    e = table(s, d, "events")
    data = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{"), F.col("props"))).when(F.col("event_id") % 19 == 0, "").otherwise(F.col("props"))
    records = e.select(F.when(F.col("event_id") % 23 == 0, " ").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 29 != 0, F.col("user_id").cast("string")).alias("profile_id"), F.lit("any").alias("engine"), F.when(F.col("event_id") % 31 != 0, F.col("ts")).alias("collected_at"), data.alias("data"))
    store = OperationalStore(s, new_path(s, "store"))
    store.append(records, "all")
    store.append(records, "all")  # as a job does that is repeated
    return store, records


def _queried(s: SparkSession, d: str) -> DataFrame:
    store, _ = _store(s, d)
    return store.query("click", None, datetime.datetime(2024, 1, 20, 12), 0).select("kind", "profile_id", "collected_at", "data")


def _pruned(s: SparkSession, d: str) -> DataFrame:
    store, _ = _store(s, d)
    store.prune(datetime.datetime(2024, 1, 11, 18))
    return store.records().groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "collection": _results,
    "store_query": _queried,
    "store_retention": _pruned,
    "store_refused": lambda s, d: _store(s, d)[0].rejected().groupBy("defect").agg(F.count(F.lit(1)).alias("n")),
}

_REC = "WITH r AS (SELECT CASE WHEN event_id % 23 = 0 THEN ' ' ELSE event_type END AS kind, CASE WHEN event_id % 29 <> 0 THEN user_id::VARCHAR END AS profile_id, CASE WHEN event_id % 31 <> 0 THEN ts END AS collected_at, CASE WHEN event_id % 17 = 0 THEN '{' || props WHEN event_id % 19 = 0 THEN '' ELSE props END AS data FROM events), m AS (SELECT *, CASE WHEN trim(kind) = '' THEN 'kind' WHEN profile_id IS NULL THEN 'profile_id' WHEN collected_at IS NULL THEN 'collected_at' WHEN data = '' OR NOT json_valid(data) THEN 'data' END AS defect FROM r)"
ORACLE_SQL = {
    "collection": "WITH d AS (SELECT event_id, (user_id % 25)::VARCHAR AS profile_id, ts, event_type = 'error' AS failed, event_id % 997 * 10 + floor(value)::BIGINT AS units, (props->>'$.k')::BIGINT AS k FROM events), f AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000::DOUBLE AS s, lag(units) OVER w AS u0, lag(k) OVER w AS k0 FROM d WHERE NOT failed WINDOW w AS (PARTITION BY profile_id ORDER BY ts)) SELECT profile_id, ts AS collected_at, CASE WHEN s > 0 THEN 'ok' ELSE 'partial' END AS status, CASE WHEN s > 0 AND units >= u0 THEN floor((units - u0)::DOUBLE / s * 1000 + 0.5) / 1000 END AS qps, CASE WHEN s > 0 AND k >= k0 THEN floor((k - k0)::DOUBLE / s * 1000 + 0.5) / 1000 END AS k_rate, CASE WHEN s > 0 THEN CASE WHEN units // 3 >= u0 // 3 THEN floor((units // 3 - u0 // 3)::DOUBLE / s * 1000 + 0.5) / 1000 ELSE 0 END END AS tps FROM f UNION ALL SELECT profile_id, ts, 'error', NULL, NULL, NULL FROM d WHERE failed",
    "store_query": _REC + " SELECT kind, profile_id, collected_at, data FROM m WHERE defect IS NULL AND kind = 'click' AND collected_at >= TIMESTAMP '2024-01-20 12:00:00' ORDER BY collected_at DESC, profile_id, kind, data LIMIT 1000",
    "store_retention": _REC + " SELECT strftime(collected_at, '%Y%m%d') AS day, kind, count(*) AS n FROM m WHERE defect IS NULL AND collected_at >= TIMESTAMP '2024-01-11' GROUP BY 1, 2",
    "store_refused": _REC + " SELECT defect, count(*) AS n FROM m WHERE defect IS NOT NULL GROUP BY 1",
}
