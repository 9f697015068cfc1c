"""Comparing and merging versions of a table, and hashes of rows and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def versions(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two versions of orders: the old lacks every tenth key, the new every fifteenth, and some statuses differ."""
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    old = orders.filter("o_orderkey % 10 <> 3").select(*cols)
    new = orders.filter("o_orderkey % 15 <> 4").select("o_orderkey", F.when(F.expr("o_orderkey % 11 = 0"), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return old, new


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, kind): added, removed, or changed in any other column, a null differing from a value; equal rows don't come."""
    a, b = (d.select(key, F.struct(*(c for c in old.columns if c != key)).alias(side)) for d, side in ((old, "old"), (new, "new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind")).filter("kind is not null")


def upsert(base: DataFrame, update: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """base with the facts of update where it has the key and new keys added; other columns keep base's values."""
    u = update.select(key, *(F.col(c).alias(f"_{c}") for c in facts))
    rest = [c for c in base.columns if c not in facts and c != key]
    return base.join(u, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in facts), *rest)


def drift(local: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Keys by class: local_gap, external_gap, conflict (case doesn't count; a null differs from a value) or same, with their number."""
    m = local.select(key, F.struct(F.lower(column)).alias("a")).join(other.select(key, F.struct(F.lower(column)).alias("b")), key, "full_outer")
    cls = F.when(F.col("a").isNull(), "local_gap").when(F.col("b").isNull(), "external_gap").when(~F.col("a").eqNullSafe(F.col("b")), "conflict").otherwise("same")
    return m.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def keyed_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first 16 hex digits of sha256 over the trimmed columns, each with its length before it, -1 for a null."""
    part = lambda c: F.coalesce(F.concat(F.length(F.trim(c)).cast("string"), F.lit(":"), F.trim(c)), F.lit("-1:"))
    return df.select("*", F.substring(F.sha2(F.concat(*map(part, columns)), 256), 1, 16).alias("hash"))


def chain_breaks(log: DataFrame) -> DataFrame:
    """Rows of (chain, seq, prev, payload, hash) whose prev isn't the hash of the row before, whose hash isn't sha256(prev, line
    feed, payload), or whose seq leaves a gap; by chain, their number and the first."""
    w = Window.partitionBy("chain").orderBy("seq")
    own = F.sha2(F.concat("prev", F.lit("\n"), "payload"), 256)
    bad = (F.coalesce(F.lag("hash").over(w), F.lit("")) != F.col("prev")) | (own != F.col("hash")) | (F.row_number().over(w) != F.col("seq"))
    return log.withColumn("bad", bad).groupBy("chain").agg(F.count_if("bad").alias("breaks"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_break"))


def chained(events: DataFrame) -> DataFrame:
    """Events as audit chains of a user and day, each payload canonical JSON and each hash over the hash before and the payload.

    After that every 97th payload is changed, which a check has to find.
    """
    payload = F.to_json(F.struct("event_id", "event_type", "props"))
    rows = events.groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", payload.alias("payload")))).alias("rows"))

    def step(acc, row):
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.lit(""))
        return F.concat(acc, F.array(F.struct(prev.alias("prev"), row["event_id"].alias("event_id"), row["payload"].alias("payload"), F.sha2(F.concat(prev, F.lit("\n"), row["payload"]), 256).alias("hash"))))

    links = F.aggregate("rows", F.array().cast("array<struct<prev:string,event_id:bigint,payload:string,hash:string>>"), step)
    out = rows.select(F.concat_ws("/", F.col("user").cast("string"), F.col("day").cast("string")).alias("chain"), F.posexplode(links).alias("i", "x"))
    changed = F.when(F.expr("x.event_id % 97 = 5"), F.concat("x.payload", F.lit(" "))).otherwise(F.col("x.payload"))
    return out.select("chain", (F.col("i") + 1).alias("seq"), "x.prev", changed.alias("payload"), "x.hash")


def masked(df: DataFrame, columns: list[str], mask: str = "***") -> DataFrame:
    """The columns as the mask, nulls too; names are compared without case."""
    hide = {c.lower() for c in columns}
    return df.select(*(F.lit(mask).alias(c) if c.lower() in hide else c for c in df.columns))


def capped(df: DataFrame, order: str, rows: int, size: int) -> DataFrame:
    """The first rows in order within a row cap and a cap on the running size of cells: name + 8 + length (strings), 4 (null) or 16."""
    cell = [F.lit(len(c) + 8) + F.when(F.col(c).isNull(), 4).otherwise(F.length(c) if t == "string" else F.lit(16)) for c, t in df.dtypes]
    first = df.withColumn("_size", sum(cell[1:], cell[0])).orderBy(order).limit(rows)
    return first.withColumn("_sum", F.sum("_size").over(Window.orderBy(order))).filter(F.col("_sum") <= size).drop("_size", "_sum")


_o = lambda s, d: table(s, d, "orders")

QUERIES = {
    "snapshot_diff": lambda s, d: diff(*versions(_o(s, d)), "o_orderkey"),
    "upsert_merge": lambda s, d: upsert(*versions(_o(s, d)), "o_orderkey", ["o_orderstatus"]),
    "set_except": lambda s, d: versions(_o(s, d))[0].exceptAll(versions(_o(s, d))[1]),
    "drift_classes": lambda s, d: drift(*versions(_o(s, d)), "o_orderkey", "o_orderstatus"),
    "sql_hash": lambda s, d: keyed_hash(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"]),
    "chain_verify": lambda s, d: chain_breaks(chained(table(s, d, "events"))),
    "mask_columns": lambda s, d: masked(table(s, d, "customer"), ["C_NAME", "c_acctbal"]),
    "result_caps": lambda s, d: capped(table(s, d, "customer"), "c_custkey", 1000, 100_000),
}

_V = "WITH old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 15 <> 4) "

ORACLE_SQL = {
    "snapshot_diff": _V + "SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority THEN 'changed' END AS kind FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey) WHERE kind IS NOT NULL",
    "upsert_merge": _V + "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, a.o_orderpriority FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey",
    "set_except": _V + "SELECT * FROM old EXCEPT ALL SELECT * FROM new",
    "drift_classes": _V + "SELECT CASE WHEN a.o_orderkey IS NULL THEN 'local_gap' WHEN b.o_orderkey IS NULL THEN 'external_gap' WHEN lower(a.o_orderstatus) <> lower(b.o_orderstatus) THEN 'conflict' ELSE 'same' END AS class, count(*) AS n FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey GROUP BY 1",
    "sql_hash": "SELECT p_partkey, p_name, p_brand, substr(sha256(length(trim(p_name)) || ':' || trim(p_name) || length(trim(p_brand)) || ':' || trim(p_brand)), 1, 16) AS hash FROM part",
    "chain_verify": "WITH e AS (SELECT user_id::VARCHAR || '/' || ts::DATE::VARCHAR AS chain, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS seq FROM events) SELECT chain, count(*) FILTER (WHERE event_id % 97 = 5) AS breaks, min(CASE WHEN event_id % 97 = 5 THEN seq END) AS first_break FROM e GROUP BY chain",
    "mask_columns": "SELECT c_custkey, '***' AS c_name, c_nationkey, '***' AS c_acctbal, c_mktsegment FROM customer",
    "result_caps": "WITH s AS (SELECT *, 17 + 16 + 14 + length(c_name) + 19 + 16 + 17 + 16 + 20 + length(c_mktsegment) AS size, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer), r AS (SELECT *, sum(size) OVER (ORDER BY c_custkey) AS total FROM s WHERE rn <= 1000) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM r WHERE total <= 100000",
}
