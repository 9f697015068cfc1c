"""Column profiles: counts, null ratios, distinct values, string minimum and maximum, top values and string shapes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

# Names whose values are never shown.
SENSITIVE = r"(?i)(passw|pwd|secret|token|api_?key|e_?mail|phone|mobile|_tel|tel_|ssn|rrn|passport|license_no|card|account_no|acct_no|iban|addr|zip|birth|dob|_ip|ip_)"


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column, from one scan; minimum and maximum are by string order of the first 64 characters, and null where the name is sensitive."""
    n = F.count(F.lit(1))
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            n.alias("rows"),
            F.count(c).alias("filled"),
            F.count_distinct(c).alias("distinct"),
            *(F.lit(None).cast("string").alias(x) if hidden else f(F.substring(F.col(c).cast("string"), 1, 64)).alias(x) for x, f in (("low", F.min), ("high", F.max))),
        )
        for c in columns
        for hidden in [bool(re.search(SENSITIVE, c))]
    ]
    out = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumn("null_ratio", F.coalesce(half_up((F.col("rows") - F.col("filled")) / F.nullif("rows", F.lit(0)), 4), F.lit(0.0)))


def top_values(df: DataFrame, columns: list[str], most_distinct: int = 50, least: int = 2, n: int = 10) -> DataFrame:
    """The commonest values of columns of few distinct values: count descending, value ascending.

    Columns with sensitive names are left out. An approximate count of distinct values comes first, so that only columns
    near the limit are counted value by value, all of them in one pass; the exact count then decides.
    """
    columns = [c for c in columns if not re.search(SENSITIVE, c)]
    about = df.agg(*(F.approx_count_distinct(c, 0.05).alias(c) for c in columns)).first() if columns else ()
    columns = [c for c, k in zip(columns, about) if k <= 2 * most_distinct]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rank long, value string, n long")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.substring(F.col(c).cast("string"), 1, 64).alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= most_distinct).select("column")
    ranked = counts.join(few, "column").filter(F.col("n") >= least).groupBy("column").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), 1, n).alias("v"))
    return ranked.select("column", F.posexplode("v").alias("i", "x")).select("column", (F.col("i") + 1).cast("long").alias("rank"), F.col("x.value").alias("value"), (-F.col("x.m")).alias("n"))


def pattern(c):
    """Classes of characters with runs folded: A upper, a lower, 9 digit, others as they are."""
    return reduce(lambda x, r: F.regexp_replace(x, *r), [("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "9")], c)


def string_shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shortest and longest value and the commonest pattern of each column, ties by the pattern; counted by pattern before it is ranked."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*").filter("value is not null")
    by = long.groupBy("column", pattern(F.col("value")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length("value")).alias("lo"), F.max(F.length("value")).alias("hi"))
    return by.groupBy("column").agg(F.min("lo").cast("long").alias("shortest"), F.max("hi").cast("long").alias("longest"), F.min(F.struct((-F.col("n")).alias("m"), "pattern")).alias("p")).select("column", "shortest", "longest", F.col("p.pattern").alias("pattern"), (-F.col("p.m")).alias("n"))


def null_heavy(df: DataFrame, share: float = 0.8, least_rows: int = 5) -> DataFrame:
    """Columns that are null in at least the share of the rows, where there are least_rows."""
    n = F.count(F.lit(1))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.floor(F.count_if(F.col(c).isNull()) * 100 / n).cast("long").alias("percent"), n.alias("n")) for c in df.columns))
    return df.agg(parts.alias("s")).select(F.explode("s").alias("s")).select("s.*").filter((F.col("percent") >= share * 100) & (F.col("n") >= least_rows)).drop("n")


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key, ties by the least value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("x")).select(key, F.col(f"x.{value}").alias(value), (-F.col("x.m")).alias("n"))


_L = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_linenumber"]
_TOP = ["o_orderstatus", "o_orderpriority", "o_custkey"]

QUERIES = {
    "column_profile": lambda s, d: column_profile(table(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "top_values": lambda s, d: top_values(table(s, d, "orders").withColumn("owner_email", F.col("o_orderstatus")), [*_TOP, "owner_email"]),
    "string_shape": lambda s, d: string_shape(table(s, d, "customer"), ["c_name", "c_mktsegment"]),
    "null_heavy": lambda s, d: null_heavy(table(s, d, "customer").join(table(s, d, "orders").filter("o_totalprice > 499000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")),
    "modal_value": lambda s, d: modal_value(table(s, d, "orders"), "o_custkey", "o_orderpriority"),
}

_P = "SELECT '{0}' AS \"column\", count(*) AS rows, count({0}) AS filled, count(DISTINCT {0}) AS \"distinct\", min(left({0}::VARCHAR, 64)) AS low, max(left({0}::VARCHAR, 64)) AS high, floor((count(*) - count({0})) / count(*) * 10000 + 0.5) / 10000 AS null_ratio FROM customer"
_PAT = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g')"

ORACLE_SQL = {
    "column_profile": " UNION ALL ".join(_P.format(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "top_values": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", left({c}::VARCHAR, 64) AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2" for c in _TOP) + "), r AS (SELECT *, count(*) OVER (PARTITION BY \"column\") AS k FROM c), q AS (SELECT \"column\", row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank, value, n FROM r WHERE k <= 50 AND n >= 2) SELECT * FROM q WHERE rank <= 10",
    "string_shape": "WITH v AS (SELECT 'c_name' AS \"column\", c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer), p AS (SELECT \"column\", " + _PAT.format("value") + " AS pattern, count(*) AS n, min(length(value)) AS lo, max(length(value)) AS hi FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, pattern) AS k FROM p) SELECT \"column\", min(lo)::BIGINT AS shortest, max(hi)::BIGINT AS longest, max(CASE WHEN k = 1 THEN pattern END) AS pattern, max(CASE WHEN k = 1 THEN n END) AS n FROM r GROUP BY 1",
    "null_heavy": "WITH j AS (SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 499000) o ON c_custkey = o_custkey), u AS (SELECT 'c_custkey' AS \"column\", floor(count(*) FILTER (WHERE c_custkey IS NULL) * 100 / count(*))::BIGINT AS percent FROM j UNION ALL SELECT 'o_orderkey', floor(count(*) FILTER (WHERE o_orderkey IS NULL) * 100 / count(*))::BIGINT FROM j UNION ALL SELECT 'o_orderstatus', floor(count(*) FILTER (WHERE o_orderstatus IS NULL) * 100 / count(*))::BIGINT FROM j) SELECT * FROM u WHERE percent >= 80",
    "modal_value": "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c) SELECT o_custkey, o_orderpriority, n FROM r WHERE k = 1",
}
