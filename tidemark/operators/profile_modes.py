"""Profiles at three depths over a reproducible sample, and what they propose: code dictionaries and metrics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

# Rows that a mode samples (none: all), and names whose values or minimum and maximum are never shown.
MODES = {"fast": 2000, "standard": 100_000, "deep": None}
SENSITIVE = r"(?i)(email|e_mail|phone|mobile|tel|ssn|passwd|password|passwrd|pwd|token|secret|hash|salt|birth|dob|resident|jumin|주민|전화|이메일|비밀|성명|이름|passport|account_no|acct_no|card_no|cvv|iban|ip_addr|\bip\b|addr|address|주소)"
# Names of code columns, which may have 50 distinct values to be listed where others may have 20.
CODE_LIKE = r"(?i)(_cd$|_code$|_type$|_div$|_flag$|_yn$|status|category|kind|gender|sex|grade|level|state)"
FEW, FEW_CODES, SHOWN_BYTES, SHOWN, COUNTED = 20, 50, 64, 10, 20
# Ends of code columns' names that a dictionary is proposed for, and how a measure is added up.
CODE_ENDS = ("_CD", "_CODE", "_TP", "_TYPE", "_DIV", "_YN", "_STATUS", "_STAT")
MEASURES = {"AMOUNT": "SUM", "COUNT": "SUM", "RATIO": "AVG", "SCORE": "AVG"}
#: Error of an approximate number of distinct values, one standard deviation.
ERROR = 0.02
#: Leading hexadecimal digits of a row's hash that it is counted by before the sample's edge is found.
DIGITS = 4


def least_hashes(df: DataFrame, key: list[str], n: int | None) -> DataFrame:
    """The n rows of least MD5 of their key, whatever the partitions or the run; all for None.

    The rows are counted by the first digits of their hash; of the one class at the edge the hashes are ranked, so that
    neither whole rows are moved nor more than that class sorted. Rows with one key are taken together or not at all.
    """
    if n is None:
        return df
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key)))
    hashes = df.select(digest.alias("h"))
    classes = hashes.groupBy(F.left("h", F.lit(DIGITS)).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    edge = classes.withColumn("upto", F.sum("k").over(Window.orderBy("c"))).filter(F.col("upto") > n).orderBy("c").first()
    if edge is None:
        return df
    left = n - (edge.upto - edge.k)
    inside = hashes.filter(F.left("h", F.lit(DIGITS)) == edge.c).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    last = inside.withColumn("upto", F.sum("k").over(Window.orderBy("h"))).filter(F.col("upto") <= left).agg(F.max("h")).first()[0]
    return df.filter(digest <= (last if last is not None else edge.c))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def profile(df: DataFrame, key: list[str], mode: str = "standard", limit: int | None = None, columns: list[str] | None = None, error: float = ERROR) -> DataFrame:
    """A row for each column: place, column, type, sensitive, sampled, filled, null_ratio, distinct, low, high, shortest, longest, mode.

    From one scan of the sample (MODES, or limit), without a row for each column and value: distinct is approximate, its
    standard error is `error`. fast tells rows and nulls only. low and high are the least and greatest of the
    values as strings, cut to 64 characters, null for sensitive names; shortest and longest are of strings alone.
    """
    df_types = dict(df.dtypes)
    columns = columns or df.columns
    sample = least_hashes(df, key, limit or MODES[mode])
    n, whole = F.count(F.lit(1)), mode != "fast"

    def stats(c: str) -> Column:
        hidden = bool(re.search(SENSITIVE, c))
        show = whole and not hidden
        size = F.length(c) if whole and df_types[c] == "string" else None
        none = F.lit(None)
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(df_types[c]).alias("type"),
            F.lit(hidden).alias("sensitive"),
            n.alias("sampled"),
            F.count(c).alias("filled"),
            (F.approx_count_distinct(c, error) if whole else none.cast("long")).alias("distinct"),
            (F.left(F.min(_text(c)), F.lit(SHOWN_BYTES)) if show else none.cast("string")).alias("low"),
            (F.left(F.max(_text(c)), F.lit(SHOWN_BYTES)) if show else none.cast("string")).alias("high"),
            (F.min(size) if size is not None else none.cast("int")).alias("shortest"),
            (F.max(size) if size is not None else none.cast("int")).alias("longest"),
        )

    rows = sample.agg(F.array(*map(stats, columns)).alias("s")).select(F.posexplode("s").alias("place", "s")).select("place", "s.*")
    ratio = F.coalesce(half_up((F.col("sampled") - F.col("filled")) / F.nullif("sampled", F.lit(0)), 4), F.lit(0.0))
    return rows.withColumn("null_ratio", ratio).withColumn("mode", F.lit(mode))


def listed_values(df: DataFrame, profiled: DataFrame, least: int = 2, few: int = FEW, few_codes: int = FEW_CODES) -> DataFrame:
    """(column, rank, value, n): the commonest values of the columns that have few: 20 distinct, 50 where the name is a code's.

    The profile says which columns to count at all; the exact number of values decides. Of the 20 commonest those with
    at least `least` rows are listed, up to ten; ties by value; values are cut to 64 bytes of UTF-8. Sensitive names
    have none.
    """
    slack = lambda n: n * (1 + 5 * ERROR) + 1
    code = lambda c: bool(re.search(CODE_LIKE, c))
    found = [r.column for r in profiled.filter(~F.col("sensitive") & (F.col("filled") > 0)).collect() if r.distinct is not None and r.distinct <= slack(few_codes if code(r.column) else few)]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, rank long, value string, n long")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _text(c).alias("value"), F.lit(few_codes if code(c) else few).alias("most")) for c in found))).alias("x")).select("x.*").filter("value IS NOT NULL")
    counts = long.groupBy("column", "most", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    ranked = counts.withColumn("k", F.count(F.lit(1)).over(w)).filter("k <= most").withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("long"))
    # A cut may end within a character, whose bytes are then left out.
    cut = F.try_validate_utf8(F.left(F.encode("value", "utf-8"), F.lit(SHOWN_BYTES)).cast("string"))
    shown = F.when(F.octet_length("value") <= SHOWN_BYTES, F.col("value")).otherwise(F.coalesce(cut, F.regexp_replace(F.make_valid_utf8(F.left(F.encode("value", "utf-8"), F.lit(SHOWN_BYTES)).cast("string")), "�+$", "")))
    return ranked.filter((F.col("rank") <= COUNTED) & (F.col("n") >= least) & (F.col("rank") <= SHOWN)).select("column", "rank", shown.alias("value"), "n")


def code_candidates(profiled: DataFrame, values: DataFrame, known: list[str] = (), semantic: dict[str, str] | None = None) -> DataFrame:
    """(column, dictionary, codes, confidence): a code dictionary for each column that reads like codes and has values to begin with.

    profiled and values as profile and listed_values give them; known: columns that have a dictionary already. By the
    semantic type CODE 0.75, by the end of the name 0.70, by at most 20 distinct values 0.60; sensitive columns never.
    """
    up, types = F.upper("column"), semantic or {}
    typed = F.col("column").isin([c for c, t in types.items() if t == "CODE"])
    named = reduce(lambda a, b: a | b, (up.endswith(e) for e in CODE_ENDS))
    conf = F.when(typed, 0.75).when(named, 0.7).when(F.col("distinct").between(1, FEW), 0.6)
    codes = values.filter("trim(value) <> ''").groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("value").alias("v")))), lambda x: x["v"]), ",").alias("codes"))
    rows = profiled.filter(~F.col("sensitive") & ~F.col("column").isin(list(known))).withColumn("confidence", conf).filter("confidence IS NOT NULL")
    return rows.join(codes, "column").select("column", F.lower(F.concat("column", F.lit("_cd"))).alias("dictionary"), "codes", "confidence")


def metric_candidates(profiled: DataFrame, name: str, semantic: dict[str, str], covered: list[str] = ()) -> DataFrame:
    """(column, metric, expression, dimensions, confidence): an aggregate for each column of a measure that no metric has yet.

    Amounts and counts are summed, ratios and scores averaged; covered holds columns, or table.column, of known metrics.
    dimensions: the first three columns that are dates or codes, by their order.
    """
    kinds = F.create_map(*(F.lit(x) for c, t in semantic.items() for x in (c, MEASURES.get(t, ""))))
    up = F.upper("column")
    dimension = F.col("type").rlike("date|timestamp") | reduce(lambda a, b: a | b, (up.endswith(e) for e in ("_DT", "_DATE", "_CD", "_TYPE", "_DIV"))) | F.col("column").isin([c for c, t in semantic.items() if t == "CODE"])
    dims = profiled.filter(dimension).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "column"))), 1, 3), lambda x: x["column"]), ",").alias("dimensions"))
    taken = {c.lower() for c in covered}
    free = ~F.lower("column").isin([*taken]) & ~F.lower(F.concat(F.lit(f"{name}."), F.col("column"))).isin([*taken])
    rows = profiled.withColumn("agg", F.try_element_at(kinds, F.col("column"))).filter((F.coalesce("agg", F.lit("")) != "") & free)
    return rows.crossJoin(F.broadcast(dims)).select("column", F.lower(F.concat("agg", F.lit("_"), F.col("column"))).alias("metric"), F.concat("agg", F.lit(f"({name}."), F.col("column"), F.lit(")")).alias("expression"), "dimensions", F.lit(0.7).alias("confidence"))


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(s: SparkSession, d: str) -> DataFrame:
    """lineitem with columns that may be null, or have names that hide them."""
    return table(s, d, "lineitem").select(*_KEY, F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("return_flag"), F.col("l_linestatus").alias("line_status"), F.concat("l_returnflag", F.lit("@x")).alias("owner_email"), "l_shipdate", "l_quantity")


_SEM = {"o_totalprice": "AMOUNT", "o_custkey": "COUNT", "o_orderstatus": "CODE", "o_orderkey": "NAME"}


def _orders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(s, d, "orders")
    return orders, profile(orders, ["o_orderkey"], "deep")


QUERIES = {
    "profile_fast": lambda s, d: profile(_lines(s, d), _KEY, "fast"),
    "profile_standard": lambda s, d: profile(_lines(s, d), _KEY, "standard", 5000).drop("distinct"),
    "profile_deep": lambda s, d: profile(_lines(s, d), _KEY, "deep").drop("distinct"),
    "listed_values": lambda s, d: listed_values(_lines(s, d), profile(_lines(s, d), _KEY, "deep")),
    "code_candidates": lambda s, d: code_candidates(_orders(s, d)[1], listed_values(*_orders(s, d)), ["o_custkey"], _SEM),
    "metric_candidates": lambda s, d: metric_candidates(_orders(s, d)[1], "orders", _SEM, ["orders.o_custkey"]),
}

_SQL_LINES = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 10 THEN l_returnflag END AS return_flag, l_linestatus AS line_status, l_returnflag || '@x' AS owner_email, l_shipdate, l_quantity, md5(concat_ws(chr(31), l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)) AS h FROM lineitem)"
_TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "return_flag": "string", "line_status": "string", "owner_email": "string", "l_shipdate": "timestamp_ntz", "l_quantity": "double"}


def _sql(mode: str, n: int | None) -> str:
    edge = f", k AS (SELECT h, sum(count(*)) OVER (ORDER BY h) AS upto FROM x GROUP BY h), s AS (SELECT x.* FROM x JOIN k USING (h) WHERE upto <= {n})" if n else ", s AS (SELECT * FROM x)"
    rows = []
    for place, (c, t) in enumerate(_TYPES.items()):
        hidden, whole = c == "owner_email", mode != "fast"
        show = whole and not hidden
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if t == "timestamp_ntz" else f"{c}::VARCHAR"
        low, high = (f"left(min({text}), 64)", f"left(max({text}), 64)") if show else ("NULL::VARCHAR", "NULL::VARCHAR")
        sizes = (f"min(length({c}))", f"max(length({c}))") if whole and t == "string" else ("NULL", "NULL")
        rows.append(f"SELECT {place} AS place, '{c}' AS \"column\", '{t}' AS type, {hidden} AS sensitive, count(*) AS sampled, count({c}) AS filled, {'NULL AS \"distinct\", ' if mode == 'fast' else ''}{low} AS low, {high} AS high, {sizes[0]}::INT AS shortest, {sizes[1]}::INT AS longest, floor((count(*) - count({c})) / count(*) * 10000 + 0.5) / 10000 AS null_ratio, '{mode}' AS mode FROM s")
    return f"WITH {_SQL_LINES}{edge} " + " UNION ALL ".join(rows)


ORACLE_SQL = {
    "profile_fast": _sql("fast", 2000),
    "profile_standard": _sql("standard", 5000),
    "profile_deep": _sql("deep", None),
    "listed_values": f"WITH {_SQL_LINES}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n, {most} AS most FROM x WHERE {c} IS NOT NULL GROUP BY 2" for c, most in (("l_linenumber", 20), ("l_suppkey", 20), ("return_flag", 50), ("line_status", 50))) + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY \"column\") AS k FROM v) SELECT \"column\", rank, value, n FROM r WHERE k <= most AND rank <= 10 AND n >= 2",
    "code_candidates": "WITH v AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n, 0.75 AS confidence FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), 0.6 FROM orders GROUP BY 2) SELECT \"column\", \"column\" || '_cd' AS dictionary, string_agg(value, ',' ORDER BY n DESC, value) AS codes, max(confidence)::DOUBLE AS confidence FROM v WHERE n >= 2 GROUP BY 1",
    "metric_candidates": "SELECT 'o_totalprice' AS \"column\", 'sum_o_totalprice' AS metric, 'SUM(orders.o_totalprice)' AS expression, 'o_orderstatus,o_orderdate' AS dimensions, 0.7::DOUBLE AS confidence FROM orders LIMIT 1",
}
