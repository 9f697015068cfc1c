"""Query shapes: counts, joins, top-k, period comparisons, ratios, buckets and two-stage aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import table

_money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def top_n_per_group(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """Ranked before the shuffle as well: Spark limits each group within tasks first."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rn") <= n)


def monthly(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(_money("o_totalprice").alias("total"))


def month_over_month(orders: DataFrame) -> DataFrame:
    """Change against the month before in the series; the window holds a row for each month."""
    m = monthly(orders)
    prev = F.lag("total").over(Window.orderBy("ym"))
    return m.select("ym", "total", prev.alias("previous"), F.floor((F.col("total") - prev) / prev * 10000 + 0.5).cast("long").alias("change_bp"))


def year_over_year(orders: DataFrame) -> DataFrame:
    """Change against the same month of the year before, by a self join."""
    m = monthly(orders).withColumn("d", F.to_date(F.concat("ym", F.lit("-01"))))
    before = m.select(F.add_months("d", 12).alias("d"), F.col("total").alias("last_year"))
    return m.join(before, "d", "left").select("ym", "total", "last_year")


def _orders_of_nation(s, d):
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    o = table(s, d, "orders").select("o_custkey", "o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


QUERIES = {
    "count_filter": lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").agg(F.count(F.lit(1)).alias("n")),
    "group_count_order": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority"),
    "topk_join": lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_custkey").limit(10),
    "three_way_join_filter": lambda s, d: _orders_of_nation(s, d).filter("c_mktsegment = 'BUILDING'").groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), _money("o_totalprice").alias("total")),
    "null_filter_count": lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_orderkey is null").agg(F.count(F.lit(1)).alias("n")),
    "anti_join_customers": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "sum_join_top1": lambda s, d: _orders_of_nation(s, d).groupBy("n_name").agg(_money("o_totalprice").alias("total")).orderBy(F.desc("total"), "n_name").limit(1),
    "avg_by_group": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")) / F.count(F.lit(1))).cast("decimal(18,4)").cast("double").alias("avg_quantity"), F.count(F.lit(1)).alias("n")),
    "top_n_per_group": lambda s, d: top_n_per_group(table(s, d, "orders"), "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderpriority", "rn", "o_orderkey", "o_totalprice"),
    "mom_change": lambda s, d: month_over_month(table(s, d, "orders")),
    "yoy_change": lambda s, d: year_over_year(table(s, d, "orders")),
    "ratio_distinct": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.try_divide(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).cast("double"), F.count_distinct("o_custkey")).alias("ratio")),
    "distribution_buckets": lambda s, d: table(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "two_stage_agg": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("customers")),
    "pivot_status": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == x).alias(f"n_{x.lower()}") for x in "FOP")),
    "ordered_list": lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations")),
    "union_scopes": lambda s, d: table(s, d, "orders").agg(F.lit("orders").alias("scope"), F.count(F.lit(1)).alias("n")).unionByName(table(s, d, "customer").agg(F.lit("customer").alias("scope"), F.count(F.lit(1)).alias("n"))),
}

_NATION = " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
_MONTHS = "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1) "

ORACLE_SQL = {
    "count_filter": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "group_count_order": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1",
    "topk_join": "SELECT c_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY n DESC, c_custkey LIMIT 10",
    "three_way_join_filter": "SELECT r_name, n_name, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total" + _NATION + "WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2",
    "null_filter_count": "SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "anti_join_customers": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "sum_join_top1": "SELECT n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total" + _NATION + "GROUP BY 1 ORDER BY total DESC, n_name LIMIT 1",
    "avg_by_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 4) AS avg_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "top_n_per_group": "SELECT * FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderkey, o_totalprice FROM orders) WHERE rn <= 3",
    "mom_change": _MONTHS + "SELECT ym, total, lag(total) OVER (ORDER BY ym) AS previous, floor((total - lag(total) OVER (ORDER BY ym)) / lag(total) OVER (ORDER BY ym) * 10000 + 0.5)::BIGINT AS change_bp FROM m",
    "yoy_change": _MONTHS + "SELECT a.ym, a.total, b.total AS last_year FROM m a LEFT JOIN m b ON (b.ym || '-01')::DATE + INTERVAL 12 MONTH = (a.ym || '-01')::DATE",
    "ratio_distinct": "SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END)::DOUBLE / nullif(count(DISTINCT o_custkey), 0) AS ratio FROM orders GROUP BY 1",
    "distribution_buckets": "SELECT floor(o_totalprice / 50000)::BIGINT AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "two_stage_agg": "SELECT k, count(*) AS customers FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY k",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "ordered_list": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "union_scopes": "SELECT 'orders' AS scope, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
}
