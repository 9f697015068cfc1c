"""What is learnt from logged feedback: golden candidates, rules that recur, and the judgement of golden cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import settled
from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

# The least version of a feedback record, and the outcomes that prove a query.
VERSION, PROVEN = 2, ("success", "corrected")


def eligible(records: DataFrame, dataset: str, tenant: str = "") -> DataFrame:
    """Records (schema_version, dataset_id, tenant_id, fingerprint, trust_status, review_status) that may be learnt from.

    Approved, trusted, of this dataset and, if one is given, of this tenant; whatever is null counts against a record.
    """
    sure = (F.col("schema_version") >= VERSION) & (F.col("dataset_id") == dataset) & (F.col("fingerprint") != "") & (F.lower("trust_status") == "trusted") & (F.lower("review_status") == "approved")
    return records.filter(sure & (F.col("tenant_id") == tenant) if tenant else sure)


def normal_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r]+", " "))


def normal_sql(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[\t\n\r]", " ")), ";+$", ""), " +", " "))


def first_of_either(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that share none of their keys with an earlier row that is kept; order is unique, keys aren't null.

    A row is kept only if no kept row before it has one of its keys, in whichever column: what one pass in order would
    keep. In rounds: a row that is the first undecided one for all of its keys is kept, and whoever shares a key with it
    is out; rows between the two wait. Keys are folded to their first row in each task, so that a key of any number
    of rows doesn't gather in one, and rows with the same keys are decided by the first of them before all.
    """
    some = rows.groupBy(*keys).agg(F.min(order).alias(order))
    undecided = settled(some.select(order, F.explode(F.array_distinct(F.array(*keys))).alias("key"), F.size(F.array_distinct(F.array(*keys))).alias("n")))
    kept = []
    while not undecided.isEmpty():
        first = undecided.groupBy("key").agg(F.min(F.struct(order, "n")).alias("x")).select("key", "x.*")
        won = settled(first.withColumn("won", F.count(F.lit(1)).over(Window.partitionBy(order))).filter("won = n").select("key", order))
        kept.append(won.select(order).distinct())
        out = undecided.join(won.select("key"), "key", "left_semi").select(order).distinct()
        undecided = settled(undecided.join(out, order, "left_anti"))
    if not kept:
        return rows.limit(0)
    return rows.join(reduce(DataFrame.unionByName, kept), order, "left_semi")


def golden_candidates(records: DataFrame, golden: DataFrame, dataset: str, tenant: str = "", order: str = "seq", limit: int | None = 50) -> DataFrame:
    """(order, id, question, sql, recorded_at) of eligible records that ran and succeeded and aren't golden (question, sql) yet.

    The corrected SQL counts, or the generated one where there is none. Of records with the same question or the same SQL,
    but for case and blanks, the first in order is taken (first_of_either); limit takes the first so many of all.
    """
    sql, question = F.coalesce(F.nullif(F.trim("final_sql"), F.lit("")), F.trim("generated_sql")), F.trim("question")
    good = eligible(records, dataset, tenant).filter(F.lower("outcome").isin(*PROVEN) & F.coalesce(F.col("executed"), F.lit(True)))
    good = good.select(order, "id", question.alias("question"), sql.alias("sql"), "recorded_at").filter("question <> '' AND sql <> ''")
    good = good.withColumn("asked", normal_question(F.col("question"))).withColumn("said", normal_sql(F.col("sql")))
    known = lambda c, f: golden.filter(F.col(c) != "").select(f(F.col(c)).alias("known")).distinct()
    new = good.join(known("question", normal_question), F.col("asked") == F.col("known"), "left_anti").join(known("sql", normal_sql), F.col("said") == F.col("known"), "left_anti")
    found = first_of_either(new, ["asked", "said"], order).drop("asked", "said")
    return found if limit is None else found.orderBy(order).limit(limit)


def learned_rules(records: DataFrame, log: DataFrame, order: str = "seq", least: int = 3, slow_ms: int = 5000) -> DataFrame:
    """(type, code, table, column, replacement, n, avg_ms): what recurs `least` times or more in feedback and in the log.

    records: fingerprint, outcome, errors (array of code, table, column), generated_tables, final_tables,
    generated_columns, final_columns (arrays of names; columns as table.column); log: tables (array), elapsed_ms,
    success, error_code. Only the first record of a fingerprint counts. recurring_error: an error of the same code,
    table and column; table_correction and column_correction: corrected records whose SQL lost exactly one name and
    won exactly one; slow_query: successful calls of slow_ms or more, by table; recurring_exec_error: failed calls but
    cancelled ones, by code and table.
    """
    names = [c for c in records.columns if c not in ("fingerprint", order)]
    once = records.groupBy("fingerprint").agg(F.min_by(F.struct(*names), order).alias("x")).select("x.*")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    errors = once.select(F.explode("errors").alias("e")).select("e.*").filter("code <> ''").select(F.lit("recurring_error").alias("type"), "code", empty("table"), empty("column"))
    fixed = once.filter(F.lower("outcome") == "corrected")

    def swaps(kind: str) -> DataFrame:
        lost, won = F.array_except(f"generated_{kind}", f"final_{kind}"), F.array_except(f"final_{kind}", f"generated_{kind}")
        return fixed.filter((F.size(lost) == 1) & (F.size(won) == 1)).select(F.get(lost, F.lit(0)).alias("lost"), F.get(won, F.lit(0)).alias("won"))

    bare = lambda c: F.substring_index(c, ".", -1)
    tables = swaps("tables").select(F.lit("table_correction").alias("type"), F.col("lost").alias("table"), F.col("won").alias("replacement"))
    columns = swaps("columns").groupBy("lost", "won").agg(F.count(F.lit(1)).alias("n")).select(F.lit("column_correction").alias("type"), F.regexp_replace("lost", r"\.[^.]*$", "").alias("table"), bare("lost").alias("column"), bare("won").alias("replacement"), "n")
    calls = log.select(F.explode(F.array_distinct("tables")).alias("table"), "elapsed_ms", "success", "error_code")
    slow = calls.filter(F.col("success") & (F.col("elapsed_ms") >= slow_ms)).select(F.lit("slow_query").alias("type"), "table", F.col("elapsed_ms").alias("ms"))
    failed = calls.filter(~F.col("success") & (F.col("error_code") != "") & (F.col("error_code") != "CANCELED")).select(F.lit("recurring_exec_error").alias("type"), F.col("error_code").alias("code"), "table")
    kinds = [("type", "string"), ("code", "string"), ("table", "string"), ("column", "string"), ("replacement", "string"), ("ms", "bigint")]
    whole = lambda df: df.select(*(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds))
    counted = reduce(DataFrame.unionByName, map(whole, (errors, tables, slow, failed))).groupBy(*(c for c, _ in kinds[:-1])).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("ms") / F.count(F.lit(1))).cast("long").alias("avg_ms"))
    # Columns of different tables with the same bare replacement are different rules.
    return counted.unionByName(columns, allowMissingColumns=True).filter(F.col("n") >= least)


def evaluate(cases: DataFrame, ranked: DataFrame, columns: DataFrame, metrics: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each golden case: table_hit, table_rank, column_recall, metric_hit, join_path_ok, row_sanity_ok, missing.

    cases: case, tables, columns, metrics (arrays of what is expected), executed (its SQL ran), rows, min_rows, max_rows;
    ranked: case, table, rank; columns: case, column; metrics: metric (those that resolve); paths: a, b (tables that
    join, either way). table_rank is the best of an expected table. Nothing expected is all found. Every two expected
    tables must join. row_sanity_ok is null unless rows came and a bound is set. missing lists kind:name, sorted.
    """

    def parts(c: str, name: str) -> DataFrame:
        return cases.select("case", F.explode(F.array_distinct(c)).alias(name))

    missed = lambda kind, name: F.when(~F.col("hit"), F.concat(F.lit(kind), name)).alias("miss")
    best = ranked.groupBy("case", "table").agg(F.min("rank").alias("rank"))
    t = parts("tables", "table").join(best, ["case", "table"], "left").withColumn("hit", F.col("rank").isNotNull())
    c = parts("columns", "column").join(columns.select("case", "column").distinct().withColumn("has", F.lit(True)), ["case", "column"], "left").withColumn("hit", F.col("has").isNotNull())
    m = parts("metrics", "metric").join(metrics.select("metric").distinct().withColumn("has", F.lit(True)), "metric", "left").withColumn("hit", F.col("has").isNotNull())
    both = paths.select("a", "b").unionByName(paths.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("has", F.lit(True))
    pair = F.explode(F.flatten(F.transform("tables", lambda a, i: F.transform(F.filter("tables", lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    j = cases.select("case", pair.alias("p")).select("case", "p.*").join(both, ["a", "b"], "left").withColumn("hit", F.col("has").isNotNull() | (F.col("a") == F.col("b")))
    sane = F.when(F.col("executed") & F.col("rows").isNotNull() & (F.col("min_rows").isNotNull() | F.col("max_rows").isNotNull()), (F.col("rows") >= F.coalesce("min_rows", "rows")) & (F.col("rows") <= F.coalesce("max_rows", "rows")))
    own = cases.select("case", sane.alias("row_sanity_ok"), F.filter(F.array(F.when(~F.col("executed"), F.lit("exec:")), F.when(~sane, F.concat(F.lit("rows:"), F.col("rows").cast("string")))), lambda x: x.isNotNull()).alias("own"))
    found = [
        own,
        t.groupBy("case").agg(F.bool_or("hit").alias("table_hit"), F.min("rank").alias("table_rank"), F.collect_list(missed("table:", F.col("table"))).alias("t")),
        c.groupBy("case").agg(half_up(F.avg(F.col("hit").cast("int")), 2).alias("column_recall"), F.collect_list(missed("column:", F.col("column"))).alias("c")),
        m.groupBy("case").agg(F.bool_and("hit").alias("metric_hit"), F.collect_list(missed("metric:", F.col("metric"))).alias("m")),
        j.groupBy("case").agg(F.bool_and("hit").alias("join_path_ok"), F.collect_list(missed("join:", F.concat("a", F.lit("->"), F.col("b")))).alias("j")),
    ]
    rows = reduce(lambda x, y: x.join(y, "case", "left"), found)
    none = F.array().cast("array<string>")
    missing = F.sort_array(F.concat("own", *(F.coalesce(x, none) for x in "tcmj")))
    sure = lambda x, other: F.coalesce(x, F.lit(other)).alias(x)
    return rows.select("case", sure("table_hit", False), "table_rank", sure("column_recall", 1.0), sure("metric_hit", True), sure("join_path_ok", True), "row_sanity_ok", F.array_join(missing, " ").alias("missing"))


def evaluation_totals(results: DataFrame) -> DataFrame:
    """One row of rates over the cases of evaluate, to two places: 0 of none is 0."""
    n = F.count(F.lit(1))
    rate = lambda c: half_up(F.coalesce(F.count_if(F.col(c)) / F.nullif(n, F.lit(0)), F.lit(0.0)), 2).alias(c)
    checked = F.count("row_sanity_ok")
    return results.agg(n.alias("cases"), rate("table_hit"), half_up(F.coalesce(F.avg("column_recall"), F.lit(0.0)), 2).alias("column_recall"), rate("metric_hit"), rate("join_path_ok"), checked.alias("sanity_checked"), half_up(F.coalesce(F.count_if("row_sanity_ok") / F.nullif(checked, F.lit(0)), F.lit(0.0)), 2).alias("row_sanity"), F.count_if(F.col("missing") == "").alias("clean"))


def retrieval_gain(cases: DataFrame, ranked: DataFrame, other: DataFrame) -> DataFrame:
    """(case, recall, other_recall, gain): the share of a case's expected tables that two rankings (case, table) have; 1 where none are expected."""
    want = cases.select("case", F.explode(F.array_distinct("tables")).alias("table"))
    has = lambda df, name: df.select("case", "table").distinct().withColumn(name, F.lit(1))
    met = want.join(has(ranked, "x"), ["case", "table"], "left").join(has(other, "y"), ["case", "table"], "left").groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("x"), F.count("y").alias("y"))
    share = lambda c: half_up(F.coalesce(F.col(c) / F.col("n"), F.lit(1.0)), 2)
    return cases.select("case").join(met, "case", "left").select("case", share("x").alias("recall"), share("y").alias("other_recall")).withColumn("gain", F.round(F.col("recall") - F.col("other_recall"), 2))


# Feedback of the given tables: an order is a record that asks for its customer's orders and answers by day and priority.
_RECORDS = "SELECT o_orderkey AS seq, 'f' || CAST(o_orderkey AS STRING) AS id, o_orderdate AS recorded_at, 2 - CAST(o_orderkey % 31 = 0 AS INT) AS schema_version, CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE 'main' END AS dataset_id, '' AS tenant_id, 'p' || CAST(o_orderkey AS STRING) AS fingerprint, CASE WHEN o_orderkey % 7 = 0 THEN 'untrusted' ELSE 'Trusted' END AS trust_status, 'approved' AS review_status, CASE o_orderkey % 5 WHEN 0 THEN 'failure' WHEN 1 THEN 'corrected' ELSE 'Success' END AS outcome, o_orderkey % 11 <> 3 AS executed, ' Orders of  customer ' || CAST(o_custkey AS STRING) AS question, 'SELECT * FROM orders WHERE d = ' || CAST(o_orderdate AS STRING) || ' AND p = ' || o_orderpriority || ';' AS generated_sql, CASE WHEN o_orderkey % 5 = 1 THEN 'select *   from ORDERS where d = ' || CAST(o_orderdate AS STRING) || ' and p = ' || o_orderpriority ELSE '' END AS final_sql FROM {orders}"
_GOLDEN = "SELECT 'orders of customer ' || CAST(c_custkey AS STRING) AS question, '' AS sql FROM {customer} WHERE c_custkey % 13 = 0"


def _golden(s: SparkSession, d: str) -> DataFrame:
    records, known = s.sql(_RECORDS.replace("CAST(o_orderdate AS STRING)", "date_format(o_orderdate, 'yyyy-MM-dd')"), orders=table(s, d, "orders")), s.sql(_GOLDEN, customer=table(s, d, "customer"))
    return golden_candidates(records, known, "main", limit=None)


def _brands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _learned(s: SparkSession, d: str) -> DataFrame:
    lines, names = _brands(s, d), lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    n = F.col("l_linenumber")
    column = F.concat("p_brand", F.lit("."), "p_type")
    records = lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.concat(F.lit("f"), (F.col("seq") - F.col("seq") % 2 * (F.col("seq") % 10 == 1).cast("int")).cast("string")).alias("fingerprint"), F.when(F.col("seq") % 3 == 0, "success").otherwise("Corrected").alias("outcome"), F.collect_list(F.when(F.col("l_quantity") > 40, F.struct(F.col("l_returnflag").alias("code"), F.col("p_brand").alias("table"), F.col("l_linestatus").alias("column")))).alias("errors"), names(n <= 2, F.col("p_brand")).alias("generated_tables"), names((n >= 2) & (n <= 3), F.col("p_brand")).alias("final_tables"), names(n <= 2, column).alias("generated_columns"), names((n >= 2) & (n <= 3), column).alias("final_columns"))
    log = lines.select(F.array("p_brand", F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("tables"), F.floor("l_extendedprice").cast("long").alias("elapsed_ms"), (F.col("l_returnflag") != "R").alias("success"), F.when(n == 1, "CANCELED").when(n == 2, "").otherwise(F.concat(F.lit("E"), F.col("l_linestatus"))).alias("error_code"))
    return learned_rules(records, log, least=3, slow_ms=60_000)


def _cases(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    lines, n = _brands(s, d), F.col("l_linenumber")
    case = F.col("l_orderkey").alias("case")
    some = lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    cases = lines.groupBy(case).agg(some(n <= 2, F.col("p_brand")).alias("tables"), some(n == 3, F.col("p_name")).alias("columns"), some((n == 1) & (F.col("p_size") < 10), F.col("p_type")).alias("metrics"), (F.sum("l_quantity") > 20).alias("executed"), F.count(F.lit(1)).alias("rows"), F.when(F.col("case") % 3 == 0, F.lit(3)).cast("long").alias("min_rows"), F.when(F.col("case") % 4 == 0, F.lit(5)).cast("long").alias("max_rows"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    top = lines.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return cases, top.select(case, F.col("p_brand").alias("table"), "rank"), top.select(case, F.col("p_name").alias("column")), table(s, d, "part").filter("p_size = 7").select(F.col("p_type").alias("metric")), table(s, d, "part").filter("p_size % 10 = 3").groupBy("p_type").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).select("a", "b")


def _gain(s: SparkSession, d: str) -> DataFrame:
    cases, ranked, *_ = _cases(s, d)
    return retrieval_gain(cases, ranked, ranked.filter("rank <= 2"))


QUERIES = {
    "golden_promotion": _golden,
    "learned_rules": _learned,
    "golden_cases": lambda s, d: evaluate(*_cases(s, d)),
    "golden_totals": lambda s, d: evaluation_totals(evaluate(*_cases(s, d))),
    "retrieval_gain": _gain,
}

_BASE = "SELECT * FROM (SELECT seq, id, trim(question) AS question, coalesce(nullif(trim(final_sql), ''), trim(generated_sql)) AS sql, recorded_at, trim(regexp_replace(lower(question), '[ \t\n\r]+', ' ', 'g')) AS asked, trim(regexp_replace(regexp_replace(trim(lower(coalesce(nullif(trim(final_sql), ''), trim(generated_sql)))), ';+$', ''), ' +', ' ', 'g')) AS said FROM r WHERE schema_version >= 2 AND dataset_id = 'main' AND lower(trust_status) = 'trusted' AND lower(outcome) IN ('success', 'corrected') AND executed) WHERE asked NOT IN (SELECT lower(question) FROM g)"
_STEP = "SELECT seq, id, question, sql, recorded_at, asked, said, mine AS kept FROM (SELECT *, bool_or(mine) OVER (PARTITION BY asked) OR bool_or(mine) OVER (PARTITION BY said) AS out FROM (SELECT *, seq = min(seq) OVER (PARTITION BY asked) AND seq = min(seq) OVER (PARTITION BY said) AS mine FROM k WHERE NOT kept)) WHERE mine OR NOT out"
_LINES = "l AS (SELECT lineitem.*, part.* FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SIDES = "sides AS (SELECT 't' AS kind, l_orderkey AS seq, p_brand AS name, l_linenumber AS k FROM l UNION ALL SELECT 'c', l_orderkey, p_brand || '.' || p_type, l_linenumber FROM l), one AS (SELECT kind, seq, name, bool_or(k <= 2) AS g, bool_or(k IN (2, 3)) AS f FROM sides WHERE k <= 3 GROUP BY 1, 2, 3), swap AS (SELECT kind, seq, max(CASE WHEN g AND NOT f THEN name END) AS lost, max(CASE WHEN f AND NOT g THEN name END) AS won FROM one GROUP BY 1, 2 HAVING count(*) FILTER (WHERE g AND NOT f) = 1 AND count(*) FILTER (WHERE f AND NOT g) = 1)"
_EVAL = (
    "WITH " + _LINES + ", tops AS (SELECT l_orderkey AS c, p_brand, p_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM l) WHERE rank <= 3)"
    ", t AS (SELECT DISTINCT l_orderkey AS c, p_brand AS name FROM l WHERE l_linenumber <= 2), th AS (SELECT t.c, name, min(rank) AS rank FROM t LEFT JOIN tops ON tops.c = t.c AND p_brand = name GROUP BY 1, 2)"
    ", cl AS (SELECT DISTINCT l_orderkey AS c, p_name AS name FROM l WHERE l_linenumber = 3), ch AS (SELECT c, name, EXISTS (SELECT 1 FROM tops WHERE tops.c = cl.c AND p_name = name) AS hit FROM cl)"
    ", me AS (SELECT DISTINCT l_orderkey AS c, p_type AS name FROM l WHERE l_linenumber = 1 AND p_size < 10), mh AS (SELECT c, name, name IN (SELECT p_type FROM part WHERE p_size = 7) AS hit FROM me)"
    ", p0 AS (SELECT min(p_brand) AS a, max(p_brand) AS b FROM part WHERE p_size % 10 = 3 GROUP BY p_type), p AS (SELECT a, b FROM p0 UNION SELECT b, a FROM p0), jh AS (SELECT x.c, x.name || '->' || y.name AS name, EXISTS (SELECT 1 FROM p WHERE p.a = x.name AND p.b = y.name) AS hit FROM t x JOIN t y ON x.c = y.c AND x.name < y.name)"
    ", k AS (SELECT l_orderkey AS c, sum(l_quantity) > 20 AS executed, count(*) AS n, CASE WHEN l_orderkey % 3 = 0 THEN 3 END AS lo, CASE WHEN l_orderkey % 4 = 0 THEN 5 END AS hi FROM l GROUP BY 1), ks AS (SELECT c, executed, n, CASE WHEN executed AND (lo IS NOT NULL OR hi IS NOT NULL) THEN n >= coalesce(lo, n) AND n <= coalesce(hi, n) END AS sane FROM k)"
    ", miss AS (SELECT c, 'table:' || name AS m FROM th WHERE rank IS NULL UNION ALL SELECT c, 'column:' || name FROM ch WHERE NOT hit UNION ALL SELECT c, 'metric:' || name FROM mh WHERE NOT hit UNION ALL SELECT c, 'join:' || name FROM jh WHERE NOT hit UNION ALL SELECT c, 'exec:' FROM ks WHERE NOT executed UNION ALL SELECT c, 'rows:' || n::VARCHAR FROM ks WHERE NOT sane), mm AS (SELECT c, string_agg(m, ' ' ORDER BY m) AS missing FROM miss GROUP BY 1)"
    ", ev AS (SELECT ks.c AS \"case\", coalesce(tr.hit, false) AS table_hit, tr.rank AS table_rank, coalesce(cr.recall, 1) AS column_recall, coalesce(mr.hit, true) AS metric_hit, coalesce(jr.hit, true) AS join_path_ok, sane AS row_sanity_ok, coalesce(missing, '') AS missing FROM ks LEFT JOIN (SELECT c, bool_or(rank IS NOT NULL) AS hit, min(rank) AS rank FROM th GROUP BY 1) tr USING (c) LEFT JOIN (SELECT c, floor(avg(hit::INT) * 100 + 0.5) / 100 AS recall FROM ch GROUP BY 1) cr USING (c) LEFT JOIN (SELECT c, bool_and(hit) AS hit FROM mh GROUP BY 1) mr USING (c) LEFT JOIN (SELECT c, bool_and(hit) AS hit FROM jh GROUP BY 1) jr USING (c) LEFT JOIN mm USING (c))"
)

ORACLE_SQL = {
    "golden_promotion": "WITH RECURSIVE r AS (" + _RECORDS.format(orders="orders").replace("CAST(o_orderdate AS STRING)", "strftime(o_orderdate, '%Y-%m-%d')") + "), g AS (" + _GOLDEN.format(customer="customer") + f"), k AS (SELECT *, false AS kept FROM ({_BASE}) UNION ALL {_STEP}) SELECT seq, id, question, sql, recorded_at FROM k WHERE kept",
    "learned_rules": "WITH " + _LINES + ", " + _SIDES + ", firsts AS (SELECT min(seq) AS seq FROM (SELECT DISTINCT l_orderkey AS seq FROM l) GROUP BY seq - seq % 2 * (seq % 10 = 1)::INT), err AS (SELECT 'recurring_error' AS type, l_returnflag AS code, p_brand AS \"table\", l_linestatus AS \"column\", NULL AS replacement, count(*) AS n, NULL::BIGINT AS avg_ms FROM l JOIN firsts ON l_orderkey = seq WHERE l_quantity > 40 GROUP BY 1, 2, 3, 4), sw AS (SELECT CASE kind WHEN 't' THEN 'table_correction' ELSE 'column_correction' END AS type, NULL AS code, split_part(lost, '.', 1) AS \"table\", CASE kind WHEN 'c' THEN split_part(lost, '.', 2) END AS \"column\", CASE kind WHEN 'c' THEN split_part(won, '.', 2) ELSE won END AS replacement, count(*) AS n, NULL::BIGINT AS avg_ms FROM swap JOIN firsts USING (seq) WHERE seq % 3 <> 0 GROUP BY kind, lost, won), calls AS (SELECT unnest([p_brand, 'T' || l_suppkey::VARCHAR]) AS \"table\", floor(l_extendedprice)::BIGINT AS ms, l_returnflag <> 'R' AS success, CASE l_linenumber WHEN 1 THEN 'CANCELED' WHEN 2 THEN '' ELSE 'E' || l_linestatus END AS code FROM l), ex AS (SELECT 'slow_query' AS type, NULL AS code, \"table\", NULL AS \"column\", NULL AS replacement, count(*) AS n, floor(sum(ms) / count(*))::BIGINT AS avg_ms FROM calls WHERE success AND ms >= 60000 GROUP BY \"table\" UNION ALL SELECT 'recurring_exec_error', code, \"table\", NULL, NULL, count(*), NULL FROM calls WHERE NOT success AND code NOT IN ('', 'CANCELED') GROUP BY code, \"table\") SELECT * FROM (SELECT * FROM err UNION ALL SELECT * FROM sw UNION ALL SELECT * FROM ex) WHERE n >= 3",
    "golden_cases": _EVAL + " SELECT * FROM ev",
    "golden_totals": _EVAL + " SELECT count(*) AS cases, floor(count(*) FILTER (WHERE table_hit) / count(*) * 100 + 0.5) / 100 AS table_hit, floor(avg(column_recall) * 100 + 0.5) / 100 AS column_recall, floor(count(*) FILTER (WHERE metric_hit) / count(*) * 100 + 0.5) / 100 AS metric_hit, floor(count(*) FILTER (WHERE join_path_ok) / count(*) * 100 + 0.5) / 100 AS join_path_ok, count(row_sanity_ok) AS sanity_checked, floor(count(*) FILTER (WHERE row_sanity_ok) / count(row_sanity_ok) * 100 + 0.5) / 100 AS row_sanity, count(*) FILTER (WHERE missing = '') AS clean FROM ev",
    "retrieval_gain": _EVAL + ", u AS (SELECT \"case\", coalesce(floor(avg((rank IS NOT NULL)::INT) * 100 + 0.5) / 100, 1) AS recall, coalesce(floor(avg((coalesce(rank, 9) <= 2)::INT) * 100 + 0.5) / 100, 1) AS other_recall FROM ev LEFT JOIN th ON th.c = \"case\" GROUP BY 1) SELECT *, round(recall - other_recall, 2) AS gain FROM (SELECT \"case\", CASE WHEN EXISTS (SELECT 1 FROM th WHERE th.c = \"case\") THEN recall ELSE 1 END AS recall, CASE WHEN EXISTS (SELECT 1 FROM th WHERE th.c = \"case\") THEN other_recall ELSE 1 END AS other_recall FROM u)",
}
