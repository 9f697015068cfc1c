"""Metadata as tables: merging, hashing and comparing schemas, relations between tables, indexes, and catalog search.

Columns of schemas are rows (table, column, type, nullable, is_key, comment), relations rows (a, b, ord, conf), indexes
rows (table, name, columns, is_unique); each operator is a few joins and groupings over these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up
from tidemark.sources.tables import table

# Kinds of change and their severity; a changed type counts less where the base type stays.
SEVERITY = {"table_added": "low", "table_removed": "breaking", "column_added": "low", "column_removed": "breaking", "null_changed": "medium", "key_changed": "high", "comment_changed": "low"}
# Endings of a column that names another table.
KEY_ENDS = ("_id", "_no", "_cd", "_seq", "_key")


def merge_metadata(physical: DataFrame, logical: DataFrame, key: list[str]) -> DataFrame:
    """Physical rows with logical names and descriptions over them; the type fills in only where it is empty, and key flags hold if either says so."""
    p = physical.select(*key, *(F.col(c).alias(f"p_{c}") for c in ("name", "description", "type", "is_pk", "is_fk")))
    merged = p.join(logical, key, "full_outer")
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    return merged.select(*key, *(F.coalesce(full(c), F.col(f"p_{c}")).alias(c) for c in ("name", "description")), F.coalesce(full("p_type"), F.col("type")).alias("type"), *((F.coalesce(f"p_{c}", F.lit(False)) | F.coalesce(c, F.lit(False))).alias(c) for c in ("is_pk", "is_fk")))


def struct_hash(columns: DataFrame) -> DataFrame:
    """(table, hash): 16 hex digits of sha256 over the table's columns by name; comments don't count."""
    one = F.to_json(F.struct(F.lower("column").alias("column"), "type", "nullable", "is_key"))
    return columns.groupBy("table").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), "\n"), 256), 1, 16).alias("hash"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, kind, severity): what changed from old to new.

    A table whose structural hash is the same is skipped, so a changed comment alone isn't reported. Tables that come or
    go have one row and no column rows.
    """
    a, b = struct_hash(old).withColumnRenamed("hash", "old"), struct_hash(new).withColumnRenamed("hash", "new")
    tables = a.join(b, "table", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    whole = tables.filter("old is null or new is null").select("table", F.lit(None).cast("string").alias("column"), F.when(F.col("old").isNull(), "table_added").otherwise("table_removed").alias("kind"), F.lit(False).alias("base"))
    both = tables.filter("old is not null and new is not null").select("table")
    side = lambda d: d.join(both, "table").select("table", F.lower("column").alias("column"), F.struct("type", "nullable", "is_key", F.trim(F.coalesce("comment", F.lit(""))).alias("comment")).alias("x"))
    met = side(old).withColumnRenamed("x", "o").join(side(new).withColumnRenamed("x", "n"), ["table", "column"], "full_outer")
    had = F.col("o").isNotNull() & F.col("n").isNotNull()
    base = lambda c: F.lower(F.regexp_replace(c, r"\(.*", ""))
    rules = [
        (F.col("o").isNull(), "column_added"),
        (F.col("n").isNull(), "column_removed"),
        (had & (F.lower("o.type") != F.lower("n.type")), "type_changed"),
        (had & ~F.col("o.nullable").eqNullSafe(F.col("n.nullable")), "null_changed"),
        (had & ~F.col("o.is_key").eqNullSafe(F.col("n.is_key")), "key_changed"),
        (had & (F.col("o.comment") != F.col("n.comment")), "comment_changed"),
    ]
    kinds = F.explode(F.array_compact(F.array(*(F.when(c, k) for c, k in rules)))).alias("kind")
    found = whole.unionByName(met.select("table", "column", kinds, (base("o.type") == base("n.type")).alias("base")))
    severity = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(c), SEVERITY.items(), F.when(F.col("base"), "medium").otherwise("high"))
    return found.select("table", "column", "kind", severity.alias("severity"))


def sync_decisions(stored: DataFrame, columns: DataFrame) -> DataFrame:
    """(table, action): skip where the hash is that of the last sync, else update; create and retire where only one side has the table."""
    met = stored.withColumnRenamed("hash", "old").join(struct_hash(columns).withColumnRenamed("hash", "new"), "table", "full_outer")
    return met.select("table", F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "retire").when(F.col("old") == F.col("new"), "skip").otherwise("update").alias("action"))


def join_paths(relations: DataFrame, max_depth: int = 3) -> DataFrame:
    """(a, b, depth, path, conf): the shortest path between tables, by its edges' ord numbers; of equal depth the one of least ords.

    Edges go both ways; a conf of 0 or null is 0.6. conf is the least of the edges' less 0.05 for each edge after the
    first, no less than 0, to two places. A table reaches itself at depth 0 with conf 1. Each round joins the frontier
    of new pairs only.
    """
    sure = F.when(F.coalesce("conf", F.lit(0.0)) == 0, 0.6).otherwise(F.col("conf")).alias("conf")
    both = relations.select("a", "b", "ord", sure).unionByName(relations.select(F.col("b").alias("a"), F.col("a").alias("b"), "ord", sure))
    e = both.filter("a <> b")
    own = both.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("path"), F.lit(1.0).alias("conf")).distinct()
    best = lambda d: d.groupBy("a", "b").agg(F.min(F.struct("path", "conf")).alias("x")).select("a", "b", "x.path", "x.conf")
    frontier = best(e.select("a", "b", F.array("ord").alias("path"), "conf"))
    seen = frontier
    step = e.select(F.col("a").alias("b"), F.col("b").alias("c"), "ord", F.col("conf").alias("more"))
    for _ in range(max_depth - 1):
        nxt = frontier.join(step, "b").filter("a <> c").select("a", F.col("c").alias("b"), F.concat("path", F.array("ord")).alias("path"), F.least("conf", "more").alias("conf"))
        frontier = best(nxt.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        seen = seen.unionByName(frontier)
    found = seen.select("a", "b", F.size("path").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), half_up(F.greatest(F.col("conf") - 0.05 * (F.size("path") - 1), F.lit(0.0)), 2).alias("conf"))
    return found.unionByName(own)


def path_advice(pairs: DataFrame, paths: DataFrame, forbidden: DataFrame, sure: float = 0.7) -> DataFrame:
    """Each pair (a, b) with the way to join it: blocked where forbidden either way, none without a path, verify below `sure`, else ok."""
    no = forbidden.select("a", "b").unionByName(forbidden.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("no", F.lit(True))
    met = pairs.join(paths, ["a", "b"], "left").join(no, ["a", "b"], "left")
    return met.select("a", "b", "depth", F.when(F.col("no"), "blocked").when(F.col("depth").isNull(), "none").when(F.col("conf") < sure, "verify").otherwise("ok").alias("advice"))


def on_condition(left: Column, right: Column) -> Column:
    """The ON text of two lists of columns, up to the shorter one's length."""
    n = F.least(F.size(left), F.size(right))
    return F.array_join(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda x, y: F.concat(F.lit("a."), x, F.lit(" = b."), y)), " AND ")


# Columns that every table has, which no key is seen in.
AUDIT_COLUMNS = ("CREATED_AT", "UPDATED_AT", "VERSION")


def fk_suggestions(columns: DataFrame, masters: DataFrame, edges: DataFrame, together: DataFrame, forbidden: DataFrame, audit: tuple[str, ...] = (), many: int = 50) -> DataFrame:
    """(table, column, to_table, score, conf): columns named as the only key column of another table, scored by evidence, above 1.

    columns: table, column, type, is_fk, indexed, unique by the first two; masters: column, to_table, to_type; edges: table,
    to_table, known already; together: table, to_table, n, the known queries that have both; forbidden: a, b, either
    way. 1, and 2 for a foreign key, 1 for an index, 1 for the same type, 1 for each common query up to 3, less 1.5 for a
    column of more than `many` tables; conf is 0.5 and 0.05 of the score, up to 0.85. Audit columns are no keys.
    """
    counted = columns.withColumn("tables", F.count(F.lit(1)).over(Window.partitionBy("column")))
    keys = masters.filter(~F.upper("column").isin([*AUDIT_COLUMNS, *audit]))
    met = counted.join(keys, "column").filter("table <> to_table").join(edges, ["table", "to_table"], "left_anti")
    no = forbidden.select(F.col("a").alias("table"), F.col("b").alias("to_table")).unionByName(forbidden.select(F.col("b").alias("table"), F.col("a").alias("to_table")))
    met = met.join(no, ["table", "to_table"], "left_anti").join(together, ["table", "to_table"], "left")
    score = F.expr(f"1 + IF(is_fk, 2, 0) + IF(indexed, 1, 0) + IF(type <> '' AND type = to_type, 1, 0) + least(coalesce(n, 0), 3) - IF(tables > {many}, 1.5D, 0D)").cast("double")
    return met.withColumn("score", score).filter("score > 1").select("table", "column", "to_table", "score", half_up(F.least(0.5 + 0.05 * F.col("score"), F.lit(0.85)), 2).alias("conf"))


def relation_candidates(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table, column, ref, conf): what a column that ends like a key likely refers to, unless it is a key itself or related already.

    A table whose only key has its name (0.8), else one named by what is left without the endings (0.7), each taken
    off once in their order; 0.2 less for another family of types. Of several the first by name.

    columns: table, column, family, is_pk, related; keys: ref, key, ref_family (tables with one key column).
    """
    stem = reduce(lambda c, end: F.regexp_replace(c, f"{end}$", ""), KEY_ENDS, F.lower("column"))
    c = columns.filter(F.lower("column").rlike(f"({'|'.join(KEY_ENDS)})$") & ~F.col("is_pk") & ~F.col("related")).withColumn("stem", stem)
    by_key = c.join(keys, F.lower("key") == F.lower("column")).filter("ref <> table").withColumn("conf", F.lit(0.8))
    by_stem = c.join(keys, F.lower("ref") == F.col("stem")).filter("ref <> table").withColumn("conf", F.lit(0.7))
    best = by_key.unionByName(by_stem).groupBy("table", "column", "family").agg(F.min(F.struct((-F.col("conf")).alias("m"), "ref", "ref_family")).alias("x"))
    return best.select("table", "column", "x.ref", half_up(-F.col("x.m") - F.when(F.col("family") != F.col("x.ref_family"), 0.2).otherwise(0.0), 2).alias("conf"))


def join_gaps(pairs: DataFrame, paths: DataFrame, columns: DataFrame) -> DataFrame:
    """Pairs (a, b) without a path, with the number of column names that both have."""
    shared = columns.select(F.col("table").alias("a"), "column").distinct().join(columns.select(F.col("table").alias("b"), "column").distinct(), "column").join(pairs, ["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(paths, ["a", "b"], "left_anti").join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("shared"))


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """(table, name, reason, covered_by): indexes of the same columns as one kept (a unique one, else the least name), and those whose columns begin a longer one's.

    Unique indexes are never redundant. Prefixes meet by an equi-join, so a table of many indexes isn't compared pair by pair.
    """
    same = Window.partitionBy("table", "columns")
    keeper = F.min(F.struct((~F.col("is_unique")).alias("other"), "name")).over(same)["name"]
    marked = indexes.filter("size(columns) > 0").withColumn("keeper", keeper)
    twice = marked.filter("not is_unique and name <> keeper").select("table", "name", F.lit("duplicate").alias("reason"), F.col("keeper").alias("covered_by"))
    begins = marked.filter("size(columns) > 1").select("table", F.col("name").alias("longer"), "columns").select("table", "longer", F.explode(F.transform(F.sequence(F.lit(1), F.size("columns") - 1), lambda n: F.slice("columns", F.lit(1), n))).alias("columns"))
    first = begins.groupBy("table", "columns").agg(F.min("longer").alias("covered_by"))
    part = marked.filter("not is_unique and name = keeper").join(first, ["table", "columns"]).select("table", "name", F.lit("prefix").alias("reason"), "covered_by")
    return twice.unionByName(part)


def unused_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes that aren't unique and were never scanned, by table and name."""
    return indexes.filter("scans = 0 and not is_unique").select("table", "name").orderBy("table", "name")


def context_columns(columns: DataFrame, cap: int) -> DataFrame:
    """Up to cap columns of each table: keys first, then configured ones, matches, and the rest, each in their order."""
    tier = F.expr("CASE WHEN is_key THEN 0 WHEN configured THEN 1 WHEN matched THEN 2 ELSE 3 END")
    w = Window.partitionBy("table").orderBy(tier, "ord")
    return columns.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= cap).select("table", "column", "rank")


def impact(refs: DataFrame) -> DataFrame:
    """Per target: dependents by kind, and the level: high for metrics or preferred joins, medium for relations or golden queries, else low."""
    n = refs.groupBy("target").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("metric", "preferred_join", "relation", "golden_query")), F.count(F.lit(1)).alias("total"))
    return n.withColumn("level", F.expr("CASE WHEN metric + preferred_join > 0 THEN 'high' WHEN relation + golden_query > 0 THEN 'medium' ELSE 'low' END"))


def downstream(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """What depends on each target directly: edges (source, dependent) one hop from it."""
    return edges.join(targets.select(F.col("node").alias("source")), "source").select("source", "dependent").distinct()


def review_queue(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (id, source) with their decision or 'open', and decisions whose candidate is gone as 'stale'."""
    live = candidates.join(decisions, "id", "left").select("id", "source", F.coalesce("decision", F.lit("open")).alias("state"))
    gone = decisions.join(candidates, "id", "left_anti").select("id", F.lit(None).cast("string").alias("source"), F.lit("stale").alias("state"))
    return live.unionByName(gone)


# --- the given tables as metadata -----------------------------------------------------------------------------------


def _schema(parts: DataFrame) -> DataFrame:
    """Brands as tables, names as columns."""
    return parts.groupBy(F.col("p_brand").alias("table"), F.col("p_name").alias("column")).agg(
        F.concat(F.min("p_type"), F.lit("("), F.max("p_size").cast("string"), F.lit(")")).alias("type"), (F.max("p_size") % 2 == 0).alias("nullable"), (F.count(F.lit(1)) > 1).alias("is_key"), F.min("p_partkey").cast("string").alias("comment")
    )


def _versions(s, d):
    p = table(s, d, "part")
    return _schema(p.filter("p_partkey % 10 <> 3 and p_brand <> 'Brand#7'")), _schema(p.filter("p_partkey % 15 <> 4 and p_brand <> 'Brand#9' or p_partkey < 9"))


def _relations(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).agg(F.min("p_partkey").alias("ord"), (0.6 + (F.count(F.lit(1)) % 40) * 0.01).alias("conf"))


def _pairs(s, d):
    brands = table(s, d, "part").select(F.col("p_brand").alias("a")).distinct()
    return brands.join(brands.select(F.col("a").alias("b")), F.expr("a < b"))


def _forbidden(s, d):
    return table(s, d, "part").filter("p_size = 50").groupBy("p_type").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).select("a", "b")


def _items(s, d):
    return table(s, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("table"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("column")).agg(F.min("l_linestatus").alias("type"), F.bool_or(F.expr("l_returnflag = 'R'")).alias("is_fk"), F.bool_or(F.expr("l_returnflag = 'A'")).alias("indexed"))


def _masters(s, d):
    return table(s, d, "part").selectExpr("concat('p', cast(p_partkey AS string)) AS column", "concat('s', cast(p_size AS string)) AS to_table", "IF(p_size % 2 = 0, 'O', 'F') AS to_type")


def _edges(s, d):
    return table(s, d, "lineitem").filter("l_quantity > 40").selectExpr("concat('s', cast(l_suppkey AS string)) AS table", "concat('s', cast(l_partkey % 50 AS string)) AS to_table").distinct()


def _pairs_of(s, d, when):
    return table(s, d, "lineitem").filter(when).selectExpr("concat('s', cast(l_suppkey AS string)) AS a", "concat('s', cast(l_partkey % 50 AS string)) AS b")


_ENDS = "CASE c_nationkey % 5 WHEN 0 THEN '_id' WHEN 1 THEN '_no_id' WHEN 2 THEN '_x' WHEN 3 THEN '_key' ELSE '_cd_seq' END"


def _named(s, d):
    return table(s, d, "customer").selectExpr("concat(c_mktsegment, '_facts') AS table", f"concat(lower(c_mktsegment), {_ENDS}) AS column", "IF(c_nationkey % 4 = 0, 'text', 'number') AS family", "c_nationkey % 7 = 0 AS is_pk", "c_nationkey % 11 = 0 AS related").distinct()


def _keys(s, d):
    return table(s, d, "customer").groupBy(F.lower("c_mktsegment").alias("ref")).agg(F.concat(F.min(F.lower("c_mktsegment")), F.lit("_key")).alias("key"), F.lit("number").alias("ref_family"))


def _indexes(s, d):
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy(F.col("o_custkey").alias("table"), F.col("o_orderkey").alias("name")).agg(F.slice(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("c")))), 1, 3)["c"].alias("columns"), (F.max("o_orderpriority") == "1-URGENT").alias("is_unique"), F.floor(F.sum("l_quantity") / 50).cast("long").alias("scans"))
    return rows


def _context(s, d):
    return table(s, d, "part").selectExpr("p_brand AS table", "p_partkey AS column", "p_size = 1 AS is_key", "p_type = 'SMALL' AS configured", "contains(p_name, 'red') AS matched", "p_partkey AS ord")


def _refs(s, d):
    return table(s, d, "lineitem").selectExpr("l_partkey AS target", "CASE WHEN l_discount >= 0.1 AND l_quantity > 48 THEN 'metric' WHEN l_quantity > 49 THEN 'preferred_join' WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'relation' WHEN l_quantity < 2 THEN 'golden_query' ELSE 'sample' END AS kind")


def _review(s, d):
    e = table(s, d, "events")
    part = lambda kind, name: e.filter(f"event_type = '{kind}'").selectExpr("user_id AS id", f"'{name}' AS source").distinct()
    return part("view", "profile").unionByName(part("click", "feedback")).unionByName(part("signup", "rules")), e.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.when(F.max("value") > 60, "approved").otherwise("rejected").alias("decision")).unionByName(e.groupBy((F.col("user_id") + 100000).alias("id")).agg(F.lit("approved").alias("decision")))


QUERIES = {
    "metadata_merge": lambda s, d: merge_metadata(table(s, d, "part").filter("p_partkey % 4 <> 1").selectExpr("p_partkey", "p_name AS name", "p_brand AS description", "IF(p_size > 25, p_type, '') AS type", "p_size = 1 AS is_pk", "p_size = 2 AS is_fk"), table(s, d, "part").filter("p_partkey % 4 <> 2").selectExpr("p_partkey", "IF(p_size > 40, ' ', upper(p_name)) AS name", "p_type AS description", "p_type AS type", "p_size = 3 AS is_pk", "p_size = 4 AS is_fk"), ["p_partkey"]),
    "schema_diff": lambda s, d: schema_diff(*_versions(s, d)),
    "sync_decisions": lambda s, d: sync_decisions(struct_hash(_versions(s, d)[0]), _versions(s, d)[1]).groupBy("action").agg(F.count(F.lit(1)).alias("n")),
    "join_path": lambda s, d: join_paths(_relations(s, d)),
    "join_advice": lambda s, d: path_advice(_pairs(s, d), join_paths(_relations(s, d)), _forbidden(s, d)),
    "join_condition": lambda s, d: table(s, d, "part").select("p_partkey", on_condition(F.split(F.concat_ws(" ", "p_name", "p_brand"), " "), F.split("p_name", " ")).alias("on")),
    "fk_suggestions": lambda s, d: fk_suggestions(_items(s, d), _masters(s, d), _edges(s, d), _pairs_of(s, d, "l_quantity < 4").groupBy(F.col("a").alias("table"), F.col("b").alias("to_table")).agg(F.count(F.lit(1)).alias("n")), _pairs_of(s, d, "l_quantity = 7"), ("P7", "P8"), 25),
    "relation_candidates": lambda s, d: relation_candidates(_named(s, d), _keys(s, d)),
    "join_gaps": lambda s, d: join_gaps(_pairs(s, d), join_paths(_relations(s, d).filter("conf > 0.75"), 2), table(s, d, "part").selectExpr("p_brand AS table", "p_name AS column")),
    "redundant_indexes": lambda s, d: redundant_indexes(_indexes(s, d)),
    "unused_indexes": lambda s, d: unused_indexes(_indexes(s, d)),
    "context_columns": lambda s, d: context_columns(_context(s, d), 12),
    "impact_counts": lambda s, d: impact(_refs(s, d)),
    "downstream": lambda s, d: downstream(table(s, d, "lineitem").selectExpr("l_suppkey AS source", "l_partkey AS dependent"), table(s, d, "supplier").filter("s_acctbal > 9000").selectExpr("s_suppkey AS node")),
    "review_queue": lambda s, d: review_queue(*_review(s, d)),
}

_SCH = "SELECT p_brand AS tb, p_name AS col, min(p_type) || '(' || max(p_size)::VARCHAR || ')' AS type, max(p_size) % 2 = 0 AS nullable, count(*) > 1 AS is_key, min(p_partkey)::VARCHAR AS comment FROM part WHERE {0} GROUP BY 1, 2"
_VER = "WITH o AS (" + _SCH.format("p_partkey % 10 <> 3 AND p_brand <> 'Brand#7'") + "), n AS (" + _SCH.format("p_partkey % 15 <> 4 AND p_brand <> 'Brand#9' OR p_partkey < 9") + "), ho AS (SELECT tb, string_agg(col || '|' || type || '|' || nullable || '|' || is_key, chr(10) ORDER BY col) AS h FROM o GROUP BY 1), hn AS (SELECT tb, string_agg(col || '|' || type || '|' || nullable || '|' || is_key, chr(10) ORDER BY col) AS h FROM n GROUP BY 1)"
_REL = "WITH RECURSIVE r AS (SELECT p_brand AS a, p_type AS b, min(p_partkey) AS ord, 0.6::DOUBLE + (count(*) % 40) * 0.01::DOUBLE AS conf FROM part GROUP BY 1, 2), e AS (SELECT a, b, ord, conf FROM r {0} UNION ALL SELECT b, a, ord, conf FROM r {0}), w AS (SELECT a, b, [ord] AS path, conf FROM e UNION ALL SELECT w.a, e.b, list_append(path, e.ord), least(w.conf, e.conf) FROM w JOIN e ON w.b = e.a WHERE len(path) < {1} AND e.b <> w.a), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(path), path, conf) AS rn FROM w), p AS (SELECT a, b, len(path)::BIGINT AS depth, array_to_string(path, '>') AS path, floor(greatest(conf - 0.05::DOUBLE * (len(path) - 1), 0.0::DOUBLE) * 100 + 0.5) / 100 AS conf FROM k WHERE rn = 1 UNION ALL SELECT DISTINCT a, a, 0, '', 1.0::DOUBLE FROM e)"
_PAIR = ", q AS (SELECT x.b AS a, y.b AS b FROM (SELECT DISTINCT p_brand AS b FROM part) x, (SELECT DISTINCT p_brand AS b FROM part) y WHERE x.b < y.b)"
_IDX = "WITH i AS (SELECT o_custkey AS tb, o_orderkey AS name, (list(l_suppkey % 3 ORDER BY l_linenumber, l_suppkey % 3))[1:3] AS cols, max(o_orderpriority) = '1-URGENT' AS uq, floor(sum(l_quantity) / 50)::BIGINT AS scans FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_S25 = "SELECT 's' || l_suppkey::VARCHAR AS tb, 'p' || l_partkey::VARCHAR AS col, min(l_linestatus) AS type, bool_or(l_returnflag = 'R') AS is_fk, bool_or(l_returnflag = 'A') AS indexed FROM lineitem GROUP BY 1, 2"

ORACLE_SQL = {
    "metadata_merge": "SELECT coalesce(p.p_partkey, l.p_partkey) AS p_partkey, CASE WHEN l.p_size > 40 OR l.p_partkey IS NULL THEN p.p_name ELSE upper(l.p_name) END AS name, coalesce(l.p_type, p.p_brand) AS description, CASE WHEN p.p_size > 25 THEN p.p_type ELSE l.p_type END AS type, coalesce(p.p_size = 1, false) OR coalesce(l.p_size = 3, false) AS is_pk, coalesce(p.p_size = 2, false) OR coalesce(l.p_size = 4, false) AS is_fk FROM (SELECT * FROM part WHERE p_partkey % 4 <> 1) p FULL JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 2) l ON p.p_partkey = l.p_partkey",
    "schema_diff": _VER + ", t AS (SELECT coalesce(ho.tb, hn.tb) AS tb, ho.h AS oh, hn.h AS nh FROM ho FULL JOIN hn ON ho.tb = hn.tb WHERE ho.h IS DISTINCT FROM hn.h), m AS (SELECT coalesce(o.tb, n.tb) AS tb, coalesce(o.col, n.col) AS col, o.col AS oc, n.col AS nc, o.type AS ot, n.type AS nt, o.nullable AS onull, n.nullable AS nnull, o.is_key AS ok, n.is_key AS nk, o.comment AS ocm, n.comment AS ncm FROM (SELECT o.* FROM o JOIN t ON o.tb = t.tb AND oh IS NOT NULL AND nh IS NOT NULL) o FULL JOIN (SELECT n.* FROM n JOIN t ON n.tb = t.tb AND oh IS NOT NULL AND nh IS NOT NULL) n ON o.tb = n.tb AND o.col = n.col), x AS (SELECT tb, NULL AS col, CASE WHEN oh IS NULL THEN 'table_added' ELSE 'table_removed' END AS kind, CASE WHEN oh IS NULL THEN 'low' ELSE 'breaking' END AS severity FROM t WHERE oh IS NULL OR nh IS NULL UNION ALL SELECT tb, col, 'column_added', 'low' FROM m WHERE oc IS NULL UNION ALL SELECT tb, col, 'column_removed', 'breaking' FROM m WHERE nc IS NULL UNION ALL SELECT tb, col, 'type_changed', CASE WHEN split_part(ot, '(', 1) = split_part(nt, '(', 1) THEN 'medium' ELSE 'high' END FROM m WHERE ot <> nt UNION ALL SELECT tb, col, 'null_changed', 'medium' FROM m WHERE onull <> nnull UNION ALL SELECT tb, col, 'key_changed', 'high' FROM m WHERE ok <> nk UNION ALL SELECT tb, col, 'comment_changed', 'low' FROM m WHERE ocm <> ncm) SELECT tb AS \"table\", col AS \"column\", kind, severity FROM x",
    "sync_decisions": _VER + " SELECT CASE WHEN ho.h IS NULL THEN 'create' WHEN hn.h IS NULL THEN 'retire' WHEN ho.h = hn.h THEN 'skip' ELSE 'update' END AS action, count(*) AS n FROM ho FULL JOIN hn ON ho.tb = hn.tb GROUP BY 1",
    "join_path": _REL.format("", 3) + " SELECT * FROM p",
    "join_advice": _REL.format("", 3) + _PAIR + ", f0 AS (SELECT min(p_brand) AS a, max(p_brand) AS b FROM part WHERE p_size = 50 GROUP BY p_type), f AS (SELECT a, b FROM f0 UNION SELECT b, a FROM f0) SELECT q.a, q.b, depth, CASE WHEN f.a IS NOT NULL THEN 'blocked' WHEN depth IS NULL THEN 'none' WHEN conf < 0.7::DOUBLE THEN 'verify' ELSE 'ok' END AS advice FROM q LEFT JOIN p USING (a, b) LEFT JOIN f ON f.a = q.a AND f.b = q.b",
    "join_condition": "WITH l AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS x, string_split(p_name, ' ') AS y FROM part), r AS (SELECT p_partkey, x, y, unnest(generate_series(1, least(len(x), len(y)))) AS i FROM l) SELECT p_partkey, string_agg('a.' || x[i] || ' = b.' || y[i], ' AND ' ORDER BY i) AS \"on\" FROM r GROUP BY 1",
    "fk_suggestions": "WITH c AS (" + _S25 + "), u AS (SELECT col, count(*) AS k FROM c GROUP BY 1), m AS (SELECT 'p' || p_partkey::VARCHAR AS col, 's' || p_size::VARCHAR AS tt, CASE WHEN p_size % 2 = 0 THEN 'O' ELSE 'F' END AS ty FROM part WHERE p_partkey NOT IN (7, 8)), pr AS (SELECT 's' || l_suppkey::VARCHAR AS tb, 's' || (l_partkey % 50)::VARCHAR AS tt, l_quantity FROM lineitem), co AS (SELECT tb, tt, count(*) AS n FROM pr WHERE l_quantity < 4 GROUP BY 1, 2), s AS (SELECT c.tb, col, tt, (1 + is_fk::INT * 2 + indexed::INT + (type = ty)::INT + least(coalesce(co.n, 0), 3) - CASE WHEN k > 25 THEN 1.5 ELSE 0 END)::DOUBLE AS score FROM c JOIN m USING (col) JOIN u USING (col) LEFT JOIN co USING (tb, tt) WHERE c.tb <> tt AND NOT EXISTS (SELECT 1 FROM pr WHERE l_quantity > 40 AND pr.tb = c.tb AND pr.tt = m.tt) AND NOT EXISTS (SELECT 1 FROM pr WHERE l_quantity = 7 AND (pr.tb = c.tb AND pr.tt = m.tt OR pr.tb = m.tt AND pr.tt = c.tb))) SELECT tb AS \"table\", col AS \"column\", tt AS to_table, score, floor(least(0.5::DOUBLE + 0.05::DOUBLE * score, 0.85::DOUBLE) * 100 + 0.5) / 100 AS conf FROM s WHERE score > 1",
    "relation_candidates": "WITH c AS (SELECT DISTINCT c_mktsegment || '_facts' AS tb, lower(c_mktsegment) || " + _ENDS + " AS col, CASE WHEN c_nationkey % 4 = 0 THEN 'text' ELSE 'number' END AS fam FROM customer WHERE c_nationkey % 7 <> 0 AND c_nationkey % 11 <> 0), k AS (SELECT DISTINCT lower(c_mktsegment) AS ref, lower(c_mktsegment) || '_key' AS key FROM customer), s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(col, '_id$', ''), '_no$', ''), '_cd$', ''), '_seq$', ''), '_key$', '') AS stem FROM c WHERE regexp_matches(col, '(_id|_no|_cd|_seq|_key)$')), b AS (SELECT tb, col, fam, ref, 0.8 AS conf FROM s JOIN k ON key = col UNION ALL SELECT tb, col, fam, ref, 0.7 FROM s JOIN k ON ref = stem), r AS (SELECT *, row_number() OVER (PARTITION BY tb, col, fam ORDER BY conf DESC, ref) AS rn FROM b) SELECT tb AS \"table\", col AS \"column\", ref, floor((conf::DOUBLE - CASE WHEN fam <> 'number' THEN 0.2 ELSE 0 END::DOUBLE) * 100 + 0.5) / 100 AS conf FROM r WHERE rn = 1",
    "join_gaps": _REL.format("WHERE conf > 0.75::DOUBLE", 2) + _PAIR + ", c AS (SELECT DISTINCT p_brand AS t, p_name AS n FROM part), s AS (SELECT x.t AS a, y.t AS b, count(*) AS n FROM c x JOIN c y USING (n) GROUP BY 1, 2) SELECT q.a, q.b, coalesce(s.n, 0)::BIGINT AS shared FROM q LEFT JOIN s USING (a, b) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = q.a AND p.b = q.b)",
    "redundant_indexes": _IDX + ", m AS (SELECT *, first_value(name) OVER (PARTITION BY tb, cols ORDER BY uq DESC, name) AS keeper FROM i) SELECT tb AS \"table\", name, 'duplicate' AS reason, keeper AS covered_by FROM m WHERE NOT uq AND name <> keeper UNION ALL SELECT a.tb, a.name, 'prefix', min(b.name) FROM m a JOIN m b ON a.tb = b.tb AND len(a.cols) < len(b.cols) AND b.cols[1:len(a.cols)] = a.cols WHERE NOT a.uq AND a.name = a.keeper GROUP BY 1, 2",
    "unused_indexes": _IDX + " SELECT tb AS \"table\", name FROM i WHERE scans = 0 AND NOT uq",
    "context_columns": "SELECT * FROM (SELECT p_brand AS \"table\", p_partkey AS \"column\", row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 1 THEN 0 WHEN p_type = 'SMALL' THEN 1 WHEN contains(p_name, 'red') THEN 2 ELSE 3 END, p_partkey) AS rank FROM part) WHERE rank <= 12",
    "impact_counts": "WITH r AS (SELECT l_partkey AS target, CASE WHEN l_discount >= 0.1 AND l_quantity > 48 THEN 'metric' WHEN l_quantity > 49 THEN 'preferred_join' WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'relation' WHEN l_quantity < 2 THEN 'golden_query' ELSE 'sample' END AS kind FROM lineitem), n AS (SELECT target, count(*) FILTER (WHERE kind = 'metric') AS metric, count(*) FILTER (WHERE kind = 'preferred_join') AS preferred_join, count(*) FILTER (WHERE kind = 'relation') AS relation, count(*) FILTER (WHERE kind = 'golden_query') AS golden_query, count(*) AS total FROM r GROUP BY 1) SELECT *, CASE WHEN metric + preferred_join > 0 THEN 'high' WHEN relation + golden_query > 0 THEN 'medium' ELSE 'low' END AS level FROM n",
    "downstream": "SELECT DISTINCT l_suppkey AS source, l_partkey AS dependent FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)",
    "review_queue": "WITH c AS (SELECT DISTINCT user_id AS id, CASE event_type WHEN 'view' THEN 'profile' WHEN 'click' THEN 'feedback' ELSE 'rules' END AS source FROM events WHERE event_type IN ('view', 'click', 'signup')), d AS (SELECT user_id AS id, CASE WHEN max(value) > 60 THEN 'approved' ELSE 'rejected' END AS decision FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT DISTINCT user_id + 100000, 'approved' FROM events) SELECT c.id, source, coalesce(decision, 'open') AS state FROM c LEFT JOIN d USING (id) UNION ALL SELECT id, NULL, 'stale' FROM d WHERE id NOT IN (SELECT id FROM c)",
}
