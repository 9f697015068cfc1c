"""Words, labels and JSON of text columns: tokens, semantic types, PII categories, code lists, value linking, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def tokens(text: Column) -> Column:
    """Lower-cased distinct words of letters and digits, in order."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9$#]+", " "), " ")), "")


def ladder(rules: list[tuple[Column, str]], other: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda c, r: F.when(r[0], r[1]).otherwise(c), reversed(rules), F.lit(other))


# The categories of personal data, in order, by what a text mentions.
PII = [("email", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"), ("phone", r"\+?[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}"), ("secret", r"(token|api_key|password|secret) ?[=:]")]


def pii_categories(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    kind = ladder([(low.rlike(p), k) for k, p in PII], "none")
    return docs.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def token_scores(parts: DataFrame, query: str) -> DataFrame:
    """Search: 5 for a query word among a name's words, 3 within it, 10 for the whole name; the best first, ties by key."""
    words = query.lower().split()
    name = F.lower("p_name")
    score = sum((F.when(F.array_contains(tokens(F.col("p_name")), w), 5).when(F.contains(name, F.lit(w)), 3).otherwise(0) for w in words), F.when(name == query.lower(), 10).otherwise(0))
    return parts.select("p_partkey", "p_name", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


def value_link(orders: DataFrame, values: list[str]) -> DataFrame:
    """Which column of orders holds each literal: 12 for equal, 6 for contained; by distinct values, so counted before it is matched."""
    long = orders.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("o_orderstatus", "o_orderpriority")))).alias("x")).select("x.*").distinct()
    hit = F.explode(F.filter(F.array(*map(F.lit, values)), lambda v: F.contains(F.lower("value"), F.lower(v))))
    return long.select("column", "value", hit.alias("literal")).select("literal", "column", F.when(F.lower("value") == F.lower("literal"), 12).otherwise(6).cast("long").alias("score")).groupBy("literal", "column").agg(F.max("score").alias("score"))


def json_values(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def word_counts(conversations: DataFrame) -> DataFrame:
    """Turns a word occurs in, by role; the commonest 50 of each, ties by the word."""
    from pyspark.sql import Window

    n = conversations.select("role", F.explode(tokens(F.col("text"))).alias("word")).groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "word")).cast("long")).filter("rank <= 50")


def semantic_types(docs: DataFrame) -> DataFrame:
    """A rough type of each document by its size and form."""
    kind = ladder([(F.length("text") < 100, "LABEL"), (F.contains("text", F.lit(" | ")), "TABLE"), (F.upper("text") == F.col("text"), "SHOUT"), (F.col("text").rlike("(?i)licensed under"), "LICENSE")], "PROSE")
    return docs.groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of labelled documents by source, and over all: the mean in basis points of four equal dimensions."""
    j = docs.join(labels, "doc_id")
    dims = [F.col("quality") == 1, F.col("toxic") == 0, F.length("text") >= 200, F.size(F.split("text", "\n")) >= 2]
    points = sum(d.cast("long") for d in dims) * 2500
    return j.groupingSets([["source"], []], "source").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum(points) / F.count(F.lit(1)))).cast("long").alias("score"))


QUERIES = {
    "tokenize": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(tokens(F.col("p_name")), " ").alias("tokens")),
    "schema_search_scores": lambda s, d: token_scores(table(s, d, "part"), "red widget"),
    "value_link": lambda s, d: value_link(table(s, d, "orders"), ["F", "urgent", "1-URGENT", "low"]),
    "json_params": lambda s, d: json_values(table(s, d, "events")),
    "pii_categories": lambda s, d: pii_categories(table(s, d, "documents")),
    "turn_word_counts": lambda s, d: word_counts(table(s, d, "conversations")),
    "semantic_types": lambda s, d: semantic_types(table(s, d, "documents")),
    "quality_rollup": lambda s, d: quality(table(s, d, "documents"), table(s, d, "labels")),
}

_T = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9$#]+', ' ', 'g')), ' '), lambda x: x <> '')"

ORACLE_SQL = {
    "tokenize": "WITH t AS (SELECT p_partkey, unnest(" + _T.format("p_name") + ") AS w, generate_subscripts(" + _T.format("p_name") + ", 1) AS i FROM part), f AS (SELECT p_partkey, w, min(i) AS i FROM t GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS tokens FROM f GROUP BY 1",
    "schema_search_scores": "WITH s AS (SELECT p_partkey, p_name, (CASE WHEN lower(p_name) = 'red widget' THEN 10 ELSE 0 END + CASE WHEN list_contains(" + _T.format("p_name") + ", 'red') THEN 5 WHEN contains(lower(p_name), 'red') THEN 3 ELSE 0 END + CASE WHEN list_contains(" + _T.format("p_name") + ", 'widget') THEN 5 WHEN contains(lower(p_name), 'widget') THEN 3 ELSE 0 END)::BIGINT AS score FROM part) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20",
    "value_link": "WITH v AS (SELECT DISTINCT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders), l AS (SELECT unnest(['F', 'urgent', '1-URGENT', 'low']) AS literal) SELECT literal, \"column\", max(CASE WHEN lower(value) = lower(literal) THEN 12 ELSE 6 END)::BIGINT AS score FROM v JOIN l ON contains(lower(value), lower(literal)) GROUP BY 1, 2",
    "json_params": "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "pii_categories": "SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in PII) + " ELSE 'none' END AS category, count(*) AS n FROM documents GROUP BY 1",
    "turn_word_counts": "WITH t AS (SELECT role, unnest(list_distinct(" + _T.format("text") + ")) AS word FROM conversations), c AS (SELECT role, word, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 50",
    "semantic_types": "SELECT lang, CASE WHEN length(text) < 100 THEN 'LABEL' WHEN contains(text, ' | ') THEN 'TABLE' WHEN upper(text) = text THEN 'SHOUT' WHEN regexp_matches(text, '(?i)licensed under') THEN 'LICENSE' ELSE 'PROSE' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2",
    "quality_rollup": "SELECT source, count(*) AS n, floor(sum(2500 * ((quality = 1)::BIGINT + (toxic = 0)::BIGINT + (length(text) >= 200)::BIGINT + (len(string_split(text, chr(10))) >= 2)::BIGINT)) / count(*))::BIGINT AS score FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), ())",
}
