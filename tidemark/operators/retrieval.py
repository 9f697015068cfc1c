"""The given tables as a catalog of metadata with questions asked of it, searched by the operators of search.py.

Parts of one brand and name are a table, each part a column, orders relate the tables of their first two lines, and
each supplier asks a question made from its first three lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.lineage import settled
from tidemark.operators.search import Catalog, infer_metrics, resolve_metrics, retrieve, search_examples, search_schema
from tidemark.sources.tables import table

_TABLE = "upper(replace(p_brand, 'Brand#', 'B')) || '.' || upper(replace(p_name, ' ', '_'))"
_WORD = "split_part(p_name, ' ', 2)"
#: SELECTs that Spark and DuckDB both take; {list} makes an array of its arguments.
VIEWS = {
    "tables": f"SELECT {_TABLE} AS \"table\", upper(replace(p_brand, 'Brand#', 'B')) AS schema, upper(replace(p_name, ' ', '_')) AS name, CASE WHEN max(p_size) % 3 = 0 THEN p_name ELSE '' END AS logical, lower(min(p_type)) || ' goods of ' || p_brand AS description, CASE WHEN min(p_size) % 4 = 0 THEN lower(max(p_type)) ELSE '' END AS domain FROM {{part}} GROUP BY p_brand, p_name",
    "columns": f"SELECT {_TABLE} AS \"table\", p_type || '_' || CAST(p_partkey AS STRING) AS \"column\", CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS logical, CASE WHEN p_size % 4 = 0 THEN 'total size ' || CAST(p_size AS STRING) ELSE '' END AS description, CASE WHEN p_size % 9 = 0 THEN '1:' || lower(p_type) || ', 2:' || {_WORD} ELSE '' END AS code_dict, '' AS common_code, {{list}}(CASE WHEN p_size % 6 = 0 THEN 'grade ' || lower(p_type) ELSE '' END) AS synonyms, {{list}}(CASE WHEN p_size % 7 = 0 THEN {_WORD} ELSE 'none' END) AS samples, p_size % 8 = 0 AS is_pk, p_size % 5 = 0 AS indexed FROM {{part}}",
    "lines": f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_discount, {_TABLE} AS \"table\" FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey",
    "relations": "SELECT DISTINCT x.\"table\" AS a, y.\"table\" AS b FROM {lines} x JOIN {lines} y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 WHERE x.l_quantity > 44",
    "examples": f"SELECT p_partkey AS example, 'how many ' || p_name || ' by ' || lower(p_type) AS question, lower(p_type) AS domain, 'count' AS intent, p_type AS \"column\", {_TABLE} AS target FROM {{part}} WHERE p_size = 50",
    "usage": "SELECT \"table\", count(*) AS n FROM {lines} WHERE l_returnflag = 'N' AND l_quantity > 49 GROUP BY \"table\"",
    "penalty": "SELECT \"table\", count(*) AS n FROM {lines} WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.085 GROUP BY \"table\"",
    "metrics": f"SELECT p_name || ' total' AS metric, min(p_partkey) AS ord, min(p_type) || ' ' || {_WORD} AS business_name, {{list}}('sum of all ' || p_name, {_WORD} || ' per ' || lower(max(p_type))) AS aliases, {{list}}(min({_TABLE}), max({_TABLE})) AS tables FROM {{part}} GROUP BY p_name",
    "glossary": f"SELECT DISTINCT {_WORD} AS term, {{list}}('x' || {_WORD}, {_WORD} || ' kind') AS synonyms FROM {{part}}",
    "hints": "SELECT p_brand AS hint, {list}(min(p_name), lower(max(p_type))) AS keywords, {list}(upper(replace(p_brand, 'Brand#', 'B'))) AS schemas FROM {part} GROUP BY p_brand",
    "firsts": "SELECT l_suppkey, p_name, p_type, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, p_name, p_type, p_brand) AS k FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "names": "SELECT l_suppkey AS question, max(CASE WHEN k = 1 THEN p_name END) AS n, max(CASE WHEN k = 2 THEN p_type END) AS t, max(CASE WHEN k = 3 THEN p_brand END) AS b FROM {firsts} WHERE k <= 3 GROUP BY l_suppkey",
    "questions": "SELECT question, CASE question % 5 WHEN 0 THEN 'Total ' || n || ' and ' || lower(coalesce(t, '')) WHEN 1 THEN n || ' total' WHEN 2 THEN 'all x' || split_part(n, ' ', 2) || ' ' || split_part(n, ' ', 1) || ' total for ' || coalesce(b, '') WHEN 3 THEN upper(replace(n, ' ', '_')) || ' by ' || coalesce(t, '') ELSE 'how many ' || n || ' by ' || lower(coalesce(t, '')) || '?' END AS text FROM {names}",
}
_GIVEN = ("part", "lineitem")


def given_catalog(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame]:
    """(catalog, questions) of the given tables."""
    made = {name: table(spark, sf_dir, name) for name in _GIVEN}
    for name, sql in VIEWS.items():
        used = {n: df for n, df in made.items() if f"{{{n}}}" in sql}
        made[name] = spark.sql(sql.replace('"', "`").replace("{list}", "array"), **used)
    return Catalog(*(made[f] for f in Catalog.__dataclass_fields__)), made["questions"]


def _searched(s: SparkSession, d: str) -> DataFrame:
    catalog, questions = given_catalog(s, d)
    return search_schema(questions, catalog)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    catalog, questions = given_catalog(s, d)
    return resolve_metrics(questions, catalog.metrics, catalog.glossary)


def _retrieved(s: SparkSession, d: str) -> DataFrame:
    catalog, questions = given_catalog(s, d)
    return retrieve(questions, catalog).drop("semantic", "lexical")


def _examples(s: SparkSession, d: str) -> DataFrame:
    catalog, questions = given_catalog(s, d)
    questions = settled(questions)
    intents = questions.selectExpr("question", "CASE WHEN text LIKE 'how many%' THEN 'Count' ELSE 'sum' END AS intent")
    return search_examples(questions, catalog.examples, catalog.glossary, intents)


def _inferred(s: SparkSession, d: str) -> DataFrame:
    catalog, _ = given_catalog(s, d)
    named, asked = (s.sql(x.replace('"', "`").replace("{list}", "array"), columns=catalog.columns, tables=catalog.tables, metrics=catalog.metrics) for x in (_MEASURED, _WANTED))
    return infer_metrics(asked, named, catalog.glossary, "CUST_NO")


_MEASURED = "SELECT \"table\", upper(\"column\") || CASE WHEN indexed THEN '_AMT' WHEN logical <> '' THEN '_SCR' WHEN description <> '' THEN '_GRAD' WHEN is_pk THEN '_X' ELSE '_RT' END AS \"column\", logical, description || CASE WHEN is_pk THEN ' 평점' ELSE '' END AS description, code_dict, common_code, synonyms, samples, is_pk, indexed FROM {columns} UNION ALL SELECT \"table\", 'CUST_NO', '', '', '', '', {list}(''), {list}(''), false, true FROM {tables} WHERE domain <> ''"
_WANTED = "SELECT ord AS question, metric || CASE ord % 3 WHEN 0 THEN ' 금액' WHEN 1 THEN ' 등급' ELSE '' END AS text FROM {metrics}"

QUERIES = {"inferred_metrics": _inferred, "example_search": _examples, "schema_search": _searched, "metric_resolver": _resolved, "graph_retrieval": _retrieved}

_VIEWS = "WITH " + ", ".join(f"{name} AS ({sql.format(list='list_value', **{n: n for n in [*_GIVEN, *VIEWS]})})" for name, sql in VIEWS.items())
_W = r"'[\p{L}\p{Nd}$#]+'"


def _tokens(key: str, text: str, source: str) -> str:
    found = f"regexp_extract_all(lower({text}), {_W})"
    return f"SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY min(nth)) - 1 AS pos FROM (SELECT {key}, unnest({found}) AS token, generate_subscripts({found}, 1) AS nth FROM {source}) GROUP BY {key}, token"


_RUNS = "SELECT t.{0}, p.{1}, s AS start, len(p.phrase) AS width FROM {2} t, {3} p, unnest(range(0, len(t.tokens))) u(s) WHERE t.tokens[s + 1:s + len(p.phrase)] = p.phrase UNION ALL SELECT t.{0}, p.{1}, list_position(t.tokens, array_to_string(p.phrase, '')) - 1, 1 FROM {2} t, {3} p WHERE len(p.phrase) > 1 AND list_contains(t.tokens, array_to_string(p.phrase, ''))"
_METRICS = (
    f", qt AS ({_tokens('question', 'text', 'questions')}), q AS (SELECT question, list(token ORDER BY pos) AS tokens FROM qt GROUP BY 1)"
    ", l0 AS (SELECT metric || '|0' AS id, metric, ord, 0 AS place, 'name' AS field, metric AS label FROM metrics UNION ALL SELECT metric || '|1', metric, ord, 1, 'business_name', business_name FROM metrics UNION ALL SELECT metric || '|' || (i + 1)::VARCHAR, metric, ord, i + 1, 'alias', aliases[i] FROM metrics, unnest([1, 2]) u(i))"
    f", lt AS ({_tokens('id', 'label', 'l0')}), l AS (SELECT l0.*, tokens, tokens AS phrase, len(tokens) AS n FROM l0 JOIN (SELECT id, list(token ORDER BY pos) AS tokens FROM lt GROUP BY 1) USING (id))"
    ", m0 AS (SELECT term || '|' || i::VARCHAR AS member, term, i AS place, CASE i WHEN 0 THEN term ELSE synonyms[i] END AS text FROM glossary, unnest([0, 1, 2]) u(i))"
    f", mt AS ({_tokens('member', 'text', 'm0')}), m AS (SELECT m0.*, phrase FROM m0 JOIN (SELECT member, list(token ORDER BY pos) AS phrase FROM mt GROUP BY 1) USING (member))"
    f", said AS ({_RUNS.format('question', 'id', 'q', 'l')}), literal AS (SELECT question, id, bool_or(start = 0 AND width = n AND len(q.tokens) = n) AS exact FROM said JOIN l USING (id) JOIN q USING (question) GROUP BY 1, 2)"
    f", il AS ({_RUNS.format('id', 'member', 'l', 'm')}), ia AS ({_RUNS.format('question', 'member', 'q', 'm')})"
    ", ia1 AS (SELECT DISTINCT question, term, start AS pos FROM (SELECT *, min(place) OVER (PARTITION BY question, term) AS least FROM ia JOIN m USING (member)) WHERE place = least)"
    ", ev AS (SELECT question, id, lt.pos AS k, qt.pos AS pos, true AS direct FROM qt JOIN lt USING (token) UNION ALL SELECT question, id, k, pos, false FROM (SELECT id, term, unnest(range(start, start + width)) AS k FROM il JOIN m USING (member)) JOIN ia1 USING (term))"
    ", e AS (SELECT question, id, count(DISTINCT k) AS matched, count(DISTINCT CASE WHEN direct THEN k END) AS direct, bool_or(NOT direct) AS glossary FROM ev GROUP BY 1, 2)"
    ", sp AS (SELECT question, id, min(last - lo + 1) AS span FROM (SELECT question, id, lo, max(p) AS last, count(*) AS ks FROM (SELECT a.question, a.id, a.pos AS lo, b.k, min(b.pos) AS p FROM (SELECT DISTINCT question, id, pos FROM ev) a JOIN ev b ON a.question = b.question AND a.id = b.id AND b.pos >= a.pos GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) JOIN e USING (question, id) WHERE ks = matched GROUP BY 1, 2)"
    ", sem AS (SELECT question, id, round(0.72::DOUBLE + 0.12::DOUBLE * (matched::DOUBLE / n) + 0.04::DOUBLE * (direct::DOUBLE / n) + CASE WHEN glossary THEN 0.02::DOUBLE ELSE 0 END + CASE field WHEN 'name' THEN 0.02::DOUBLE WHEN 'business_name' THEN 0.01::DOUBLE ELSE 0 END, 6) AS c, matched, span FROM e JOIN l USING (id) JOIN sp USING (question, id) WHERE NOT EXISTS (SELECT 1 FROM literal WHERE literal.question = e.question AND literal.id = e.id) AND matched * 4 >= 3 * n AND (n = 1 OR matched >= 2) AND (n > 1 OR (glossary AND length(tokens[1]) >= 2)) AND span <= n + 1)"
    ", sc AS (SELECT question, id, least(c, 0.94::DOUBLE) AS c, 'semantic' AS match_type, matched, span FROM sem WHERE c >= 0.80::DOUBLE UNION ALL SELECT question, id, round(CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.97::DOUBLE END - CASE field WHEN 'business_name' THEN 0.01::DOUBLE WHEN 'alias' THEN 0.02::DOUBLE ELSE 0 END, 6), CASE WHEN exact THEN 'exact' ELSE 'exact_phrase' END, NULL, NULL FROM literal JOIN l USING (id))"
    ", res AS (SELECT question, metric, ord, c, match_type, field, label, matched, span FROM (SELECT *, row_number() OVER (PARTITION BY question, metric ORDER BY c DESC, place) AS best FROM sc JOIN l USING (id)) WHERE best = 1)"
)
_SEARCH = (
    ", g0 AS (SELECT term, unnest(list_prepend(term, synonyms)) AS member FROM glossary)"
    ", w AS (SELECT DISTINCT question, token, lower(token) AS low FROM (SELECT question, token FROM qt UNION ALL SELECT question, g.member FROM (SELECT DISTINCT question, term FROM qt JOIN g0 ON contains(token, lower(member)) OR contains(lower(member), token)) JOIN g0 g USING (term)))"
    ", named AS (SELECT question, \"table\", 25 AS points, name AS term FROM questions JOIN tables ON contains(lower(text), lower(name)) OR contains(lower(text), lower(\"table\")) UNION ALL SELECT question, \"table\", 20, logical FROM questions JOIN tables ON logical <> '' AND contains(lower(text), lower(logical)) UNION ALL SELECT question, \"table\", unnest([4, 5, 3, 6][i:i]), token FROM w, tables, unnest([1, 2, 3, 4]) u(i) WHERE contains(lower([name, logical, description, domain][i]), low))"
    ", by_word AS (SELECT question, \"table\", sum(points)::DECIMAL(20,6) AS words FROM named GROUP BY 1, 2)"
    ", hinted AS (SELECT question, \"table\", (8 * count(DISTINCT hint))::DECIMAL(20,6) AS hints FROM questions JOIN hints ON contains(lower(text), lower(keywords[1])) OR contains(lower(text), lower(keywords[2])) JOIN tables ON list_contains(schemas, schema) GROUP BY 1, 2)"
    ", ex AS (SELECT example, lower(question) AS asked, lower(target) AS target, lower(question || ' ' || domain || ' ' || intent || ' ' || \"column\") AS body FROM examples)"
    ", exw AS (SELECT w.question, example, count(*) * 1.2::DECIMAL(20,6) AS p FROM w JOIN ex ON contains(body, low) GROUP BY 1, 2), exq AS (SELECT question, example, 20::DECIMAL(20,6) AS p FROM questions JOIN ex ON contains(asked, lower(text)))"
    ", shown AS (SELECT question, \"table\", least(max(p), 24)::DECIMAL(20,6) AS examples FROM (SELECT question, example, sum(p) AS p FROM (SELECT * FROM exw UNION ALL SELECT * FROM exq) GROUP BY 1, 2) JOIN ex USING (example) JOIN tables ON contains(ex.target, lower(\"table\")) OR contains(ex.target, lower(name)) GROUP BY 1, 2)"
    ", mtab AS (SELECT DISTINCT question, \"table\", metric FROM res JOIN (SELECT metric, unnest(tables) AS \"table\" FROM metrics) USING (metric)), by_metric AS (SELECT question, \"table\", 12::DECIMAL(20,6) AS metrics FROM mtab GROUP BY 1, 2)"
    ", mterm AS (SELECT question, \"table\", count(DISTINCT trim(term)) AS matched FROM (SELECT question, \"table\", term FROM named UNION ALL SELECT question, \"table\", metric FROM mtab) WHERE trim(term) <> '' GROUP BY 1, 2)"
    ", cs AS (SELECT question, \"table\", \"column\", sum(CASE WHEN lower(\"column\") = low THEN 15 WHEN contains(lower(\"column\"), low) THEN 5 ELSE 0 END + CASE WHEN contains(lower(logical), low) THEN 7 ELSE 0 END + CASE WHEN contains(lower(description), low) THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(code_dict), low) THEN 2 ELSE 0 END + CASE WHEN contains(lower(synonyms[1]), low) THEN 6 ELSE 0 END + CASE WHEN lower(samples[1]) = low THEN 5 ELSE 0 END + CASE WHEN contains(lower(\"column\" || ' ' || logical || ' ' || description || ' ' || code_dict || ' ' || common_code || ' ' || synonyms[1] || ' ' || samples[1]), low) THEN 0.5 ELSE 0 END)::DECIMAL(20,6) + CASE WHEN any_value(is_pk) THEN 0.25 ELSE 0 END + CASE WHEN any_value(indexed) THEN 0.25 ELSE 0 END AS points FROM w, columns GROUP BY 1, 2, 3)"
    ", cp AS (SELECT question, \"table\", sum(least(points, 8) * 0.35)::DECIMAL(20,6) AS columns FROM (SELECT *, row_number() OVER (PARTITION BY question, \"table\" ORDER BY round(points, 2) DESC, \"column\") AS place FROM cs WHERE points > 0) WHERE place <= 8 GROUP BY 1, 2)"
    ", al AS (SELECT q.question, t.\"table\", coalesce(words, 0) AS words, coalesce(cp.columns, 0) AS columns, coalesce(hints, 0) AS hints, coalesce(shown.examples, 0) AS examples, least(12, round(3 * log2(1 + coalesce(usage.n, 0)::DOUBLE), 6)::DECIMAL(20,6))::DECIMAL(20,6) AS usage, least(10, 2.5 * coalesce(penalty.n, 0))::DECIMAL(20,6) AS penalty, coalesce(by_metric.metrics, 0) AS metrics, coalesce(matched, 0) AS matched FROM questions q CROSS JOIN tables t LEFT JOIN by_word b ON b.question = q.question AND b.\"table\" = t.\"table\" LEFT JOIN cp ON cp.question = q.question AND cp.\"table\" = t.\"table\" LEFT JOIN hinted ON hinted.question = q.question AND hinted.\"table\" = t.\"table\" LEFT JOIN shown ON shown.question = q.question AND shown.\"table\" = t.\"table\" LEFT JOIN by_metric ON by_metric.question = q.question AND by_metric.\"table\" = t.\"table\" LEFT JOIN mterm ON mterm.question = q.question AND mterm.\"table\" = t.\"table\" LEFT JOIN usage ON usage.\"table\" = t.\"table\" LEFT JOIN penalty ON penalty.\"table\" = t.\"table\")"
    ", so AS (SELECT *, words + columns + hints + examples + usage + metrics - penalty AS total FROM al), pool AS (SELECT *, round(total, 2) AS s1, row_number() OVER (PARTITION BY question ORDER BY round(total, 2) DESC, \"table\") AS place FROM so WHERE total > 0)"
    ", adj AS (SELECT a, b FROM relations UNION SELECT b, a FROM relations), nb AS (SELECT DISTINCT x.question, x.\"table\" FROM pool x JOIN adj ON x.\"table\" = a AND a <> b JOIN pool y ON y.question = x.question AND y.\"table\" = b WHERE x.place <= 2 * {0} AND y.place <= 2 * {0})"
    ", sr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, \"table\") AS rank FROM (SELECT pool.*, CASE WHEN nb.question IS NULL THEN 0 ELSE 4 END AS joined, s1 + CASE WHEN nb.question IS NULL THEN 0 ELSE 4 END AS score FROM pool LEFT JOIN nb ON nb.question = pool.question AND nb.\"table\" = pool.\"table\" WHERE place <= greatest(2 * {0}, {0} + 5)))"
)
_GRAPH = (
    ", sd AS (SELECT question, \"table\", rank, 1.0::DOUBLE / (1.0::DOUBLE + 0.35::DOUBLE * (rank - 1)) AS semantic, least(matched / 3.0::DOUBLE, 1) AS lexical FROM sr WHERE rank <= 6)"
    ", nx AS (SELECT DISTINCT question, b AS \"table\", 1.0::DOUBLE AS joined FROM sd JOIN adj ON \"table\" = a WHERE semantic >= 0.4)"
    ", lit AS (SELECT question, token FROM qt WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+'))"
    ", vc0 AS (SELECT token, \"table\", \"column\", CASE WHEN contains(code_dict, token) THEN CASE WHEN token IN (lower(split_part(split_part(code_dict, ',', 1), ':', 2)), split_part(split_part(code_dict, ',', 2), ':', 2)) THEN 12 ELSE 6 END WHEN lower(samples[1]) = token THEN 9 WHEN contains(synonyms[1], token) THEN 5 WHEN contains(logical, token) THEN 3 END AS score FROM (SELECT DISTINCT token FROM lit), columns)"
    ", vc AS (SELECT question, \"table\" FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, \"table\" || \"column\", token) AS place FROM lit JOIN vc0 USING (token) WHERE score IS NOT NULL) WHERE place <= 12)"
    ", gr AS (SELECT coalesce(sd.question, nx.question) AS question, coalesce(sd.\"table\", nx.\"table\") AS \"table\", rank, coalesce(semantic, 0) AS semantic, coalesce(lexical, 0) AS lexical, coalesce(joined, 0) AS joined, CASE WHEN rank IS NULL THEN 0.3::DOUBLE ELSE 1 END AS proximity FROM sd FULL JOIN nx ON sd.question = nx.question AND sd.\"table\" = nx.\"table\")"
    ", gs AS (SELECT gr.*, CASE WHEN EXISTS (SELECT 1 FROM vc WHERE vc.question = gr.question AND vc.\"table\" = gr.\"table\") THEN 1.0::DOUBLE ELSE 0 END AS value, least(coalesce(usage.n, 0) / 5.0::DOUBLE, 1) AS usage, 1 - least(coalesce(penalty.n, 0) / 5.0::DOUBLE, 1) AS freshness FROM gr LEFT JOIN usage ON usage.\"table\" = gr.\"table\" LEFT JOIN penalty ON penalty.\"table\" = gr.\"table\")"
    ", gz AS (SELECT *, round(round(0.55::DOUBLE * semantic + 0.10::DOUBLE * lexical + 0.08::DOUBLE * proximity + 0.09::DOUBLE * joined + 0.10::DOUBLE * value + 0.04::DOUBLE * usage + 0.04::DOUBLE * freshness, 6)::DECIMAL(20,6), 2)::DOUBLE AS score, CASE WHEN rank IS NULL THEN 'join_expanded' ELSE 'seed' END AS origin FROM gs)"
)

_WORDS = _SEARCH[: _SEARCH.index(", named AS")]
_INFER = ", cols AS (" + _MEASURED.format(columns="columns", tables="tables", list="list_value") + "), want AS (" + _WANTED.format(metrics="metrics") + "), qt AS (" + _tokens("question", "text", "want") + ")" + _WORDS.replace("questions", "want")
ORACLE_SQL = {
    "inferred_metrics": _VIEWS
    + _INFER
    + ", ex AS (SELECT c.*, CASE WHEN regexp_matches(\"column\", '(_AMT|_CNT|_COUNT)$') THEN 'SUM(' || \"column\" || ')' WHEN regexp_matches(\"column\", 'SCORE|(_SCR|_VAL)$') THEN 'AVG(' || \"column\" || ')' WHEN ends_with(\"column\", '_GRAD') AND \"table\" IN (SELECT \"table\" FROM cols WHERE \"column\" = 'CUST_NO') THEN \"column\" || ' as dimension; COUNT(DISTINCT CUST_NO)' WHEN \"column\" = 'CUST_NO' THEN 'COUNT(DISTINCT CUST_NO)' END AS expression, regexp_matches(\"column\", '(_AMT|_CNT|_COUNT|_SCORE|_SCR|_VAL|_RT|_RATE|_GRAD)$') AS named, lower(logical || ' ' || description) AS own FROM cols c)"
    ", cs AS (SELECT question, \"table\", \"column\", sum(CASE WHEN lower(\"column\") = low THEN 15 WHEN contains(lower(\"column\"), low) THEN 5 ELSE 0 END + CASE WHEN contains(lower(logical), low) THEN 7 ELSE 0 END + CASE WHEN contains(lower(description), low) THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(code_dict), low) THEN 2 ELSE 0 END + CASE WHEN contains(lower(synonyms[1]), low) THEN 6 ELSE 0 END + CASE WHEN lower(samples[1]) = low THEN 5 ELSE 0 END + CASE WHEN contains(lower(\"column\" || ' ' || logical || ' ' || description || ' ' || code_dict || ' ' || common_code || ' ' || synonyms[1] || ' ' || samples[1]), low) THEN 0.5 ELSE 0 END)::DECIMAL(20,6) + CASE WHEN any_value(is_pk) THEN 0.25 ELSE 0 END + CASE WHEN any_value(indexed) THEN 0.25 ELSE 0 END AS points FROM w, ex WHERE expression IS NOT NULL GROUP BY 1, 2, 3)"
    ", sc AS (SELECT question, cs.\"table\", cs.\"column\", expression, round(points, 2) + CASE WHEN (contains(lower(text), '금액') OR contains(own, '금액')) AND ends_with(cs.\"column\", '_AMT') THEN 8 ELSE 0 END + CASE WHEN (contains(lower(text), '등급') OR contains(own, '등급')) AND ends_with(cs.\"column\", '_GRAD') THEN 8 ELSE 0 END + CASE WHEN (contains(lower(text), '점수') OR contains(own, '점수') OR contains(lower(text), '평점') OR contains(own, '평점')) AND regexp_matches(cs.\"column\", 'SCORE|_SCR$') THEN 8 ELSE 0 END AS score FROM cs JOIN ex ON ex.\"table\" = cs.\"table\" AND ex.\"column\" = cs.\"column\" JOIN want USING (question) WHERE points > 0 OR named) SELECT question, rank, \"table\", \"column\", expression, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, \"table\", \"column\") AS rank FROM sc) WHERE rank <= 8",
    "example_search": _VIEWS + f", qt AS ({_tokens('question', 'text', 'questions')})" + _WORDS + ", x AS (SELECT example, question AS said, lower(question || ' ' || domain || ' ' || target || ' ' || \"column\" || ' ' || intent) AS body FROM examples), p AS (SELECT w.question, example, count(*) AS points FROM w JOIN x ON contains(body, low) GROUP BY 1, 2 UNION ALL SELECT question, example, 10 FROM questions JOIN x ON contains(lower(said), lower(text)) UNION ALL SELECT question, example, 2 FROM questions, x WHERE starts_with(text, 'how many')), s AS (SELECT question, example, sum(points)::DOUBLE AS score FROM p GROUP BY 1, 2) SELECT * FROM (SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, said, example) AS rank, example, score FROM s JOIN x USING (example)) WHERE rank <= 5",
    "metric_resolver": _VIEWS + _METRICS + " SELECT question, row_number() OVER (PARTITION BY question ORDER BY c DESC, ord, metric) AS rank, metric, round(c, 2) AS confidence, match_type, field, label, matched, span FROM res",
    "schema_search": _VIEWS + _METRICS + _SEARCH.replace("{0}", "8") + " SELECT question, rank, \"table\", score::DOUBLE AS score, words::DOUBLE AS words, columns::DOUBLE AS columns, hints::DOUBLE AS hints, examples::DOUBLE AS examples, usage::DOUBLE AS usage, penalty::DOUBLE AS penalty, metrics::DOUBLE AS metrics, joined::DOUBLE AS joined, matched, rank <= 8 AS kept FROM sr WHERE rank <= 13",
    "graph_retrieval": _VIEWS + _METRICS + _SEARCH.replace("{0}", "6") + _GRAPH + " SELECT question, row_number() OVER (PARTITION BY question ORDER BY origin DESC, coalesce(rank, found), \"table\") AS rank, \"table\", origin, score, proximity, joined, value, usage, freshness FROM (SELECT *, row_number() OVER (PARTITION BY question, origin ORDER BY score DESC, \"table\") AS found FROM gz) WHERE origin = 'seed' OR found <= 2",
}
