"""A catalog of metadata as JSON files in a folder, and the schemas of a Spark catalog.

Each set is a file with one JSON array of objects, as people keep them, or a folder of such files; two sets must be
there, the others may be missing, which is an issue and no error. A file is read whole by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import new_path
from tidemark.sources.tables import table

# Sets by their file and fields; the first two are required.
SETS = {
    "physical": ("meta_physical_models.json", "schema_name string, table_name string, column_name string, data_type string, is_pk boolean, is_fk boolean, description string, version bigint"),
    "logical": ("meta_logical_models.json", "schema_name string, table_name string, column_name string, logical_name string, description string, version bigint"),
    "code_dict": ("meta_code_dict.json", "code_group string, code string, label string"),
    "indexes": ("topology_indexes.json", "schema_name string, table_name string, index_name string, columns array<string>, is_unique boolean"),
    "relations": ("topology_relations.json", "from_table string, from_column string, to_table string, to_column string, confidence double"),
    "samples": ("sql_datasets.json", "question string, target_table string, target_intent string"),
    "metrics": ("metrics.json", "name string, business_name string, expression string, aliases array<string>, tables array<string>, columns array<string>"),
    "glossary": ("glossary.json", "entries array<struct<term:string,synonyms:array<string>,category:string>>"),
}
REQUIRED = ("physical", "logical")
# Schemas of the systems themselves.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast", "mysql", "performance_schema", "sys", "system", "xdb", "outln", "dbsnmp")


class MissingSet(FileNotFoundError):
    """A required set is not there, or holds nothing."""


def clean_identifier(text):
    """An identifier without invisible characters, blanks and quotes, in upper case."""
    bare = F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"[\s \u0085  -     　]", "")
    return F.upper(F.regexp_replace(bare, "^[\"`\\[\\]]+|[\"`\\[\\]]+$", ""))


class CatalogFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, file: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{file}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _text(self, name: str) -> DataFrame:
        """(value): each file of a set as one string."""
        return self.spark.read.text(f"{self.path}/{SETS[name][0]}", wholetext=True)

    def rows(self, name: str) -> DataFrame:
        """A set's rows; none where an optional file is missing; what isn't JSON is left out and told by issues()."""
        file, fields = SETS[name]
        if not self._there(file):
            if name in REQUIRED:
                raise MissingSet(file)
            return self.spark.createDataFrame([], fields)
        kind = f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"
        return self._text(name).filter(F.try_parse_json("value").isNotNull()).select(F.explode(F.from_json("value", kind)).alias("x")).select("x.*")

    def columns(self) -> DataFrame:
        """(schema, table, column, type, is_pk, is_fk, logical_name, description, version): physical columns under their logical names.

        Rows without a schema, table or column are left out; of several rows of a column the one of the highest version
        counts. A set that leaves no column raises MissingSet.
        """
        names = [clean_identifier(F.col(f"{c}_name")).alias(c) for c in ("schema", "table", "column")]

        def newest(name: str, *fields: str) -> DataFrame:
            rows = self.rows(name).select(*names, *fields, F.coalesce("version", F.lit(0).cast("long")).alias("version")).filter("schema <> '' AND table <> '' AND column <> ''")
            best = rows.groupBy("schema", "table", "column").agg(F.max(F.struct("version", *fields)).alias("x"))
            return best.select("schema", "table", "column", "x.*")

        physical = newest("physical", "data_type", "is_pk", "is_fk", "description")
        logical = newest("logical", "logical_name", "description").withColumnRenamed("description", "said").drop("version")
        yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        text = lambda *c: F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in c), F.lit(""))
        found = physical.join(logical, ["schema", "table", "column"], "left").select("schema", "table", "column", F.col("data_type").alias("type"), yes("is_pk"), yes("is_fk"), text("logical_name").alias("logical_name"), text("said", "description").alias("description"), "version")
        if found.isEmpty():
            raise MissingSet(SETS["physical"][0])
        return found

    def glossary(self) -> DataFrame:
        """(term, synonym, category): the members of each group, unnested; a term without synonyms has one row without."""
        entries = self.rows("glossary").select(F.explode("entries").alias("e")).select("e.*").filter("trim(term) <> ''")
        return entries.select("term", F.explode_outer("synonyms").alias("synonym"), "category")

    def issues(self) -> DataFrame:
        """(level, source, detail): sets that are missing or aren't JSON, terms that come twice, and references to no table or column."""
        made = []
        say = lambda level, source, detail: (F.lit(level).alias("level"), F.lit(source).alias("source"), detail.alias("detail"))
        one = self.spark.range(1)
        for name, (file, _) in SETS.items():
            if not self._there(file):
                made.append(one.select(*say("warning", file, F.lit("missing"))))
            else:
                made.append(self._text(name).filter(F.try_parse_json("value").isNull()).select(*say("error", file, F.lit("not JSON"))))
        known = self.columns().select("schema", "table", "column", F.concat_ws(".", "schema", "table").alias("name"))
        tables = known.select("name").distinct()
        twice = self.rows("glossary").select(F.explode("entries.term").alias("term")).groupBy(F.lower(F.trim("term")).alias("term")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND term <> ''")
        made.append(twice.select(*say("warning", SETS["glossary"][0], F.concat(F.lit("duplicate term "), "term"))))
        metrics = self.rows("metrics")
        made.append(metrics.filter("trim(coalesce(name, '')) = '' OR trim(coalesce(expression, '')) = ''").select(*say("error", SETS["metrics"][0], F.concat(F.lit("no name or expression "), F.coalesce("name", F.lit(""))))))
        of = metrics.select("name", "columns", F.explode("tables").alias("t")).select("name", "columns", clean_identifier(F.col("t")).alias("t"))
        made.append(of.join(tables, F.col("t") == tables["name"], "left_anti").select(*say("error", SETS["metrics"][0], F.concat(F.lit("unknown table "), "t"))))
        wanted = of.select("t", F.explode("columns").alias("c")).select("t", clean_identifier(F.col("c")).alias("c")).filter("NOT contains(c, '.')").join(tables, F.col("t") == tables["name"], "left_semi")
        made.append(wanted.join(known, (F.col("t") == known["name"]) & (F.col("c") == known["column"]), "left_anti").select(*say("warning", SETS["metrics"][0], F.concat("t", F.lit(" has no column "), "c"))))
        ends = self.rows("relations").select(F.explode(F.array("from_table", "to_table")).alias("t")).select(clean_identifier(F.col("t")).alias("t"))
        made.append(ends.join(tables, F.col("t") == tables["name"], "left_anti").select(*say("error", SETS["relations"][0], F.concat(F.lit("unknown table "), "t"))))
        return reduce(DataFrame.unionByName, made).distinct()


def write_set(df: DataFrame, path: str, name: str, objects: int = 10_000) -> None:
    """Writes a set as a folder of files, each a JSON array of at most so many objects; an empty set is an empty array."""
    chunk = F.floor(F.monotonically_increasing_id() / objects)  # within a partition
    lists = df.select(chunk.alias("chunk"), F.to_json(F.struct("*")).alias("j")).groupBy("chunk").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    lists = lists.select("value") if not df.isEmpty() else df.sparkSession.createDataFrame([("[]",)], "value string")
    lists.write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/{SETS[name][0]}")


def schemas(spark: SparkSession) -> DataFrame:
    """(schema, kind): the schemas of the session's catalog that are no system's, by name."""
    found = spark.sql("SHOW SCHEMAS").toDF("schema")
    return found.filter(~F.lower("schema").isin(*SYSTEM_SCHEMAS)).select("schema", F.lit("schema").alias("kind")).orderBy("schema")


def _given(s: SparkSession, d: str) -> CatalogFolder:
    """Sets made from the given tables: brands are schemas, names tables and parts columns."""
    part, folder = table(s, d, "part"), new_path(s, "catalog")
    name = "replace(p_name, ' ', '_')"
    physical = part.selectExpr("IF(p_partkey % 41 = 0, ' ', p_brand) AS schema_name", f"concat('`', {name}, '` ') AS table_name", "concat('c', p_partkey % 300) AS column_name", "p_type AS data_type", "p_size = 1 AS is_pk", "IF(p_size = 2, true, NULL) AS is_fk", "IF(p_size % 2 = 0, p_type, '') AS description", "CAST(p_size AS BIGINT) AS version")
    logical = part.filter("p_size > 20").selectExpr("p_brand AS schema_name", f"upper({name}) AS table_name", "concat('C', p_partkey % 300) AS column_name", "p_name AS logical_name", "IF(p_size % 3 = 0, 'said', ' ') AS description", "CAST(p_size AS BIGINT) AS version")
    metrics = part.filter("p_size = 9").selectExpr("p_name AS name", "p_type AS business_name", "IF(p_partkey % 5 = 0, '', 'SUM(x)') AS expression", "array(p_type) AS aliases", f"array(concat(p_brand, '.', {name}), 'NO.SUCH') AS tables", "array(concat('c', p_partkey % 300), 'A.B', 'zz') AS columns")
    relations = part.filter("p_size = 3").selectExpr(f"concat(p_brand, '.', {name}) AS from_table", "'x' AS from_column", "p_type AS to_table", "'y' AS to_column", "0.5D AS confidence")
    for rows, set_ in ((physical, "physical"), (logical, "logical"), (metrics, "metrics"), (relations, "relations")):
        write_set(rows, folder, set_)
    return CatalogFolder(s, folder)


QUERIES = {
    "catalog_columns": lambda s, d: _given(s, d).columns(),
    "catalog_issues": lambda s, d: _given(s, d).issues(),
}

_N = "upper(replace(p_name, ' ', '_'))"
_COLS = f"ph AS (SELECT schema, tb, col, max(struct_pack(v := v, t := t, p := p, f := f, d := d)) AS x FROM (SELECT upper(p_brand) AS schema, {_N} AS tb, 'C' || p_partkey % 300 AS col, p_type AS t, p_size = 1 AS p, CASE WHEN p_size = 2 THEN true END AS f, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS d, p_size::BIGINT AS v FROM part WHERE p_partkey % 41 <> 0) GROUP BY 1, 2, 3), lo AS (SELECT schema, tb, col, max(struct_pack(v := v, n := n, d := d)) AS y FROM (SELECT upper(p_brand) AS schema, {_N} AS tb, 'C' || p_partkey % 300 AS col, p_name AS n, CASE WHEN p_size % 3 = 0 THEN 'said' ELSE ' ' END AS d, p_size::BIGINT AS v FROM part WHERE p_size > 20) GROUP BY 1, 2, 3)"
ORACLE_SQL = {
    "catalog_columns": f"WITH {_COLS} SELECT ph.schema, ph.tb AS \"table\", ph.col AS \"column\", x.t AS type, x.p AS is_pk, coalesce(x.f, false) AS is_fk, coalesce(y.n, '') AS logical_name, coalesce(nullif(trim(y.d), ''), x.d) AS description, x.v AS version FROM ph LEFT JOIN lo USING (schema, tb, col)",
    "catalog_issues": f"WITH {_COLS}, m AS (SELECT p_name AS name, p_partkey % 5 = 0 AS bare, upper(p_brand) || '.' || {_N} AS t, 'C' || p_partkey % 300 AS c FROM part WHERE p_size = 9), k AS (SELECT DISTINCT schema || '.' || tb AS t FROM ph), i AS (SELECT 'warning' AS level, unnest(['meta_code_dict.json', 'topology_indexes.json', 'sql_datasets.json', 'glossary.json']) AS source, 'missing' AS detail UNION ALL SELECT 'error', 'metrics.json', 'no name or expression ' || name FROM m WHERE bare UNION ALL SELECT 'error', 'metrics.json', 'unknown table NO.SUCH' FROM m UNION ALL SELECT 'error', 'metrics.json', 'unknown table ' || t FROM m WHERE t NOT IN (SELECT t FROM k) UNION ALL SELECT 'warning', 'metrics.json', t || ' has no column ZZ' FROM m WHERE t IN (SELECT t FROM k) UNION ALL SELECT 'warning', 'metrics.json', t || ' has no column ' || c FROM m WHERE t IN (SELECT t FROM k) AND NOT EXISTS (SELECT 1 FROM ph WHERE schema || '.' || tb = m.t AND col = c) UNION ALL SELECT 'error', 'topology_relations.json', 'unknown table ' || t FROM (SELECT upper(p_brand) || '.' || {_N} AS t FROM part WHERE p_size = 3 UNION ALL SELECT p_type FROM part WHERE p_size = 3) WHERE t NOT IN (SELECT t FROM k)) SELECT DISTINCT * FROM i",
}
