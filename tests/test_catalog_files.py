"""A catalog folder as people keep it: single files, missing and broken sets, versions, references to nothing."""

import json

import pytest

from tidemark.sources import catalog_files as files


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        (tmp_path / files.SETS[name][0]).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    row = lambda s, t, c, v=1, **more: {"schema_name": s, "table_name": t, "column_name": c, "version": v, **more}
    put("physical", [row(" pub lic", '"users"', "`id`", 1, data_type="int", is_pk=True), row("public", "users", "ID", 2, data_type="bigint", description="an id"), row("public", "", "x"), row("public", "users", "na​me", data_type="text", is_fk=None)])
    put("logical", [row("PUBLIC", "USERS", "ID", logical_name="user", description=" "), row("PUBLIC", "USERS", "ID", 0, logical_name="older"), row("PUBLIC", "OTHER", "ID", logical_name="nowhere")])
    return tmp_path, put


def test_columns_and_what_may_be_missing(spark, folder):
    path, put = folder
    made = files.CatalogFolder(spark, f"file://{path}")
    assert sorted(map(tuple, made.columns().collect())) == [("PUBLIC", "USERS", "ID", "bigint", False, False, "user", "an id", 2), ("PUBLIC", "USERS", "NAME", "text", False, False, "", "", 1)]
    assert made.rows("relations").count() == 0 and made.glossary().count() == 0
    assert {(r.level, r.source) for r in made.issues().collect()} == {("warning", files.SETS[n][0]) for n in files.SETS if n not in files.REQUIRED}


def test_a_required_set_must_be_there(spark, folder):
    path, put = folder
    (path / files.SETS["logical"][0]).unlink()
    with pytest.raises(files.MissingSet):
        files.CatalogFolder(spark, f"file://{path}").columns()
    put("logical", [])
    put("physical", [{"schema_name": "s", "table_name": " ", "column_name": "c"}])
    with pytest.raises(files.MissingSet):
        files.CatalogFolder(spark, f"file://{path}").columns()


def test_issues(spark, folder):
    path, put = folder
    put("glossary", {"entries": [{"term": "Fee", "synonyms": ["cost", "price"], "category": "metric"}, {"term": " fee ", "synonyms": []}, {"term": "", "synonyms": ["x"]}, {"term": "", "synonyms": ["y"]}]})
    put("metrics", [{"name": "m", "expression": "sum(x)", "tables": ["public.users", "no.where"], "columns": ["id", "gone", "a.b"]}, {"name": " ", "expression": "x"}])
    put("relations", [{"from_table": "PUBLIC.USERS", "to_table": "public.others"}])
    put("code_dict", "[{ broken")
    made = files.CatalogFolder(spark, f"file://{path}")
    assert sorted((r.term, r.synonym, r.category) for r in made.glossary().filter("synonym IS NOT NULL").collect()) == [("Fee", "cost", "metric"), ("Fee", "price", "metric")]
    assert made.rows("code_dict").count() == 0
    got = {tuple(r) for r in made.issues().collect() if r.detail != "missing"}
    assert got == {
        ("error", "meta_code_dict.json", "not JSON"),
        ("warning", "glossary.json", "duplicate term fee"),
        ("error", "metrics.json", "no name or expression  "),
        ("error", "metrics.json", "unknown table NO.WHERE"),
        ("warning", "metrics.json", "PUBLIC.USERS has no column GONE"),
        ("error", "topology_relations.json", "unknown table PUBLIC.OTHERS"),
    }


def test_sets_are_read_as_they_were_written(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = spark.range(25).selectExpr("concat('g', id) AS code_group", "CAST(id AS string) AS code", "IF(id = 3, NULL, 'a\n\"b\"') AS label").repartition(3)
    files.write_set(rows, path, "code_dict", objects=4)
    files.write_set(spark.createDataFrame([], files.SETS["metrics"][1]), path, "metrics")
    made = files.CatalogFolder(spark, path)
    assert sorted(map(tuple, made.rows("code_dict").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert made.rows("metrics").count() == 0


def test_schemas(spark):
    for name in ("tidemark_a", "sys"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")
    got = [r.schema for r in files.schemas(spark).collect()]
    assert "tidemark_a" in got and "default" in got and "sys" not in got and got == sorted(got)
    for name in ("tidemark_a", "sys"):
        spark.sql(f"DROP SCHEMA {name}")
