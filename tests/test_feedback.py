"""Golden promotion against one pass in order, learned rules and golden cases on rows made for each of their rules."""

import random

from tidemark.operators import feedback


def one_pass(rows):
    seen, kept = set(), []
    for seq, a, b in sorted(rows):
        if a not in seen and b not in seen:
            seen |= {a, b}
            kept.append(seq)
    return kept


def test_first_of_either_is_one_pass_in_order(spark):
    rng = random.Random(4)
    chain = [(i, f"k{i}", f"k{i + 1}") for i in range(12)]  # each row blocks the next, unless it is blocked itself
    hot = [(i, "same", f"s{rng.randrange(30)}") for i in range(60)] + [(60 + i, f"q{i}", "one") for i in range(20)]
    mixed = [(i, f"q{rng.randrange(25)}", f"s{rng.randrange(25)}") for i in range(120)]
    twice = [(0, "x", "x"), (1, "x", "y"), (2, "y", "z"), (3, "z", "x")]
    for rows in (chain, hot, mixed, twice):
        got = feedback.first_of_either(spark.createDataFrame(rows, "seq int, a string, b string"), ["a", "b"], "seq").collect()
        assert sorted(r.seq for r in got) == one_pass(rows)
    assert feedback.first_of_either(spark.createDataFrame([], "seq int, a string, b string"), ["a", "b"], "seq").count() == 0


def test_golden_candidates_are_trusted_and_new(spark):
    good = dict(schema_version=2, dataset_id="d", tenant_id="t", fingerprint="f", trust_status="TRUSTED", review_status="Approved", outcome="success", executed=None, question="Q", generated_sql="select 1", final_sql="", recorded_at="x")
    changes = [
        {},
        {"question": "  q ", "final_sql": "select 9"},  # the question of row 0
        {"question": "other", "generated_sql": "SELECT\t1 ;;"},  # the SQL of row 0
        {"question": "new", "final_sql": "select 2", "outcome": "CORRECTED"},
        {"question": "late", "generated_sql": "select 2"},  # the SQL of row 3, which is kept
        {"question": "new\n", "generated_sql": "select 3"},  # the question of row 3
        {"question": "late", "generated_sql": "select 4"},  # row 4 with this question was dropped and blocks nobody
        {"question": "a", "generated_sql": "a1", "schema_version": 1},
        {"question": "b", "generated_sql": "b1", "dataset_id": "e"},
        {"question": "c", "generated_sql": "c1", "tenant_id": "u"},
        {"question": "d", "generated_sql": "d1", "fingerprint": ""},
        {"question": "e", "generated_sql": "e1", "trust_status": "untrusted"},
        {"question": "f", "generated_sql": "f1", "review_status": None},
        {"question": "g", "generated_sql": "g1", "outcome": "failure"},
        {"question": "h", "generated_sql": "h1", "executed": False},
        {"question": " ", "generated_sql": "i1"},
        {"question": "i", "generated_sql": None},
        {"question": "Known  one", "generated_sql": "j1"},
        {"question": "k", "generated_sql": "select KNOWN"},
        {"question": "l", "generated_sql": "l1", "executed": True},
    ]
    fields = list(good)
    rows = [(i, str(i), *(dict(good, **c)[f] for f in fields)) for i, c in enumerate(changes)]
    kinds = {"schema_version": "int", "executed": "boolean"}
    records = spark.createDataFrame(rows, "seq int, id string, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in fields))
    golden = spark.createDataFrame([("known one", ""), (None, "Select known;"), ("", None)], "question string, sql string")
    got = feedback.golden_candidates(records, golden, "d", "t").collect()
    assert [(r.seq, r.question, r.sql) for r in sorted(got)] == [(0, "Q", "select 1"), (3, "new", "select 2"), (6, "late", "select 4"), (19, "l", "l1")]
    assert {r.seq for r in feedback.golden_candidates(records, golden, "d", limit=1).collect()} == {0}
    assert "c" in {r.question for r in feedback.golden_candidates(records, golden, "d").collect()}


def test_learned_rules(spark):
    rows = []

    def add(n, outcome="corrected", errors=(), tables=((), ()), columns=((), ()), mark=None):
        for _ in range(n):
            rows.append((len(rows), mark or f"f{len(rows)}", outcome, list(errors), list(tables[0]), list(tables[1]), list(columns[0]), list(columns[1])))

    add(3, "failure", [("E1", "T", "C"), ("E2", None, None), ("", "T", "C")])
    add(9, "failure", [("E9", "T", "C")], mark="same")  # copies count once
    add(2, "failure", [("E3", "T", "C")])
    add(3, tables=(("A", "X"), ("B", "X")), columns=(("A.P", "X.Q"), ("B.P", "X.Q")))
    add(3, "Corrected", columns=(("S.A.OLD",), ("S.A.NEW",)))
    add(4, tables=(("A", "D"), ("B", "C")))  # two names for two are no swap
    add(4, "success", tables=(("M",), ("N",)))
    add(4, tables=(("M",), ()))
    log = [(["A", "B", "A"], 5000, True, "")] * 2 + [(["A"], 8001, True, None)] + [(["A"], 4999, True, "")] * 5 + [(["B"], 9000, False, "E7")] * 3 + [(["B"], 1, False, "CANCELED")] * 5 + [(["B"], 1, False, None)] * 5 + [([], 9999, True, "")] * 5
    records = spark.createDataFrame(rows, "seq int, fingerprint string, outcome string, errors array<struct<code:string,table:string,column:string>>, generated_tables array<string>, final_tables array<string>, generated_columns array<string>, final_columns array<string>")
    calls = spark.createDataFrame(log, "tables array<string>, elapsed_ms long, success boolean, error_code string")
    got = {tuple(r) for r in feedback.learned_rules(records, calls).collect()}
    assert got == {
        ("recurring_error", "E1", "T", "C", None, 3, None),
        ("recurring_error", "E2", "", "", None, 3, None),
        ("table_correction", None, "A", None, "B", 3, None),
        ("column_correction", None, "A", "P", "P", 3, None),
        ("column_correction", None, "S.A", "OLD", "NEW", 3, None),
        ("slow_query", None, "A", None, None, 3, 6000),
        ("recurring_exec_error", "E7", "B", None, None, 3, None),
    }
    assert feedback.learned_rules(records.limit(0), calls.limit(0)).count() == 0


def test_golden_cases(spark):
    cases = spark.createDataFrame(
        [
            (1, ["A", "B"], ["X", "Y", "Y"], ["m"], True, 5, 5, 9),
            (2, ["C"], [], [], True, 0, 1, None),
            (3, [], ["Z"], ["n"], False, None, 1, 2),
            (4, ["A", "C", "A"], [], ["m", "n"], True, 7, None, None),
        ],
        "case int, tables array<string>, columns array<string>, metrics array<string>, executed boolean, rows long, min_rows long, max_rows long",
    )
    ranked = spark.createDataFrame([(1, "B", 2), (1, "Q", 1), (1, "B", 5), (4, "A", 3), (9, "C", 1)], "case int, table string, rank int")
    columns = spark.createDataFrame([(1, "X"), (1, "X"), (3, "Y")], "case int, column string")
    metrics = spark.createDataFrame([("m",), ("m",)], "metric string")
    paths = spark.createDataFrame([("B", "A")], "a string, b string")
    got = feedback.evaluate(cases, ranked, columns, metrics, paths)
    assert sorted(map(tuple, got.collect())) == [
        (1, True, 2, 0.5, True, True, True, "column:Y table:A"),
        (2, False, None, 1.0, True, True, False, "rows:0 table:C"),
        (3, False, None, 0.0, False, True, None, "column:Z exec: metric:n"),
        (4, True, 3, 1.0, False, False, None, "join:A->C join:C->A metric:n table:C"),
    ]
    assert tuple(feedback.evaluation_totals(got).first()) == (4, 0.5, 0.63, 0.5, 0.75, 2, 0.5, 0)
    assert tuple(feedback.evaluation_totals(got.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    gain = feedback.retrieval_gain(cases, ranked, spark.createDataFrame([(1, "A"), (1, "B"), (2, "X")], "case int, table string"))
    assert sorted(map(tuple, gain.collect())) == [(1, 0.5, 1.0, -0.5), (2, 0.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 0.5, 0.0, 0.5)]
