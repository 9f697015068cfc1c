"""Join paths, key suggestions and relation candidates on rows made for each of their rules."""

from tidemark.operators import catalog


def test_join_paths(spark):
    edges = [("a", "b", 1, 0.0), ("b", "c", 2, 0.777), ("c", "d", 3, 0.9), ("a", "c", 9, None), ("d", "e", 4, 0.52), ("x", "x", 5, 0.9)]
    got = {(r.a, r.b): (r.depth, r.path, r.conf) for r in catalog.join_paths(spark.createDataFrame(edges, "a string, b string, ord int, conf double")).collect()}
    assert got["a", "b"] == (1, "1", 0.6) and got["c", "b"] == (1, "2", 0.78)  # no confidence is 0.6; two places
    assert got["a", "c"] == (1, "9", 0.6) and got["b", "d"] == (2, "2>3", 0.73)
    assert got["a", "e"] == (3, "9>3>4", 0.42) and got["x", "x"] == got["a", "a"] == (0, "", 1.0)


def test_key_suggestions(spark):
    columns = [("t", "k", "int", True, True), ("u", "k", "text", False, False), ("v", "k", "int", False, False), ("w", "k", "", False, True), ("m", "k", "int", False, False), ("t", "version", "int", True, True), ("t", "mine", "int", True, True), ("z", "k", "int", True, False), ("y", "k", "int", True, False)]
    masters = [("k", "m", "int"), ("version", "m", "int"), ("mine", "m", "int")]
    together = [("u", "m", 2), ("t", "m", 9)]
    make = spark.createDataFrame
    args = (make(columns, "table string, column string, type string, is_fk boolean, indexed boolean"), make(masters, "column string, to_table string, to_type string"), make([("z", "m")], "table string, to_table string"), make(together, "table string, to_table string, n long"), make([("m", "y")], "a string, b string"))
    got = {(r.table, r.column): (r.score, r.conf) for r in catalog.fk_suggestions(*args, audit=("MINE",)).collect()}
    assert got == {("t", "k"): (8.0, 0.85), ("u", "k"): (3.0, 0.65), ("v", "k"): (2.0, 0.6), ("w", "k"): (2.0, 0.6)}
    few = {r.table: r.score for r in catalog.fk_suggestions(*args, many=6).collect() if r.column == "k"}
    assert few == {"t": 6.5, "u": 1.5}  # a column of seven tables loses 1.5; what is left at 0.5 isn't suggested


def test_relation_candidates(spark):
    columns = [("f", c, "number", False, False) for c in ("customer_no_id", "customer_key_seq", "customer_id_key", "customer", "id", "shop_key", "ref_id")]
    columns += [("f", "customer_id", "text", False, False), ("f", "pk_id", "number", True, False), ("f", "done_id", "number", False, True), ("shop", "shop_key", "number", False, False)]
    keys = [("CUSTOMER", "cid", "number"), ("PK", "x", "number"), ("DONE", "y", "number"), ("shop", "SHOP_KEY", "number"), ("zed", "shop_key", "number"), ("CUSTOMER_ID", "q", "number")]
    got = {(r.table, r.column): (r.ref, r.conf) for r in catalog.relation_candidates(spark.createDataFrame(columns, "table string, column string, family string, is_pk boolean, related boolean"), spark.createDataFrame(keys, "ref string, key string, ref_family string")).collect()}
    assert got == {
        ("f", "customer_no_id"): ("CUSTOMER", 0.7),  # one ending after the other
        ("f", "customer_key_seq"): ("CUSTOMER", 0.7),
        ("f", "customer_id_key"): ("CUSTOMER_ID", 0.7),  # _id was tried before _key
        ("f", "customer_id"): ("CUSTOMER", 0.5),
        ("f", "shop_key"): ("shop", 0.8),
        ("shop", "shop_key"): ("zed", 0.8),
    }
