"""Reproducible samples, profiles at three depths and the candidates made from them."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import profile_modes as modes


def test_a_sample_is_the_rows_of_least_hashes(spark):
    rng = random.Random(5)
    keys = [(i, rng.choice([None, "a", "b"])) for i in range(3000)] + [(7, "twice")] * 4
    df = spark.createDataFrame(keys, "id int, part string")
    digest = lambda k: hashlib.md5("\x1f".join(["\0" if x is None else str(x) for x in k]).encode()).hexdigest()
    order = sorted(keys, key=digest)
    for n in (0, 1, 700, 2999, 3004, 9999):
        want = order[:n]
        if n < len(order) and n and digest(order[n]) == digest(order[n - 1]):
            want = [k for k in want if k != order[n]]  # rows with one key are all in or all out
        for parts in (1, 7):
            got = modes.least_hashes(df.repartition(parts), ["id", "part"], n).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    edge = order.index((7, "twice"))
    assert modes.least_hashes(df, ["id", "part"], edge + 2).count() == edge
    assert modes.least_hashes(df, ["id", "part"], None).count() == len(keys) and modes.least_hashes(df.limit(0), ["id", "part"], 5).count() == 0


def test_distinct_values_are_within_their_error_and_shown_by_mode(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 9000).cast("string").alias("many"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("é"), F.col("id") % 3)).alias("status"), F.lit("x@y").alias("user_email"), F.lit(None).cast("string").alias("empty"))
    got = {r.column: r for r in modes.profile(df, ["id"], "deep").collect()}
    assert [got[c].place for c in df.columns] == [0, 1, 2, 3, 4]
    assert all(abs(got[c].distinct - n) <= 4 * modes.ERROR * n for c, n in (("id", 40_000), ("many", 9000), ("status", 3)))
    assert (got["status"].filled, got["status"].null_ratio, got["status"].low, got["status"].high, got["status"].shortest, got["status"].longest) == (30_000, 0.25, "é0", "é2", 2, 2)
    assert got["user_email"].sensitive and got["user_email"].low is None and got["user_email"].longest == 3
    assert (got["empty"].filled, got["empty"].null_ratio, got["empty"].shortest, got["empty"].distinct) == (0, 1.0, None, 0)
    fast = modes.profile(df, ["id"], "fast").collect()
    assert {r.sampled for r in fast} == {2000} and all(r.distinct is r.low is r.longest is None for r in fast)
    assert {r.sampled for r in modes.profile(df, ["id"], "standard").collect()} == {40_000}
    assert all((r.sampled, r.null_ratio) == (0, 0.0) for r in modes.profile(df.limit(0), ["id"], "deep").collect())


def test_listed_values(spark):
    long = "ü" * 40
    rows = [(i, f"v{i % 20}", f"w{i % 21}", f"k{i % 50}", f"m{i % 51}", long if i % 2 else "s", "once" if i == 3 else None, "q") for i in range(1020)]
    df = spark.createDataFrame(rows, "id int, a string, b string, x_code string, y_code string, text string, rare string, token string")
    got = modes.listed_values(df, modes.profile(df, ["id"], "deep")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.column, r.rank)):
        by.setdefault(r.column, []).append((r.value, r.n))
    assert set(by) == {"a", "x_code", "text"}  # b and y_code have one value too many, rare is single, token is hidden
    assert by["a"] == [(f"v{i}", 51) for i in sorted(range(20), key=lambda i: f"v{i}")[:10]] and len(by["x_code"]) == 10
    assert by["text"] == [("s", 510), ("ü" * 32, 510)]
    odd = spark.createDataFrame([("x" + "ü" * 40,)] * 3, "t string")
    assert [r.value for r in modes.listed_values(odd, modes.profile(odd, ["t"], "deep")).collect()] == ["x" + "ü" * 31]
    assert modes.listed_values(df, modes.profile(df, ["id"], "fast")).count() == 0


def test_candidates(spark):
    rows = [(i, f"s{i % 3}", f"t{i % 30}", i * 1.5, i, f"c{i % 2}", "e@f") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, kind string, ORDER_STAT string, amount double, hits int, known_cd string, email_type string").withColumn("made_dt", F.lit("2024"))
    semantic = {"amount": "AMOUNT", "hits": "SCORE", "id": "NAME", "kind": "CODE"}
    profiled = modes.profile(df, ["id"], "deep")
    values = modes.listed_values(df, profiled, few_codes=50)
    got = modes.code_candidates(profiled, values.unionByName(spark.createDataFrame([("ORDER_STAT", 1, " t1 ", 9), ("ORDER_STAT", 2, " ", 9)], values.schema)), ["known_cd"], semantic)
    assert {tuple(r) for r in got.collect()} == {("kind", "kind_cd", "s0,s1,s2", 0.75), ("ORDER_STAT", "order_stat_cd", "t1", 0.7), ("made_dt", "made_dt_cd", "2024", 0.6)}
    got = modes.metric_candidates(profiled, "F", semantic)
    assert {tuple(r) for r in got.collect()} == {("amount", "sum_amount", "SUM(F.amount)", "kind,known_cd,email_type", 0.7), ("hits", "avg_hits", "AVG(F.hits)", "kind,known_cd,email_type", 0.7)}
    assert [r.column for r in modes.metric_candidates(profiled, "F", semantic, ["f.AMOUNT"]).collect()] == ["hits"]
    assert modes.metric_candidates(profiled, "F", semantic, ["hits", "F.amount"]).count() == 0
