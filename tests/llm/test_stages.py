"""Pipeline stages against brute-force versions, where their rule is not that of the query they share a module with."""

import random

from tests.llm.brute import LOWER, words


def _kept(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, t) for (d, t), g in zip(rows, group) if d is None or d == least[g]), key=repr)


def test_keep_one_is_the_shingle_rule(spark):
    from tidemark.llm.simhash import keep_one

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, texts = say(60), [None, "", " \n", "one two", "One  two", "one two three"]
    for n, edits in ((50, 1), (50, 2), (100, 1), (100, 2), (100, 3), (200, 4), (200, 5), (500, 10), (500, 14), (1000, 20)):
        base = say(n)
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for i in rng.sample(range(n), edits):
                near[i] = "edited" + rng.choice(vocab)
            texts.append(" ".join(near))
    texts += [" ".join([*say(40), *passage, *say(40)]) for _ in range(12)]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (None, texts[3]), (None, None)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == _kept(rows)
    assert keep_one(got.limit(0)).count() == 0


def test_stages_keep_columns_whatever_their_names(spark, sf_dir):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from tidemark.llm.common import read

    docs = read(spark, sf_dir, "documents")
    odd = [(90_001, None), (90_002, ""), (90_003, "a b c"), (None, "a b c"), (90_004, "one line\none line"), (90_003, "a b c")]
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], docs.schema)
    names = ("score", "root", "c", "t", "node", "sha", "kept", "row", "line_dedup", "component_id", "length", "rank")
    docs = docs.unionByName(odd).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        rows = got.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}{r.doc_id or 0}" for r in rows for n in names), name
        assert {r.doc_id for r in rows} >= {90_001 if name == "simhash_near_dedup" else 90_002, None}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.filter("doc_id IN (90001, 90002)").count() == 2 and packed.filter("doc_id = 90003").count() == 2


def test_keep_one_goes_by_fingerprints(spark, monkeypatch):
    """Fingerprints alone find near copies; groups of texts that aren't similar are verified away."""
    from tidemark.llm import similar, simhash

    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long, other = say(1500), say(80)
    rows = [(1, long), (2, other), (2, long), (3, long + " more"), (4, say(80)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lumped = docs.selectExpr("doc_id", "1L as component_id")
    none = lambda named, *_: named.selectExpr("named_struct('c', c) as a", "named_struct('c', c) as b").limit(0)
    monkeypatch.setattr(similar, "_stars", none)
    monkeypatch.setattr(similar, "_all", none)
    got = sorted(r.doc_id for r in simhash.keep_one(docs).collect() if r.doc_id)
    assert got == [1, 2, 2, 4]
    monkeypatch.undo()
    found = similar.similar_documents(docs.filter("doc_id <> 2"), groups=lumped).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 1), (3, 1), (4, 4)]
