"""Each operator against a brute-force version, on a small table with nulls, empty and long texts, ties, repeated rows and a clashing column."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, score double, batch int"


def _texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(70), say(160)
    out = [None, "", "   \t\n ", "one", "One TWO three", say(30), say(30) + "\n" + say(12), base, base]
    near = base.split()
    near[90] = "changed"
    out += [" ".join(near), say(20) + " " + passage + "\n" + say(9), passage + " " + say(40), say(5) + "\t" + passage, say(3000), "é " * 60 + "ß", "x" * 300]
    line = say(14).split()
    out += [" ".join(line) + "\n" + say(10), say(8) + "\n" + " ".join([*line[:-1], "other"]) + "\n\n" + say(8), " ".join(line)]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    got = list(enumerate(texts))
    return [*got, (None, texts[7]), (None, "one"), (3, "one"), (40, texts[12]), (40, texts[12])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(found):
    return sorted(map(tuple, found), key=repr)


def test_simhash(docs, rows, empty):
    from tidemark.llm.simhash import near_duplicates

    fps = [brute.fingerprint(t) for _, t in rows]
    want = [(d, f - (1 << 64) if f >> 63 else f, c) for (d, _), f, c in zip(rows, fps, brute.components([d for d, _ in rows], fps))]
    assert _sorted(near_duplicates(docs).collect()) == _sorted(want)
    assert near_duplicates(empty).count() == 0


def test_simhash_links_are_whole_when_tiles_split(spark):
    from tidemark.llm.graph import components
    from tidemark.llm.simhash import links

    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps = list({f ^ (1 << rng.randrange(64)) for f in fps for _ in range(6)} | set(fps))
    want = brute.components(fps, fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in components(links(df, tile_rows=3)).collect()}
    groups = lambda labels: {frozenset(f for f, x in zip(fps, labels) if x == y) for y in set(labels)}
    assert groups([roots.get(f, f) for f in fps]) == groups(want)


def test_repeats(docs, rows, empty):
    from tidemark.llm.substring import remove_repeats

    found = remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert _sorted(found.collect()) == _sorted(brute.repeats(rows))
    assert remove_repeats(empty).count() == 0


def _kept_lines(rows):
    last, places = 1 << 63, []
    for k, (d, t) in enumerate(rows):
        for i, l in enumerate((t or "").split("\n")):
            if s := frozenset(l.split()):
                places.append(((last if d is None else d), i, s, k))
    first = {}
    for d, i, s, _ in places:
        first[s] = min((d, i), first.get(s, (d, i)))
    similar = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    gone = {s for s in first for o in first if o != s and first[o] < first[s] and similar(s, o)}
    out = []
    for k, (d, t) in enumerate(rows):
        drop = {i for e, i, s, j in places if j == k and (s in gone or (e, i) != first[s])}
        lines = (t or "").split("\n")
        out.append((d, len(lines) if t else 0, len(drop), hashlib.sha256("\n".join(l for i, l in enumerate(lines) if i not in drop).encode()).hexdigest()))
    return out


def test_lines(docs, rows, empty):
    from tidemark.llm.lines import remove_similar_lines

    found = remove_similar_lines(docs)
    assert set(docs.columns) < set(found.columns)
    assert _sorted(found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256)).collect()) == _sorted(_kept_lines(rows))
    assert remove_similar_lines(empty).count() == 0


def test_long_lines_that_share_words_do_not_all_meet(spark, monkeypatch):
    """Lines of many words of a small vocabulary: unlike ones are told apart before they are paired, and similar ones of about 48 words are found."""
    from tidemark.llm import lines

    rng = random.Random(6)
    rows = [(k, " ".join(rng.sample([f"v{i}" for i in range(600)], rng.randint(150, 190)))) for k in range(300)]
    for k in range(300, 420):
        line = rows[k - 300][1].split()[: rng.randint(40, 60)]
        rows += [(k, " ".join(line)), (k + 1000, " ".join([*line[rng.randint(0, 6) :], *(f"x{i}" for i in range(rng.randint(0, 7)))]))]
    met, removed = [], lines._removed
    monkeypatch.setattr(lines, "_removed", lambda pairs, *more: met.append(pairs.distinct().count()) or removed(pairs, *more))
    found = lines.remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _sorted(found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256)).collect()) == _sorted(_kept_lines(rows))
    assert sum(met) < 400


def test_similar_lines_of_every_size(spark):
    """Sets at the edge of the similarity, larger or smaller first, few to a word: no first step, and none are sorted to meet."""
    from tidemark.llm import lines

    rng = random.Random(8)
    rows = []
    for n in [*range(1, 70), *range(120, 131)]:
        base = [f"s{n}w{i}" for i in range(n)]
        more = [f"s{n}x{i}" for i in range(n // 4 + 1)]
        group = [base, base + more[:-1], base + more, base[: n - n // 9] + more[: n // 9], base[n // 5 :]]
        rows += [" ".join(rng.sample(x, len(x))) for x in group if x]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = lines.remove_similar_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256))
    assert _sorted(found.collect()) == _sorted(_kept_lines(list(enumerate(rows))))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    classes = lines.stored(lines._classes(lines._lines(hashed, lines.rarity(hashed)))).withColumn("settled", F.lit(False))
    plan = lines._rest(classes, 0)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert lines._crowded(classes).count() == 0


def test_crowded_words_are_settled_first(spark, monkeypatch):
    """Near copies in one large group leave far fewer pairs than all with all, and the result stays exact."""
    from tidemark.llm import lines

    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    rows = [(k, " ".join(w if rng.random() > 0.04 else f"n{rng.randrange(10**6)}" for w in base)) for k in range(400)]
    met, removed = [], lines._removed
    monkeypatch.setattr(lines, "_removed", lambda pairs, *more: met.append(pairs.distinct().count()) or removed(pairs, *more))
    found = lines.remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _sorted(found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256)).collect()) == _sorted(_kept_lines(rows))
    assert sum(met) < 400 * 399 / 2 / 5


def test_words_of_lines_are_made_once(spark):
    """A filter for lines with words does not hash and order all words a first time."""
    from tidemark.llm import lines

    docs = spark.createDataFrame([(1, 2, "a b c d\n  \n e")], "doc_id long, th long, text string")
    plan = lines._lines(docs, F.array(*[F.lit(1).cast("tinyint")] * 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array(") == 1


def test_equal_places_of_rows_that_share_an_id(spark):
    """Neither equal nor similar lines at one place of two texts of one doc_id remove each other; later ones go."""
    from tidemark.llm.lines import remove_similar_lines

    line = "p q r s t u v w x "
    rows = [(5, "a b c d e"), (5, "a b c d e\nmore words in here"), (7, line + "y"), (7, line + "z\na b c d e"), (8, "f g\n" + line + "y"), (None, "h i j"), (None, "h i j\nk")]
    found = remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _sorted(found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256)).collect()) == _sorted(_kept_lines(rows))


def test_lines_by_their_words(spark):
    """Near copies in a large group, words whose 31-bit hashes are equal, sets at the edge of the similarity, and clashing names."""
    from tidemark.llm.lines import dedup_lines, remove_similar_lines

    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(60)]
    base = [rng.choice(vocab) for _ in range(20)]
    rows = [(0, "w138121 one two three"), (1, "w314567 one two three"), (2, "a b c d"), (3, "a b c d e"), (4, "a b c e f")]
    for k in range(5, 120):
        line = list(base)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(20)] = rng.choice(vocab)
        rows.append((k, " ".join(line) + "\n" + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))))
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, _id int, kept int, n_chars long")
    found = remove_similar_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("line_dedup.kept", 256), "_id", "kept")
    assert _sorted(found.collect()) == _sorted((*r, 1, 2) for r in _kept_lines(rows))
    less = dedup_lines(docs)
    assert less.columns == docs.columns and less.filter("doc_id = 3").first().text == ""
    assert less.filter("n_chars <> length(text) and n_chars <> 3").count() == 0
    with pytest.raises(ValueError):
        remove_similar_lines(docs, "kept")


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, rows, empty, order):
    from tidemark.llm.ngram import DISCOUNT, PER_DECADE, score

    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))
    tok = lambda t: [*brute.words((t or "").translate(brute.LOWER)), "\0end"]
    grams = [{} for _ in range(order)]
    context = lambda w, i, k: tuple(w[j] if j >= 0 else "\0" for j in range(i - k, i))
    for d, t in rows:
        if d is not None and d % 4 != 1:
            w = tok(t)
            for i, x in enumerate(w):
                for k in range(order):
                    at = grams[k].setdefault(context(w, i, k), {})
                    at[x] = at.get(x, 0) + 1
    n, v = sum(grams[0][()].values()), len(grams[0][()])
    found = {}
    for r in score(docs, train, order).collect():
        found.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        w = tok(t)
        base = total = 0.0
        for i, x in enumerate(w):
            p = (grams[0][()].get(x, 0) + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, order):
                if at := grams[k].get(context(w, i, k)):
                    p = max(at.get(x, 0) - DISCOUNT, 0) / sum(at.values()) + DISCOUNT * len(at) / sum(at.values()) * p
            total += math.log10(p)
        same = [r for r in found[d] if r.n_tokens == len(w) and r.base_score == pytest.approx(base)]
        assert same and all(r.train_tokens == n and total - order * len(w) / PER_DECADE <= r.score <= total + 1e-6 for r in same)  # codes are rounded down
    assert score(empty, F.lit(True)).count() == 0


def test_elias_fano_round_trip():
    from tidemark.llm.ngram import EliasFano

    rng = np.random.default_rng(3)
    for values in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), np.sort(rng.integers(0, 90, 3000).astype(np.uint64))):
        got = EliasFano(*EliasFano.encode(values))
        assert np.array_equal(got.range(0, len(values)), values)
        assert np.array_equal(got.range(len(values) // 3, len(values) // 2), values[len(values) // 3 : len(values) // 2])


def test_nearest(spark, sf_dir):
    from tidemark.llm.ann import search, vectors

    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] * 64)], "vec_id long, embedding array<float>")
    found = vectors(raw.unionByName(bad))
    data = [(r.vec_id, np.array(r.v)) for r in found.collect()]
    assert {i for i, _ in data}.isdisjoint(range(9000, 9004))
    got = {}
    for r in search(found, found.filter("vec_id % 50 = 0"), top=10, least=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = total = 0
    for q, v in data:
        if q % 50 == 0:
            best = [i for _, i in sorted((-float(x @ v), i) for i, x in data if i != q)[:10]]
            hit, total = hit + len(set(best) & set(got[q])), total + 10
    assert hit / total >= 0.9
    assert search(found.limit(0), found).count() == 0


def test_traverse_is_ordered():
    from tidemark.llm.ann import traverse

    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    cells = traverse(a, b, np.ones(35, np.int64), 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def test_media(docs, rows, empty):
    from tidemark.llm.media import decode, media_columns

    for r in media_columns(docs).collect():
        back = decode(bytes(r.media))
        assert len(back) == r.payload_bytes and len(back) % 192 == 0 and len(back) > 0
        assert r.payload_sha256 == hashlib.sha256(back).hexdigest() and r.tail_crc32 == zlib.crc32(back[-16:])
        assert back[: r.n_bytes] in {(t or "").encode() for _, t in rows} and set(back[r.n_bytes :]) <= {32}
        assert all(p.low != p.high and 1 <= p.delta <= 8 for p in r.fingerprint)
    assert media_columns(docs).count() == len(rows) and media_columns(empty).count() == 0


def test_packing(docs, rows, empty):
    from tidemark.llm.packing import default_tokenizer, pack_documents

    for limits in ({}, {"max_docs": 3}, {"max_cost": 2048 * 2048 // 2 + 2048 * 2048 // 2, "rule": "norm"}):
        seqs = {}
        found = pack_documents(docs, default_tokenizer(), **limits).collect()
        for r in found:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 2048 and len(s) <= limits.get("max_docs", 2048)
        assert sum(r.piece == 0 for r in found) == len(rows)
        if not limits:  # the least number possible, as all but a few pieces are short
            assert len(seqs) == -(-sum(r.length for r in found) // 2048)
    assert pack_documents(empty, default_tokenizer()).count() == 0


def test_packing_ids_are_those_of_whole_texts(docs, rows):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import default_tokenizer, pieces

    t = Tokenizer.from_file(default_tokenizer())
    want = []
    rows = [*rows, (50, "say <|endoftext|> or<|startoftext|>x"), (51, "It's\u00a0n\u0303ot\x0bTHE\x0c\x1c end\u3000."), (52, "a" * 9000), (53, "<|EndOfText|> Mr.X's a.b,c;'.s don't.'t 1.2!?x <|endoftext|>.Y"), (54, "A\u0301.\u0323b İ.I ΑΣ. ǅ,x \u212a.K")]
    docs = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for i in range(0, len(ids), 64)]
    assert _sorted(pieces(docs, default_tokenizer(), 64).collect()) == _sorted(want)


def test_bpe(docs, rows, empty):
    import public_tokenizers
    import tiktoken

    from tidemark.llm.bpe import encode_decode, ranks

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    rng = random.Random(2)
    rows = [*rows, *((60 + k, "".join(rng.choice("abcde\u00e9\u4e2d\U0001f600\n 12") for _ in range(300))) for k in range(6)), (70, "".join(rng.choice("thereandiot") for _ in range(40_000))), (71, "a" * 5000)]
    docs = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    found = encode_decode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids", "decoded").collect()
    want = [(d, e.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
    assert _sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found) == _sorted(want)
    assert encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_folds_frequent_words_once(spark, monkeypatch):
    """Words that many slices hold are folded once, and ids are right whether a match is broadcast, folded in its slice or long."""
    import public_tokenizers
    import tiktoken

    from tidemark.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(4)
    common = ["".join(rng.choice("thereandiot\u00e9\u4e2d") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    rows = [(k, " ".join([*rng.sample(common, 80), f"own{'abcdefghij'[k % 10] * (k + 1)}"])) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "x" * 1500), (53, "x" * 1500 + " " + common[0]), (54, "It's\x1c\x1d 's'll\x1f12a\n\n \t b\x0b\x0c$%_ \x00 "), (55, "It's\x1c\x85\u00a0'll 1\u00b2a\n\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 2000)
    folded, distinct_words = [], bpe.distinct_words
    monkeypatch.setattr(bpe, "distinct_words", lambda *x: folded.append(distinct_words(*x)) or folded[-1])
    for known in (1 << 20, 100, 0):
        monkeypatch.setattr(bpe, "KNOWN", known)
        found = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded").collect()
        ids = {d: e.encode_ordinary(t or "") for d, t in rows}
        want = [(d, len(ids[d]), hashlib.sha256(",".join(map(str, ids[d])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids[d], (t or "").encode()) for d, t in rows]
        assert _sorted((*r[:4], list(r.ids), bytes(r.decoded)) for r in found) == _sorted(want)
    words = [[w for r in x.select("words").collect() for w in r.words] for x in folded]
    assert max(Counter(words[0]).values()) == 1 < max(Counter(words[2]).values())
    assert len(words[0]) < len(words[1]) <= len(words[2])


def test_toxicity(spark, sf_dir, docs, rows, empty):
    from tidemark.llm.toxicity import detect

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = detect(docs, labels)
    assert "score" in docs.columns and found.count() == len(rows) and found.filter("score is null or score < 0 or score > 1").count() == 0
    assert detect(empty, labels).count() == 0 and detect(docs, labels.limit(0)).select("score").distinct().count() == 1
    bad = labels.select("doc_id", F.lit(7).alias("toxic")).limit(5).unionByName(labels.select("doc_id", "toxic"))
    assert detect(docs, bad).count() == len(rows)


def test_toxicity_grammar():
    from tidemark.llm.toxicity import Grammar, Transducer, aim, forms, negation, speech

    g = Grammar({"idiot ": 1.0})
    cases = {
        "an idiot": ["bare"], "you idiot": ["aimed"], "idiot that you are": ["aimed"], "not an idiot": ["negated"], "she said idiot": ["reported"],
        "\"hello\" he is an idiot": ["aimed"], "he wrote \"idiot\"": ["reported"], "not an idiot but you idiot": ["negated", "aimed"], "idiots": [],
        "i will kill you idiot": ["threat", "threat"], "i am killing you": ["threat"], "stabbed them": ["threat"], "wir verletzten euch": ["threat"], "i won't hurt you": [],
        "you " + "and " * 400 + "idiot": ["aimed"], "nobody said " + "that " * 900 + "idiot": ["reported"],
    }
    for text, want in cases.items():
        assert [label for label, _ in g.matches(text)] == want, text[:40]
    assert g.features("you " + "and " * 400 + "idiot. fine")[1] == pytest.approx(math.log(2))
    # A composed machine writes what its parts write one after the other.
    rng, parts = random.Random(1), (negation(2), speech(), aim())
    whole = parts[0].compose(parts[1]).compose(parts[2])
    for _ in range(300):
        symbols = [rng.choice(["word", "target", "negation", "report", "quote", "insult", "threat"]) for _ in range(12)]
        steps, weight = symbols, 0.0
        for p in parts:
            out = p.run(steps)
            steps, weight = [x for x, _ in out], weight + sum(w for _, w in out)
        got = whole.run(symbols)
        assert [x for x, _ in got] == steps and sum(w for _, w in got) == pytest.approx(weight)
    assert isinstance(whole, Transducer) and "stabbing" in forms("stab", "en") and "burned" in forms("burn", "en") and "geschlagt" in forms("schlagen", "de")


def test_toxicity_on_held_out_rows(spark):
    from tidemark.llm.toxicity import op7_toxicity

    sf_dir = "/root/testdata/sf0.1"  # the smaller ones have a handful of toxic rows
    found = op7_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    hit, miss, wrong, clean = found.agg(*(F.expr(f"count_if({x})") for x in ("predicted = 1 and toxic = 1", "predicted = 0 and toxic = 1", "predicted = 1 and toxic = 0", "toxic = 0"))).first()
    assert hit >= 0.85 * (hit + miss) and wrong <= 0.01 * clean


def test_compaction(spark, docs, rows, tmp_path):
    from tidemark.llm.compaction import Conflict, Dataset

    data = Dataset(spark, str(tmp_path / "set"), fan_in=3, smallest_bytes=1000)
    assert data.append(docs.limit(0), by="batch") == 0
    for k in range(7):
        data.append(docs)
    before = len(data.manifest()[1])
    version = data.compact()
    assert before == 7 and len(data.manifest()[1]) < 7 and data.read().count() == 7 * len(rows)
    assert data.read(7).count() == 7 * len(rows)  # an older version, till it is vacuumed
    with pytest.raises(Conflict):
        data.commit(version - 1, [])
    assert data.vacuum() and data.read().exceptAll(data.read(version)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name


def test_arrivals_by_any_value_are_kept(spark, tmp_path):
    from tidemark.llm.compaction import Dataset

    values = [None, "a:b", "x+y z", "50%", "", "plain", "é=1", "a/b"]
    rows = [(i, values[i % len(values)]) for i in range(40)]
    data = Dataset(spark, f"file://{tmp_path}/data", fan_in=3)
    assert data.append(spark.createDataFrame(rows, "doc_id long, by string"), by="by") == 1
    assert sorted(r.doc_id for r in data.read().collect()) == [i for i, _ in rows]
    _, runs = data.manifest()
    assert sum(r.rows for r in runs) == 40
    data.compact()
    assert data.read().count() == 40


def test_empty_texts_share_one_sequence(spark):
    from tidemark.llm.packing import pack

    found = pack(spark.range(2048).selectExpr("id AS doc_id", "0 AS piece", "1L AS length")).agg(F.count_distinct("sequence_id"), F.count_distinct("offset")).first()
    assert tuple(found) == (1, 2048)
