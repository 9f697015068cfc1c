"""Filter interactions, WARC archives and source divergence against brute-force versions.

Tables have nulls in each column, empty and long texts, ties, repeated rows, columns with clashing names, and are empty.
"""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, mask int, n long, digest string"


def _rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghAB") for _ in range(rng.randint(1, 3))) for _ in range(160)]
    say = lambda n, some=vocab: " ".join(rng.choice(some) for _ in range(n))
    texts = [None, "", " \t\n", "one", "Über ÜBER über", "a$b", say(40), say(140), say(140, vocab[:30]), say(120) + " 5%", "ABC " * 40, say(99), say(100), "é" * 30 + "A" * 3, "x" * 500, "A1b2-c3_d4 " * 9]
    texts += [say(rng.randint(1, 200)) for _ in range(60)]
    langs, sources = ["en", "de", None, ""], ["s1", "s2", "s3", None, "ß"]
    rows = [(i, t, rng.choice(langs), rng.choice(sources)) for i, t in enumerate(texts * 2)]
    rows += [rows[7], rows[7], (rows[7][0], rows[7][1], "fr", "alone"), (None, texts[7], "en", "s1"), (None, texts[7], "en", "s1"), (-5, texts[8], "de", "s2"), (900, "one", "xx", "s1"), (901, None, "xx", "s9")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 3, 7, "taken") for r in rows], SCHEMA)


def _fails(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rules = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and least is not None and doc_id > least
    return {x for x, bad in zip("ABCDE", rules) if bad}


def _interactions(rows, labels):
    least, out, total = {}, [], defaultdict(int)
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    known = [(lang or "", _fails(t or "", d, least.get(t or "")), d in good, d in toxic) for d, t, lang, _ in rows]
    for part in {k[0] for k in known}:
        mine, found = [k for k in known if k[0] == part], []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [k for k in left if x in k[1]]
                left = [k for k in left if x not in k[1]]
                total[part, x] += len(here)
                found.append((part, "".join(order), step, len(left), len(here), sum(x in k[1] for k in mine) - len(here), sum(k[1] == {x} for k in mine), sum(k[2] for k in here), sum(k[3] for k in here)))
        out += [(*f, total[part, f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def test_interactions(spark, docs, rows):
    from tidemark.llm.interactions import interactions, mask_counts

    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 120, 3)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (5000, 1, 1)]
    marked = spark.createDataFrame([(d, q, None if t is None else int(t), "clash") for d, q, t in labels], "doc_id long, quality int, toxic int, mask string")
    got = interactions(mask_counts(docs, marked))
    assert sorted(map(tuple, got.collect())) == _interactions(rows, labels)
    assert got.count() == 600 * len({r[2] or "" for r in rows})
    assert interactions(mask_counts(docs.limit(0), marked)).count() == 0
    unmarked = interactions(mask_counts(docs, marked.limit(0)))
    assert sorted(map(tuple, unmarked.collect())) == _interactions(rows, [])


def test_intervals_are_the_orders_of_a_step():
    from tidemark.llm.interactions import intervals

    for letters in (1, 3, 5):
        orders = list(permutations(range(letters)))
        for mask in range(1 << letters):
            held = {(step, rank) for step, begin, end in intervals(mask, letters) for rank in range(begin, end)}
            assert held == {(min(o.index(x) for x in range(letters) if mask >> x & 1) + 1, rank) for rank, o in enumerate(orders) if mask}


def test_a_long_text_is_counted_in_blocks(monkeypatch):
    from tidemark.llm import divergence, interactions

    rng = random.Random(1)
    raw = "".join(rng.choice(["ab ", "b\n", "Äc\t", "  ", "x" * 50, "c-D "]) for _ in range(4000)).encode()
    words, terms = interactions.word_counts(raw), divergence.frequencies(raw)
    monkeypatch.setattr(interactions, "BLOCK_BYTES", 97)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 89)
    assert interactions.word_counts(raw) == words == (len(raw.split()), len(set(raw.split())))
    assert divergence.frequencies(raw) == terms


def _pages():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["<p>", "</p>", "<div class='x'>", "text", "über", "more"]) for _ in range(n))
    htmls = [None, "", "x" * 99, "x" * 100, "é" * 50, "\r\n\r\n" + say(40), *(say(rng.randint(20, 900)) for _ in range(60)), say(200_000)]
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(htmls * 2, 10)]
    rows += [(3, "http://evil/\r\nX: y", htmls[10]), (None, None, htmls[11]), (None, "u", htmls[5]), (400, None, "y" * 300), (400, "v", "y" * 300), (401, "w", "y" * 300), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    return rows


def test_archives_round_trip(spark, tmp_path):
    from tidemark.llm.warc import read_archives, write_archives

    rows = _pages()
    pages = spark.createDataFrame([(*r, "taken", 4) for r in rows], "page_id long, url string, html string, digest string, first long")
    folder = f"file://{tmp_path}/archives"
    manifest = write_archives(pages, folder, archive_bytes=200_000)
    got = read_archives(manifest, folder).collect()
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    refer = lambda i, h: None if least.get(h) in (None, i) else least[h]
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response" if refer(i, h) is None else "revisit", refer(i, h), (h or "").encode() if refer(i, h) is None else None) for i, _, h in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert "http://evil/%0D%0AX: y" in {r.url for r in got} and sum(r.url is None for r in got) == 2
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) + manifest.count()
    assert manifest.filter("dictionary_bytes > 0").count() > 0
    assert read_archives(write_archives(pages.limit(0), folder), folder).count() == 0


def test_archives_are_what_any_reader_expects(tmp_path):
    import struct

    import zstandard

    from tidemark.llm.warc import frames, page_record, parse, write

    rng = random.Random(2)
    records = [page_record(i, "http://a", (f"<html><p class='x'>{i}</p>" + "".join(rng.choice("<>/ abc") for _ in range(300))).encode(), "00", None) for i in range(300)]
    with open(tmp_path / "a", "wb") as out:
        held = write(out, records)
    raw = (tmp_path / "a").read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and held and len(raw) < sum(map(len, records))
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(raw[8 + size :], read_across_frames=True).read()
    assert whole == b"".join(records)
    with open(tmp_path / "a", "rb") as f:
        assert list(frames(f)) == records
    with open(tmp_path / "cut", "wb") as out:
        out.write(raw[:-5])
    with open(tmp_path / "cut", "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(frames(f))
    with pytest.raises(ValueError):
        parse(records[0][:-2])
    with open(tmp_path / "few", "wb") as out:
        assert write(out, records[:3]) == 0
    with open(tmp_path / "few", "rb") as f:
        assert list(frames(f)) == records[:3]


def _divergence(rows, least=3, ranks=200, scale=10**9):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, in_docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        found = Counter(t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        mine = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in mine.items()}
        q = share({t: sum(c[t] for c in mine.values()) for t in kept})
        f = lambda a, b: (a - b) * (a - b) // b
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_divergence(spark, docs, rows, monkeypatch):
    from tidemark.llm import divergence

    want = _divergence(rows)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == want
    assert any(r[0] == "xx" and r[4] == 0 for r in want) and any(r[3] == "ß" for r in want)
    assert divergence.divergence(docs.limit(0)).count() == 0
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 60)  # several blocks of terms and tiles of sources
    monkeypatch.setattr(divergence, "AT_A_TIME", 7)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert sorted(map(tuple, divergence.divergence(docs, term_ranks=3).collect())) == _divergence(rows, ranks=3)


def test_divergence_in_tiles(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import divergence

    monkeypatch.setattr(divergence, "TILE", 2)
    p = {(0, "a"): 50, (1, "a"): 7, (1, "b"): 90, (2, "b"): 11, (4, "c"): 33}  # 4 is in neither tile of the pair 0, 1
    absent = {0: 3, 1: 4, 2: 5, 3: 6}
    rows = [(x, t, v) for (x, t), v in p.items() if x < 4] + [(x, None, v) for x, v in absent.items()]
    place, term, share = zip(*rows)
    table = pa.table({"lang": ["en"] * len(rows), "a": [0] * len(rows), "b": [1] * len(rows), "block": [0] * len(rows), "place": pa.array(place, pa.int64()), "term": pa.array(term, pa.string()), "p": pa.array(share, pa.int64())})
    got = {(r["i"], r["j"]): (r["value"], r["seen"]) for r in divergence.tile_sums(table).to_pylist()}
    at = lambda x, t: p.get((x, t), absent[x])
    assert got == {(i, j): (sum((at(i, t) - at(j, t)) ** 2 // at(j, t) for t in "ab"), 2) for a, b in (((0, 1), (2, 3)), ((2, 3), (0, 1))) for i in a for j in b}


def test_registered_queries_equal_their_sql(spark, sf_dir):
    from tests.compare import differences, tables
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    con = tables(sf_dir)
    for name in ("op11_filter_interactions", "op12_warc_dictionary", "op13_source_divergence"):
        assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""


def test_divergence_of_many_sources(spark):
    from tidemark.llm.divergence import divergence

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(9)), "en", f"s{i % 150}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence(docs).collect())) == _divergence(rows)
