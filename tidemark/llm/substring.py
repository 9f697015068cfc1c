"""Substring dedup by repeated-phrase automata.

1. Every document names a few anchor phrases: the phrase of `phrase` words with the least hash in each window.
   Equal windows name equal phrases, so a window that two documents share has an anchor that both name.
2. Phrases, compared by their words, that two or more different texts name are confirmed as recurring. Each goes to
   the batches of documents that named it: the phrases of a batch are a shard, compiled into an Aho-Corasick automaton
   over words, so no automaton grows with the input.
3. Each batch streams all its documents through its automaton, which locates every occurrence of the phrases.
   Windows whose anchor lies at an occurrence are candidates. A batch tells its candidates apart by a 128-bit
   BLAKE2 digest of their words, and a window meets others by one row a batch.
4. The words of windows seen in an earlier document are removed.

Copies of a text are told by sha256 before that, and only the first is searched: all of a later copy is repeated.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, discard, read, release, rolling, slices, stored, text_size

WINDOW, PHRASE = 50, 8
#: Text of a batch: its documents, automaton and windows are held together.
BATCH_BYTES = 5 << 20
#: Symbols that stand for a word in an automaton.
SYMBOLS = 3


def _anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, for each window the word where its anchor begins) of one text with word hashes h."""
    p = rolling(h, phrase)
    span = window - phrase + 1
    n = len(h) - window + 1
    if n <= 0:
        return p, np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(p, span).argmin(axis=1)
    return p, at + np.arange(n)


def _keyed(docs: DataFrame, n_batches: int) -> DataFrame:
    """doc_id, text, sha, key, batch; key and batch depend on the row alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha")).withColumn("key", F.xxhash64("doc_id", "sha")).withColumn("batch", F.pmod("key", F.lit(n_batches)).cast("int"))


def anchors(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, batch, th): the anchor phrases of each text, its words with one space between, and the text's hash."""

    def run(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h, ids, which = words.hashes(), np.asarray(batch.column("th")), np.asarray(batch.column("batch"))
            flat, starts, ends = words.spaced()
            place, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                if b - a >= window:
                    p, at = _anchors(h[a:b], window, phrase)
                    at = np.unique(at)
                    place.append(a + at[np.unique(p[at], return_index=True)[1]])
                    row.append(np.full(len(place[-1]), i))
            place, row, flat = np.concatenate(place), np.concatenate(row), flat.tobytes()
            found = [flat[x:y] for x, y in zip(starts[place].tolist(), ends[place + phrase - 1].tolist())]
            yield pa.record_batch([pa.array(found, pa.binary()).cast(pa.string()), which[row], ids[row]], names=["phrase", "batch", "th"])

    return keyed.filter("doc_id is not null").select(F.xxhash64("sha").alias("th"), "batch", "text").mapInArrow(run, "phrase string, batch int, th long")


def recurring(found: DataFrame) -> DataFrame:
    """(batch, phrases): what each batch named that two or more different texts name."""
    twice = found.groupBy("phrase").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.collect_set("batch").alias("batches")).filter("lo < hi")
    return twice.select("phrase", F.explode("batches").alias("batch")).groupBy("batch").agg(F.collect_list("phrase").alias("phrases"))


def compile_phrases(phrases: pa.Array, dictionary: pa.Array, phrase: int) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """(automaton of phrases, symbols of each word of dictionary); phrases of other words can't occur.

    A word is a few symbols, each from a small alphabet of its own, as the automaton looks through the branches of a
    state one by one; alphabets that don't meet keep matches at the borders of words.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    words = pc.split_pattern(phrases, " ").flatten().cast(pa.large_string())
    codes = pc.fill_null(pc.index_in(words, dictionary), -1).to_numpy().reshape(-1, phrase)
    codes = codes[(codes >= 0).all(axis=1)]
    used = np.unique(codes)
    number = np.zeros(len(dictionary), np.int64)  # 0: in no phrase
    number[used] = np.arange(1, len(used) + 1)
    base = 2
    while base**SYMBOLS <= len(used):
        base += 1
    symbols = number[:, None] // base ** np.arange(SYMBOLS) % base + base * np.arange(SYMBOLS) + 1
    for key in symbols[codes].reshape(len(codes), phrase * SYMBOLS).tolist():
        automaton.add_word(tuple(key))
    automaton.make_automaton()
    return automaton, symbols


def _locate(docs: pa.RecordBatch, phrases: pa.Array, window: int, phrase: int):
    """Streams documents through the automaton of phrases: (row, start, window digest) of the candidates."""
    words = Words(docs.column("text"))
    codes, h = words.codes(), words.hashes()
    automaton, symbols = compile_phrases(phrases, codes.dictionary, phrase)
    which = codes.indices.to_numpy()
    flat, begin, end = words.spaced()
    flat, digest = flat.tobytes(), hashlib.blake2b
    rows, starts, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a < window or not len(automaton):
            continue
        hit = np.zeros(b - a, dtype=bool)
        ends = np.fromiter((e for e, _ in automaton.iter(tuple(symbols[which[a:b]].ravel().tolist()))), np.int64)
        hit[ends // SYMBOLS - phrase + 1] = True
        start = np.flatnonzero(hit[_anchors(h[a:b], window, phrase)[1]])
        rows.append(np.full(len(start), i))
        starts.append(start.astype(np.int32))
        digests += [digest(flat[x:y], digest_size=16).digest() for x, y in zip(begin[start + a].tolist(), end[start + a + window - 1].tolist())]
    return np.concatenate(rows), np.concatenate(starts), digests


def _arrays(table: pa.Table, column: str) -> np.ndarray:
    """All elements of an array column."""
    return np.asarray(pa.concat_arrays(table.column(column).chunks).flatten() if table.num_rows else pa.array([], pa.int64())).astype(np.int64)


def occurrences(keyed: DataFrame, found: DataFrame, window: int, phrase: int) -> DataFrame:
    """(wh, lo, hi, docs, keys, starts): windows that may occur in two documents, with the places of each in one batch.

    found: phrases and copies of batches.
    """
    places = {"docs": pa.int64(), "keys": pa.int64(), "starts": pa.int32()}
    schema = pa.schema([("wh", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), *((k, pa.list_(t)) for k, t in places.items())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies = _arrays(right, "copies")
        phrases = pa.concat_arrays([pa.array([], pa.string()), *(x.flatten() for x in right.column("phrases").chunks)])
        left, tables = left.filter(pa.array(~np.isin(np.asarray(left.column("key")), copies))), []
        for part in slices(left.to_batches()) if len(phrases) else ():
            row, start, wh = _locate(part, phrases, window, phrase)
            tables.append(pa.table({"wh": pa.array(wh, pa.binary()), "docs": np.asarray(part.column("doc_id"))[row], "keys": np.asarray(part.column("key"))[row], "starts": start}))
        if not tables:
            return schema.empty_table()
        met = pa.concat_tables(tables).group_by("wh", use_threads=False).aggregate([("docs", "min"), ("docs", "max"), *((k, "list") for k in places)])
        return met.select(["wh", "docs_min", "docs_max", *(f"{k}_list" for k in places)]).rename_columns(schema.names).cast(schema)

    docs = keyed.select("doc_id", "key", "text", "batch")
    return docs.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, "wh binary, lo long, hi long, docs array<long>, keys array<long>, starts array<int>")


def _kept(docs: pa.Table, marks: pa.Table, window: int, keep_text: bool) -> list:
    starts, copies = {}, set(_arrays(marks, "copies").tolist())
    for key, x in zip(marks.column("key").to_pylist(), marks.column("starts")):
        starts[key] = x.values if x.is_valid else None
    out = []
    for part in slices(docs.to_batches()):
        words = Words(part.column("text"))
        ids, shas, keys = (part.column(c).to_pylist() for c in ("doc_id", "sha", "key"))
        flat, begin, end = words.spaced()
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = b - a
            cover = np.zeros(n + 1, np.int32)
            if keys[i] in copies:
                gone = np.full(n, n >= window)
            else:
                if starts.get(keys[i]) is not None:
                    s = starts[keys[i]].to_numpy()
                    np.add.at(cover, s, 1)
                    np.add.at(cover, np.minimum(s + window, n), -1)
                gone = np.cumsum(cover)[:n] > 0
            if not gone.any():
                text = flat[begin[a] : end[b - 1]].tobytes() if n else b""
            else:
                stay = np.flatnonzero(~gone) + a
                text = b" ".join(flat[x:y].tobytes() for x, y in zip(begin[stay].tolist(), end[stay].tolist()))
            out.append((ids[i], shas[i], n, int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if keep_text and gone.any() else None))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = False) -> DataFrame:
    """(doc_id, sha, n_words, n_removed, kept_sha256, kept): words covered by a window of `window` words whose
    sequence also starts in a document of a smaller doc_id are removed; kept is the text that stays where words went
    and keep_text is set, else null.

    One row per row of docs. Null and empty texts have no words; shorter texts lose none. A null doc_id is no
    smaller or larger than another: its text is left alone. Rows that share a doc_id don't repeat each other. Other
    columns are not read.
    """
    spark = docs.sparkSession
    _, size = text_size(docs)
    n_batches = max(4, -(-size // BATCH_BYTES))
    keyed = _keyed(docs, n_batches)
    ids = keyed.filter("doc_id is not null").select("doc_id", "sha", "key", "batch")
    firsts = ids.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = stored(ids.join(firsts, "sha").filter("first < doc_id").groupBy("batch").agg(F.collect_set("key").alias("copies")))
    named = stored(anchors(keyed, window, phrase))
    found = stored(recurring(named))
    discard(named)
    release(spark)
    found = found.unionByName(copies, allowMissingColumns=True)
    cand = stored(occurrences(keyed.filter("doc_id is not null"), found, window, phrase))
    release(spark)
    first = cand.groupBy("wh").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last").select("wh", "first")
    again = cand.join(first, "wh").filter("first < hi").select("first", F.explode(F.arrays_zip("docs", "keys", "starts")).alias("at")).filter("first < at.docs")
    marks = again.groupBy(F.col("at.keys").alias("key")).agg(F.collect_set("at.starts").alias("starts"))
    marks = stored(marks.withColumn("batch", F.pmod("key", F.lit(n_batches)).cast("int")))
    release(spark)

    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _kept(left, right, window, keep_text)
        return pa.table([list(x) for x in zip(*rows)], schema) if rows else schema.empty_table()

    found = marks.unionByName(copies, allowMissingColumns=True)
    texts = keyed.select("doc_id", "sha", "key", "text", "batch")
    return texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, "doc_id long, sha string, n_words long, n_removed long, kept_sha256 string, kept string")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the repeated words that remove_repeats tells; columns as before, text and n_chars (where it exists) renewed where words went.

    Nulls, short and empty texts stay as they are; other columns pass through whatever their names.
    """
    found = remove_repeats(docs, window, keep_text=True).filter("n_removed > 0").select("doc_id", "sha", "kept").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256).alias("sha"))
    met = keyed.join(found, ["doc_id", "sha"], "left")
    renew = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        renew["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return met.select(*(renew[c].alias(c) if c in renew else F.col(f"row.`{c}`") for c in docs.columns))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
