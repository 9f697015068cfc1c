"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions.

Slices of documents are turned into their distinct words and the place of each word in each text. Spark then folds
the merges over every distinct word: a word is an array of ids, of its bytes at first, with the ranks of the neighbouring
pairs, and a step joins the pair of least rank, whose rank is the joined piece's id, and looks up the two new pairs
beside it. The rank map is one literal: pairs of ids in hash buckets, as a look-up in one large map would walk all of
it. Words that are frequent in a sample of bounded size are folded first, once, and broadcast with their ids, so that a
slice folds only the others. Decoding concatenates the binary pieces of the ids. No text is shuffled, and a slice has a
bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, read, slices, stored, text_size

#: Hash buckets of the literal rank map.
BUCKETS, SPREAD = 1 << 16, 40503
#: Text of a slice, whose words are told apart together.
SLICE_BYTES = 8 << 20
#: Bytes of a match that is folded; a step costs the length, so a longer one is encoded where it is found, with a heap.
LONG = 1024
NONE = 2147483647
#: Text whose words are counted, and most words, and bytes of a word, that are broadcast with their ids.
SAMPLE_BYTES, KNOWN, KNOWN_BYTES = 128 << 20, 3 << 18, 32
#: What ASCII characters a class of a pattern has.
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": "\t-\r "}


def ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _chars(b: bytes) -> str:
    return b.decode("latin-1")


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _literals(table: dict[bytes, int]) -> Column:
    """(one: id of each byte, two: rank of each pair of bytes, k and v: bucketed pairs of ids and their ranks)."""
    pairs: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in table.items():
        for k in range(1, len(piece)):
            a, b = table.get(piece[:k]), table.get(piece[k:])
            if a is not None and b is not None:
                pairs[(a * SPREAD + b) % BUCKETS][a << 32 | b] = rank
    return F.struct(
        _literal([table[bytes([x])] for x in range(256)], "array<int>").alias("one"),
        _literal([table.get(bytes([x, y]), NONE) for x in range(256) for y in range(256)], "array<int>").alias("two"),
        _literal([list(x) for x in pairs], "array<array<bigint>>").alias("k"),
        _literal([list(x.values()) for x in pairs], "array<array<int>>").alias("v"),
    )


def _bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(word: Column, find: Column) -> Column:
    """Ids of one word given as a string with a character for each byte."""

    def rank(x: Column, y: Column) -> Column:
        def at(k: Column) -> Column:
            place = F.array_position(F.get(find["k"], k), F.shiftleft(x.cast("long"), 32) + y)
            return F.coalesce(F.get(F.get(find["v"], k), place.cast("int") - 1), F.lit(NONE))

        return _bind(((x.cast("long") * SPREAD + y) % BUCKETS).cast("int"), at)

    def merge(state: Column, at: Column, m: Column) -> Column:
        p, r = state["p"], state["r"]
        empty = F.array().cast("array<int>")
        left = F.when(at > 1, F.array(rank(F.get(p, at - 2), m))).otherwise(empty)
        right = F.when(at < F.size(r), F.array(rank(m, F.get(p, at + 1)))).otherwise(empty)
        return F.struct(
            F.concat(F.slice(p, F.lit(1), at - 1), F.array(m), F.slice(p, at + 2, F.size(p))).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state["r"])
        return F.when(least < NONE, _bind(F.array_position(state["r"], least).cast("int"), lambda at: merge(state, at, F.get(state["r"], at - 1)))).otherwise(state)

    def start(codes: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: F.get(find["two"], F.get(codes, i - 1) * 256 + F.get(codes, i)))
        state = F.struct(F.transform(codes, lambda c: F.get(find["one"], c)).alias("p"), pairs.alias("r"))
        return F.aggregate(F.sequence(F.lit(2), F.size(codes)), state, step)["p"]

    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    return F.when(F.length(word) < 2, F.transform(codes, lambda c: F.get(find["one"], c))).otherwise(_bind(codes, start))


def encode_long(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one match, by a heap of pairs: the least rank first, the leftmost of equal ranks; n log n steps for n bytes."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each byte; 0: joined to another
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := table.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has been joined to another since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := table.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := table.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [table[piece[i:e]] for i, e in enumerate(end) if e]


def known_words(docs: DataFrame, pattern: str, table: Column) -> pa.Table:
    """(w, ids): matches of up to KNOWN_BYTES bytes in about SAMPLE_BYTES of the texts, about KNOWN at most, the most frequent, folded.

    Only saves folding them in every slice; a match that isn't here is folded where it is found.
    """
    spark, total = docs.sparkSession, text_size(docs)[1]
    some = docs.sample(SAMPLE_BYTES / total, 7) if total > SAMPLE_BYTES else docs

    def run(batches):
        find = _finder(pattern)
        for batch in slices(batches, limit=SLICE_BYTES):
            found = Counter()
            for text in batch.column(1).to_pylist():
                found.update(find(text or ""))
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    counts = _columns(some).mapInArrow(run, "w string, n long").filter(F.octet_length("w") <= KNOWN_BYTES)
    counts = stored(counts.groupBy("w").agg(F.sum("n").alias("n")))
    level, left, take = F.floor(F.log2(F.col("n") + 0.5)), KNOWN, F.lit(False)
    for at, words in sorted(map(tuple, counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        share = max(0, min(1000, 1000 * left // words))  # of the last level that has room, by a hash
        take |= (level == at) & (F.pmod(F.xxhash64("w"), F.lit(1000)) < share)
        left -= words
    often = counts.filter(take).select("w").repartition(spark.sparkContext.defaultParallelism)
    word = F.decode(F.col("w").cast("binary"), "ISO-8859-1")
    found = often.select("w", _bind(table, lambda t: _fold(word, t)).alias("ids")).toArrow()
    discard(counts)
    return found.cast(pa.schema([("w", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()


def _finder(pattern: str):
    """findall of the pattern; for ASCII texts by the standard library, which is faster, if each class of the pattern is in ASCII."""
    import regex

    find, plain, inside = regex.compile(pattern).findall, "", False
    for x in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if x == r"\S" and not inside:
            plain += f"[^{ASCII[x.lower()]}]"
        elif x in ASCII:
            plain += ASCII[x] if inside else f"[{ASCII[x]}]"
        elif x[0] == "\\":
            return find
        else:
            plain, inside = plain + x, x == "[" or inside and x != "]"
    fast = re.compile(plain).findall
    return lambda text: (fast if text.isascii() else find)(text)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def distinct_words(docs: DataFrame, pattern: str, rank_file: str, known: Broadcast) -> DataFrame:
    """One row per slice of docs: its distinct matches, as places in known, else as strings of a character a byte, or as ids if long; and for each text the places of its matches in known, then words, then longer."""

    def run(batches):
        find, table, folded = _finder(pattern), None, _unpack(known)
        for batch in slices(batches, limit=SLICE_BYTES):
            seen = defaultdict(count().__next__)
            sizes, where = [], []
            for text in batch.column(1).to_pylist():
                found = find(text or "")
                where.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
            at = pc.fill_null(pc.index_in(pa.array(list(seen), pa.string()), value_set=folded), -1).to_numpy()
            words = [w.encode() for w in seen]
            kind = np.where(at >= 0, 0, np.where(np.fromiter(map(len, words), np.int64, len(words)) <= LONG, 1, 2))
            order = np.argsort(kind, kind="stable")
            place = np.zeros(len(words), np.int32)
            place[order] = np.arange(len(words))
            first, cut = np.searchsorted(kind[order], [1, 2]).tolist()
            if cut < len(words):
                table = table or ranks(rank_file)
            short, longer = [_chars(words[i]) for i in order[first:cut].tolist()], [encode_long(words[i], table) for i in order[cut:].tolist()]
            one = lambda x, t: pa.ListArray.from_arrays([0, len(x)], pa.array(x, t))
            yield pa.record_batch([one(batch.column(0), pa.int64()), one(sizes, pa.int32()), one(place[np.concatenate(where)], pa.int32()), one(at[order[:first]], pa.int32()), one(short, pa.string()), one(longer, pa.list_(pa.int32()))], names=["doc_ids", "sizes", "places", "known", "words", "longer"])

    return _columns(docs).mapInArrow(run, "doc_ids array<long>, sizes array<int>, places array<int>, known array<int>, words array<string>, longer array<array<int>>")


def _pack(spark: SparkSession, column: pa.ChunkedArray) -> Broadcast:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", column.type)])) as out:
        out.write_table(pa.table({"x": column}))
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _unpack(packed: Broadcast) -> pa.Array:
    column = pa.ipc.open_stream(packed.value).read_all().column("x")
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _joined(words: pa.Array, places: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """(bytes, ends of texts in them): words in the order of places, of which each text takes those up to its end."""
    found = words.take(pa.array(places))
    _, offsets, data = found.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, np.int64)[ends].tolist() if len(found) else [0] * len(ends)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded): every text encoded, and its ids decoded.

    ids and decoded (binary) are null unless keep is set. Null and empty texts have no tokens; repeated rows are
    encoded each; no rows, no rows; other columns are not read. A match of n bytes takes n folding steps of its length,
    or n log n where it is longer than LONG; matches that are frequent in a sample are encoded once, others once a slice.
    The sample is read at the call, the texts when the result is.
    """
    spark, table = docs.sparkSession, _literals(ranks(rank_file))
    known = known_words(docs, pattern, table)
    known_ids = _pack(spark, known["ids"])
    sliced = distinct_words(docs, pattern, rank_file, _pack(spark, known["w"]))
    # The literal stands in the plan once and is bound to a variable there.
    coded = sliced.withColumn("ids", _bind(table, lambda t: F.transform("words", lambda w: _fold(w, t)))).drop("words")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        kind, folded, at_rank = pa.list_(pa.int32()), _unpack(known_ids), {r: p for p, r in ranks(rank_file).items()}
        pieces = pa.array([at_rank.get(i) for i in range(max(at_rank) + 1)], pa.large_binary())
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda name: batch.column(name)[k].values  # noqa: E731, B023
                ids = pa.concat_arrays([folded.take(of("known")), of("ids").cast(kind), of("longer").cast(kind)])
                offsets = ids.offsets
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.values.cast(pa.large_string())), pa.scalar(",", pa.large_string()))
                texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(",", pa.large_string()))
                _, ends, data = pieces.take(ids.values).buffers()
                ends = np.frombuffer(ends, np.int64)[offsets.to_numpy()] if len(ids.values) else np.zeros(len(offsets), np.int64)
                words = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")])
                places, bounds = of("places").to_numpy(), np.concatenate([[0], np.cumsum(of("sizes").to_numpy(), dtype=np.int64)])
                total = np.concatenate([[0], np.cumsum(np.diff(offsets.to_numpy())[places], dtype=np.int64)])[bounds]
                hashed = lambda data, at, less=0: pa.array([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
                said = hashed(*_joined(texts, places, bounds), 1)
                back, back_at = _joined(words, places, bounds)
                n = len(bounds) - 1
                whole = pa.nulls(n, kind), pa.nulls(n, pa.binary())
                if keep:
                    whole = pa.ListArray.from_arrays(total.astype(np.int32), ids.take(pa.array(places)).flatten()), pa.array([bytes(back[a:b]) for a, b in zip(back_at[:-1], back_at[1:])], pa.binary())
                yield pa.record_batch([of("doc_ids"), pa.array(np.diff(total)), said, hashed(back, back_at), *whole], schema=schema)

    return coded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
