"""Vector best-fit packing.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces of equal
length are alike, so the packing is planned on the histogram of lengths, which has at most `tokens` rows whatever
the input: bins of equal content are one class with a count, and the longest pieces are placed first, each into
the class that fits best: by the weighted dot product of what the piece needs and what the bin has left, or by the
norm of what would be left. Pieces get their places by a rank within their length, made of salted counts, so that no
length is ranked in one task. As one piece may fill a sequence, no cost below tokens squared is possible where texts
are cut at `tokens` only; documents and cost bind where a caller sets them lower for shorter pieces.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACE, read, slices, stored, utf8

#: Pieces of one length that are ranked in one task, about.
SALT_ROWS = 500
#: Text whose distinct words are encoded together, and text turned over at a time.
SLICE_BYTES, PART_BYTES = 16 << 20, 1 << 20
_STOP, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _items(column) -> tuple[pa.Array, np.ndarray]:
    """(words, first word of each text): cut at blanks, which the tokenizer drops, and where a letter or digit meets a stop, where it cuts too."""
    raw, off = utf8(column)
    # Case is the tokenizer's to drop, but a special token's string stands for it in one spelling only.
    buf = raw if b"<|" in raw.tobytes() else LOWER[raw]
    keep, begins = ~SPACE[buf], np.zeros(len(buf) + 1, dtype=bool)
    begins[off] = True
    before = np.append(np.uint8(32), buf[:-1])[: len(buf)]
    start = keep & (SPACE[before] | begins[:-1] | (_STOP[buf] & _ALNUM[before]) | (_ALNUM[buf] & _STOP[before]))
    flat, place = buf[keep], np.cumsum(keep) - 1
    starts = np.flatnonzero(start)
    items = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(place[starts], len(flat))), pa.py_buffer(flat)])
    return items.dictionary_encode(), np.searchsorted(starts, off)


def token_ids(batch, tokenizer, end: int):
    """(ids of all texts, each with `end` after it; where each text begins; doc ids) of runs of rows. Each distinct word of the batch is encoded once."""
    parts = list(slices([batch], limit=PART_BYTES))
    items, firsts = zip(*(_items(p.column(1)) for p in parts))
    items = pa.chunked_array(items).unify_dictionaries().chunks
    known, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    distinct = items[0].dictionary
    for lo in range(0, len(distinct), 4000):
        ids = [e.ids for e in tokenizer.encode_batch_fast(distinct.slice(lo, 4000).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        known.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes[-1].sum())))
    known, sizes = np.concatenate(known), np.concatenate(sizes)
    begin = np.cumsum(sizes) - sizes
    for part, words, first in zip(parts, items, firsts):
        which = words.indices.to_numpy()
        n = sizes[which]
        stop = np.concatenate([[0], np.cumsum(n)])
        texts = stop[first] + np.arange(len(first))
        out = np.full(int(texts[-1]), end, "<u4")
        inner = np.ones(len(out), dtype=bool)
        inner[texts[1:] - 1] = False
        out[inner] = known[np.repeat(begin[which] - stop[:-1], n) + np.arange(stop[-1])]
        yield out, texts, part.column(0)


@functools.lru_cache(maxsize=1)
def load(path: str):
    """The tokenizer of a file, once in a worker; on one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text with `end` appended, cut only where longer than tokens."""

    def run(batches):
        encoder = load(tokenizer)
        for batch in slices(batches, limit=SLICE_BYTES):
            pa.default_memory_pool().release_unused()
            for ids, texts, doc_ids in token_ids(batch, encoder, end):
                size = np.diff(texts)
                count = -(-size // tokens)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * tokens
                length = np.minimum(tokens, size[row] - start)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip((texts[row] + start).tolist(), length.tolist())]
                yield pa.record_batch([doc_ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], tokens: int, max_docs: int, max_cost: int, rule: str = "dot", weights=(1.0, 0.05, 0.1)) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): where the pieces of each length go.

    Open classes of bins are rows of (tokens, documents, cost) left, with the number of bins and the first one's number;
    a class is split when only part of it takes a piece.
    """
    cap = np.array([tokens, max_docs, max_cost], float)
    w = np.array(weights, float)
    left = np.zeros((0, 3))
    bins: list[tuple[int, int, int]] = []  # of each open class: first bin, number of bins, tokens used
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        count, rank = histogram[length], 0
        while count:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                rest = (left[fits] - need) / cap
                # Largest alignment with the room that is left, measured against its size, or the smallest rest.
                value = -(left[fits] / cap * (need / cap) * w).sum(axis=1) / ((left[fits] / cap) ** 2 * w).sum(axis=1) if rule == "dot" else (rest**2 * w).sum(axis=1)
                k = int(fits[np.lexsort((fits, value))[0]])
                first, n, used = bins[k]
            else:
                # New bins, each filled with as many equal pieces as it can take, one piece at a time.
                n_each = int(min(tokens // length, max_docs, max_cost // (length * length)))
                n = -(-count // n_each)
                first, used, k = opened, 0, len(bins)
                opened += n
                left = np.vstack([left, cap])
                bins.append((first, n, 0))
            take = min(n, count)
            out.append((length, rank, take, first, used))
            rank, count = rank + take, count - take
            after = left[k] - need
            if take < n:
                bins[k] = (first + take, n - take, used)
                left = np.vstack([left, after])
                bins.append((first, take, used + length))
            else:
                bins[k] = (first, n, used + length)
                left[k] = after
            shut = (left[:, 0] < 1) | (left[:, 1] < 1) | (left[:, 2] < 1)
            if shut.any():
                keep = np.flatnonzero(~shut)
                left, bins = left[keep], [bins[i] for i in keep]
    return out


def pack(found: DataFrame, tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot") -> DataFrame:
    """found (with length) with sequence_id and offset added; offsets in a sequence have no gaps.

    No sequence has more than tokens tokens, max_docs pieces or a cost above max_cost (by default neither binds).
    Ties are broken by doc_id and piece; no rows, no rows.
    """
    found = stored(found)
    max_docs, max_cost = max_docs or tokens, max_cost or tokens * tokens
    histogram = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}  # at most `tokens` rows
    if not histogram:
        return found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    salts = [1] * (tokens + 1)
    for length, n in histogram.items():
        salts[length] = -(-n // SALT_ROWS)
    spark = found.sparkSession
    of_length = F.element_at(F.from_json(F.lit(json.dumps(salts)), "array<bigint>"), F.col("length").cast("int") + 1)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), of_length))
    # A row for every SALT_ROWS pieces and length.
    base = salted.groupBy("length", "salt").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    placed = plan(histogram, tokens, max_docs, max_cost, rule)
    rows = spark.createDataFrame(placed, "length long, lo long, n long, first long, offset long")
    # A plan has a row for each length and class it meets: its size doesn't depend on the number of pieces.
    steps = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "first", "offset"))).alias("steps"))
    step = F.element_at(F.filter("steps", lambda s: (F.col("rank") >= s["lo"]) & (F.col("rank") < s["lo"] + s["n"])), 1)
    out = ranked.join(F.broadcast(steps), "length").withColumn("step", step)
    return out.select(*found.columns, (F.col("step.first") + F.col("rank") - F.col("step.lo")).alias("sequence_id"), F.col("step.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = 2048, **limits) -> DataFrame:
    """One row per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each, of a null doc_id as well; a long text has as
    many pieces as it needs; other columns are not read. Strings of special tokens have the ids that the tokenizer gives.
    """
    return pack(pieces(docs, tokenizer, tokens), tokens, **limits)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_tokenizer())
