"""Language-model scoring with Elias-Fano n-gram tries.

The model interpolates orders by absolute discounting: P_k(w | c) = max(n(c, w) - D, 0) / n(c) + D * t(c) / n(c) *
P_(k-1)(w | shorter c), with n the training counts and t(c) the distinct successors; order one adds one to each count.

Documents are dealt out to batches by hash. A batch counts its own n-grams and sends each distinct one once, with its
training count, to the shard of its context; so a hot word or pair is one entry a batch. A shard compiles its n-grams
into a trie (contexts, monotone pointers and successors as Elias-Fano sequences, and quantised probabilities, all in
a memory-mapped file), answers the n-grams of every batch by search among the successors of their context, and sends
the quantised answers back. The batches then add up the scores of their documents. No task holds the model.
"""

from __future__ import annotations

import os
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, crc_remainder, mix, read, release, stored, text_size

BATCH_BYTES = 10 << 20
DISCOUNT = 0.75
#: Codes per decade of a probability; code 0 is "not seen", code c is 10 ** ((c - CODES) / PER_DECADE).
PER_DECADE, CODES = 512, 8191
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down so that they never sum to more than one."""
    with np.errstate(divide="ignore"):
        c = np.floor(np.log10(p) * PER_DECADE + 1e-9) + CODES
    return np.clip(c, 1, CODES).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** ((code.astype(np.float64) - CODES) / PER_DECADE))


class EliasFano:
    """A sequence of unsigned integers that never falls: low bits packed, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64)
        ones = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        ones[high + np.arange(n)] = 1
        bits = [np.packbits(((values[i : i + 8192, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)) for i in range(0, n, 8192)]
        return np.packbits(ones), np.concatenate(bits) if bits and low else np.zeros(0, np.uint8), low, n

    def __init__(self, high: np.ndarray, low_bits: np.ndarray, low: int, n: int):
        self.high, self.low_bits, self.low, self.n = high, low_bits, low, n
        # The number of ones before each 512th byte: decoding starts at the right place.
        per = np.add.reduceat(np.bitwise_count(high), np.arange(0, len(high), 512), dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(per)])

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b."""
        if b <= a:
            return np.zeros(0, np.uint64)
        block = int(np.searchsorted(self.before, a, "right")) - 1
        stop = int(np.searchsorted(self.before, b, "left")) * 512
        at = np.flatnonzero(np.unpackbits(self.high[block * 512 : stop]))[a - self.before[block] : b - self.before[block]] + block * 4096
        out = (at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.low_bits[a * self.low // 8 : -(-b * self.low // 8)])[a * self.low % 8 :][: (b - a) * self.low].reshape(-1, self.low)
            for j in range(self.low):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out


class Trie:
    """One level of contexts and their successors, in a memory-mapped file.

    contexts: sorted 64-bit keys; first[i] to first[i + 1] are the successors of context i, stored as
    i * 2 ** 32 + successor, which never falls over the level.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, folder: str):
        """Rows sorted by context and successor, counts above zero."""
        keys, first = np.unique(context, return_index=True)
        total, kinds = np.add.reduceat(count, first) if len(first) else np.zeros(0), np.diff(np.append(first, len(context)))
        own = np.repeat(np.arange(len(keys), dtype=np.uint64), kinds)
        parts = [EliasFano.encode(x) for x in (keys, np.append(first, len(context)).astype(np.uint64), (own << np.uint64(32)) | successor.astype(np.uint64))]
        codes = quantise((count - DISCOUNT) / np.repeat(total, kinds)), quantise(DISCOUNT * kinds / np.maximum(total, 1))
        fd, self.path = tempfile.mkstemp(dir=folder)
        at, places = 0, []
        with os.fdopen(fd, "wb") as f:
            for x in [y for p in parts for y in p[:2]] + [c.view(np.uint8) for c in codes]:
                f.write(x.tobytes())
                places.append((at, len(x)))
                at += len(x)
            f.write(b"\0")
        data = np.memmap(self.path, np.uint8, "r")
        cut = [data[a : a + n] for a, n in places]
        self.contexts, self.first, self.successors = (EliasFano(cut[2 * i], cut[2 * i + 1], p[2], p[3]) for i, p in enumerate(parts))
        self.codes, self.rest = cut[6].view(np.uint16), cut[7].view(np.uint16)
        self.bytes = at

    def close(self) -> None:
        os.unlink(self.path)

    def find(self, context: np.ndarray, size: np.ndarray, successor: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the n-grams, codes of the contexts' rest): contexts sorted, size successors each; 0 where not seen."""
        code, rest = np.zeros(len(successor), np.uint16), np.zeros(len(context), np.uint16)
        keys = self.contexts.range(0, self.contexts.n)
        if not len(keys):
            return code, rest
        at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        known = keys[at] == context
        rest[known] = self.rest[at[known]]
        here, inside = np.flatnonzero(known), np.flatnonzero(np.repeat(known, size))
        ends = np.concatenate([[0], np.cumsum(size[here])])
        for i in range(0, len(here), block):
            part = here[i : i + block]
            lo, hi = int(at[part[0]]), int(at[part[-1]])
            pointer = self.first.range(lo, hi + 2).astype(np.int64)
            values = self.successors.range(int(pointer[0]), int(pointer[-1]))
            which = inside[ends[i] : ends[i + len(part)]]
            wanted = (np.repeat(at[part].astype(np.uint64), size[part]) << np.uint64(32)) | successor[which].astype(np.uint64)
            # The search of a successor stays in its context's range, as values carry their context.
            j = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            ok = values[j] == wanted
            code[which[ok]] = self.codes[pointer[0] + j[ok]]
        return code, rest


class _Grams:
    """The n-grams of a batch. Row i of levels[k]: (contexts, successors a context, successors, n-gram of each token)."""

    def __init__(self, table: pa.Table, order: int):
        words = Words(table.column("text"), lower=True)
        self.n = words.counts() + 1
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        token = np.full(int(self.begin[-1]), END)
        inner = np.ones(len(token), dtype=bool)
        inner[self.begin[1:] - 1] = False
        token[inner] = words.hashes()
        self.words, self.word = np.unique(token, return_inverse=True)
        self.levels = []
        context = np.full(len(token), START)
        place = np.arange(len(token)) - np.repeat(self.begin[:-1], self.n)
        for k in range(1, order):
            before = np.roll(token, k)
            before[place < k] = START
            with np.errstate(over="ignore"):
                context = before if k == 1 else mix(context * np.uint64(0x9E3779B97F4A7C15) + before)
            keys, own = np.unique(context, return_inverse=True)
            both, gram = np.unique((own.astype(np.uint64) << np.uint64(32)) | (token >> np.uint64(32)), return_inverse=True)
            own = (both >> np.uint64(32)).astype(np.int64)
            self.levels.append((keys, np.bincount(own, minlength=len(keys)), both.astype(np.uint32), gram, own))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Training counts of the words, then of the n-grams of each level."""
        w = np.repeat(train, self.n).astype(float)
        return [np.bincount(i, w, minlength=m).astype(np.uint32) for i, m in [(self.word, len(self.words)), *((x[3], len(x[2])) for x in self.levels)]]


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where sorted keys pass from one shard to the next; a shard is the first bits of the key."""
    return np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def _send(grams: _Grams, train: np.ndarray, bits: int) -> list[bytes]:
    counts, out = grams.counts(train), [[] for _ in range(1 << bits)]
    for shard, (w, c) in enumerate(zip(np.split(grams.words, _cuts(grams.words, bits)), np.split(counts[0], _cuts(grams.words, bits)))):
        out[shard].append((w, c))
    for (keys, size, succ, _, _), c in zip(grams.levels, counts[1:]):
        cut = _cuts(keys, bits)
        inner = np.concatenate([[0], np.cumsum(size)])[cut]
        for shard, x in enumerate(zip(np.split(keys, cut), np.split(size.astype(np.uint32), cut), np.split(succ, inner), np.split(c, inner))):
            out[shard].append(x)
    return [pickle.dumps([tuple(small(a) for a in x) for x in parts], 5) for parts in out]


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    if a.dtype == np.uint32 and len(a):
        top = int(a.max())
        return a.astype(np.uint8) if top < 256 else a.astype(np.uint16) if top < 65536 else a
    return a


def _answer(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Compiles a shard and answers every batch."""
    batches, parts = table.column("batch").to_pylist(), [pickle.loads(x) for x in table.column("grams").to_pylist()]
    words = np.concatenate([p[0][0] for p in parts])
    count = np.concatenate([p[0][1] for p in parts]).astype(np.int64)
    keys, inv = np.unique(words, return_inverse=True)
    total = np.bincount(inv, count, minlength=len(keys)).astype(np.int64)
    answers = [[small(total[np.searchsorted(keys, p[0][0])].astype(np.uint32))] for p in parts]
    with tempfile.TemporaryDirectory() as folder:
        for level in range(1, len(parts[0])):
            # The n-grams of all batches together, each looked up once: work doesn't grow with batches times the trie.
            contexts, which = np.unique(np.concatenate([p[level][0] for p in parts]), return_inverse=True)
            own = np.repeat(which.astype(np.uint64), np.concatenate([p[level][1] for p in parts]))
            both = (own << np.uint64(32)) | np.concatenate([p[level][2] for p in parts]).astype(np.uint64)
            order = np.argsort(both, kind="stable")  # of runs that are sorted
            both = both[order]
            new = np.ones(len(both), dtype=bool)
            new[1:] = both[1:] != both[:-1]
            grams = both[new]
            n = np.concatenate([p[level][3] for p in parts]).astype(np.int64)[order]
            n = np.add.reduceat(n, np.flatnonzero(new)) if len(grams) else n
            gram = np.empty(len(order), np.int64)
            gram[order] = np.cumsum(new) - 1
            own, succ, seen = (grams >> np.uint64(32)).astype(np.int64), grams.astype(np.uint32), n > 0
            trie = Trie(contexts[own[seen]], succ[seen], n[seen], folder)
            code, rest = trie.find(contexts, np.bincount(own, minlength=len(contexts)), succ)
            trie.close()
            ends, starts = np.cumsum([len(p[level][2]) for p in parts])[:-1], np.cumsum([len(p[level][0]) for p in parts])[:-1]
            for a, g, c in zip(answers, np.split(gram, ends), np.split(which, starts)):
                a.append((code[g], rest[c]))
    rows = [pickle.dumps(a, 5) for a in answers]
    n = len(rows)
    return pa.table([batches, table.column("shard").to_pylist(), rows, [int(total.sum())] + [0] * (n - 1), [int((total > 0).sum())] + [0] * (n - 1)], schema)


def score(docs: DataFrame, train, order: int = 2) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    train is a boolean column of docs: what the model learns from (null: nothing). Tokens are words with A-Z lower-cased
    and an end after each text; a null or empty text is the end alone. score is the log10 probability of the text.
    Rows with equal texts have equal scores; without training rows every token is unknown and both scores are those of
    one unknown type; no rows, no rows. Words are told apart by 64-bit hashes, and by 32 bits after a given context.
    """
    spark = docs.sparkSession
    _, size = text_size(docs)
    n_batches = max(4, -(-size // BATCH_BYTES))
    bits = max(3, (2 * n_batches - 1).bit_length())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    keyed = keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int"))

    sent = pa.schema([("batch", pa.int32()), ("shard", pa.int32()), ("grams", pa.binary())])
    back = pa.schema([("batch", pa.int32()), ("shard", pa.int32()), ("answer", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def send(table: pa.Table) -> pa.Table:
        blobs = _send(_Grams(table, order), table.column("train").to_numpy().astype(bool), bits)
        return pa.table([[table.column("batch")[0].as_py()] * len(blobs), list(range(len(blobs))), blobs], sent)

    def answer(table: pa.Table) -> pa.Table:
        return _answer(table, back)

    shards = keyed.groupBy("batch").applyInArrow(send, "batch int, shard int, grams binary").groupBy("shard").applyInArrow(answer, "batch int, shard int, answer binary, tokens long, types long")
    shards = stored(shards)
    release(spark)
    n, v = (int(x or 0) for x in shards.agg(F.sum("tokens"), F.sum("types")).first())
    release(spark)  # again, as the first call may come before Spark has let go of the job just ended
    out = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def add(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        grams = _Grams(table, order)
        got = [pickle.loads(x) for x in answers.sort_by("shard").column("answer").to_pylist()]
        count = np.concatenate([g[0] for g in got]).astype(np.float64)[grams.word]
        base = (count + 1) / (n + v + 1)
        p = base
        for k, (_, _, _, gram, own) in enumerate(grams.levels, 1):
            seen = probability(np.concatenate([g[k][0] for g in got]))[gram]
            rest_code = np.concatenate([g[k][1] for g in got])[own][gram]
            p = np.where(rest_code == 0, p, seen + probability(rest_code) * p)
        sums = lambda x: np.add.reduceat(x, grams.begin[:-1])
        rows = len(grams.n)
        return pa.table([table.column("doc_id").cast(pa.int64()), table.column("train"), grams.n, sums((count > 0).astype(np.int64)), np.full(rows, n), sums(np.log10(base)), sums(np.log10(p))], schema=out)

    return keyed.groupBy("batch").cogroup(shards.select("batch", "shard", "answer").groupBy("batch")).applyInArrow(add, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"), crc_remainder("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
