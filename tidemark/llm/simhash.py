"""SimHash near-duplicates by tiled exact comparison.

Fingerprints fall into tiles by their population counts: of four 16-bit parts, so that the counts of two
fingerprints within the radius differ by at most the radius in all. Only pairs of tiles within that distance
meet, by an equi-join on the tile key; each pair is compared by exclusive-or and bit counts in numpy. A tile of
more than `tile_rows` fingerprints is split, so that no task holds an unbounded group. Equal fingerprints are
one row before that, so copies cost nothing, and each tile pair returns a spanning forest of its links only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, read, release, slices, stored
from tidemark.llm.graph import components
from tidemark.llm.similar import similar_documents

PARTS, PART_BITS = 4, 16


def _shingle_bits(words: Words, k: int, seed: int) -> np.ndarray:
    """Fingerprint of each text, as unsigned 64-bit values."""
    counts = words.counts()
    out = np.zeros(len(counts), np.uint64)
    if not len(words.starts):
        return out
    flat, starts, ends = words.spaced()
    flat = flat.tobytes()
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n_sh)])
    which = np.arange(begin[-1]) - np.repeat(begin[:-1], n_sh) + np.repeat(words.first[:-1], n_sh)
    last = np.minimum(which + k - 1, np.repeat(words.first[1:], n_sh) - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], seed) for s, e in zip(starts[which].tolist(), ends[last].tolist())), np.uint64, len(which))
    full = np.flatnonzero(n_sh)
    for lo in range(0, len(full), 256):
        part = full[lo : lo + 256]
        a, b = begin[part[0]], begin[part[-1] + 1]
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[part] - a, axis=0, dtype=np.int64)
        out[part] = np.packbits(ones * 2 > n_sh[part, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit SimHash of the lower-cased (A-Z) word shingles; no words, or null: zero."""

    def run(batches):
        for batch in slices(batches):
            fp = _shingle_bits(Words(batch.column(1), lower=True), shingle_words, seed)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least member for each group linked by a[i]-b[i]."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def links(fps: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """(u, v) links that span every group of distinct values fp within radius differing bits of each other."""

    def compare(batches):
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist()):
                a, b = (np.asarray(x.values).astype(np.int64, copy=False) for x in (a, b))
                x, y, found = a.view(np.uint64), b.view(np.uint64), []
                for lo in range(0, len(x), 256):
                    near = np.bitwise_count(x[lo : lo + 256, None] ^ y[None, :]) <= radius
                    i, j = np.nonzero(near)
                    found.append((i + lo, j))
                i, j = (np.concatenate(z) for z in zip(*found))
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    u, v = _forest(a[i], b[j])
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])

    key = sum((F.bit_count(F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND(F.lit((1 << PART_BITS) - 1))) + radius).cast("long") * (64**i) for i in range(PARTS))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    steps = sorted(x for d in steps if (x := sum(v * 64**i for i, v in enumerate(d))) >= 0)
    keyed = fps.select("fp").distinct().withColumn("tile", key)
    # At most 17 ** 4 tiles, so their counts have a bound whatever the input.
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("n"))
    tiles = keyed.join(F.broadcast(sizes), "tile").withColumn("sub", F.pmod(F.xxhash64("fp"), "n")).groupBy("tile", "sub").agg(F.collect_list("fp").alias("fps"))
    left = tiles.select(F.col("tile").alias("tile_a"), F.col("sub").alias("sub_a"), F.col("fps").alias("a"), F.explode(F.array(*(F.lit(x).cast("long") for x in steps))).alias("step")).withColumn("tile", F.col("tile_a") + F.col("step"))
    right = tiles.select("tile", "sub", F.col("fps").alias("b"))
    met = left.join(right, "tile").filter("step <> 0 or sub_a <= sub").select("a", "b", F.expr("step = 0 and sub_a = sub").alias("same"))
    return met.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the own one included.

    Repeated rows and equal texts share a fingerprint and so a component; null and empty texts have fingerprint
    zero and are linked like any other; a null doc_id takes part but is never the least; no rows, no rows. Other
    columns are not read.
    """
    fps = stored(fingerprints(docs, shingle_words))
    roots = components(links(fps, radius))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle_words: int = 5) -> DataFrame:
    """docs with one document of each group of similar ones, that of the least doc_id; a null doc_id is kept.

    Similar are texts of a shingle similarity of 0.8 or more. Groups are those of SimHash fingerprints within the radius,
    verified by the shingle sets. As no radius holds all similar texts and little else, a join of the sets finds the rest.
    """
    near = stored(near_duplicates(docs, radius, shingle_words).select("doc_id", "component_id"))
    release(docs.sparkSession)
    found = similar_documents(docs, shingle_words, near).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
