"""Approximate nearest neighbours by an inverted multi-index.

Vector halves are quantised apart, each by its own centroids; a pair of centroids is a cell. A query walks the cells
in order of summed distance with a heap over the two sorted lists of centroids, until the cells it has passed hold
enough entries, and entries of these cells are ranked by the exact inner product. Distance of a half is the inner
product with its centroid, negated, as nearness is the inner product.

Centroids are fitted on a bounded sample; every row is indexed. Cells are cut into blocks of bounded size, blocks are
dealt out to shards by hash, and each shard returns at most k candidates a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, stored

#: Centroids of a half, and rows they are fitted on, at most.
CENTROIDS, SAMPLE_ROWS = 32, 20_000
#: Entries that a query's cells hold before it stops: this share of all, and no fewer than LEAST.
SHARE, LEAST = 0.6, 4000
#: Rows of a shard, about.
SHARD_ROWS = 8192


def vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with a vector that isn't null or zero and holds no null and no non-finite component."""
    v = F.col(column).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(ok)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of the rows of x; no more than there are distinct rows."""
    x = np.asarray(x, np.float64)
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(found: DataFrame, k: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, from the sample_rows rows of the least hashed ids; a vector of one component has an empty first half."""
    rows = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    x = np.array([r[0] for r in rows])
    half = x.shape[1] // 2
    return kmeans(x[:, :half], k), kmeans(x[:, half:], k)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) in order of d1[i] + d2[j] until they hold `enough` entries; empty cells are passed by."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, out, got = [(a[0] + b[0], 0, 0)], [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(b) + int(o2[j])
        if sizes[cell]:
            out.append(cell)
            got += int(sizes[cell])
        # Each pair is pushed once: along the second list always, along the first from its start only.
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def search(found: DataFrame, queries: DataFrame, top: int = 20, share: float = SHARE, least: int = LEAST, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the `top` rows of found nearest to it, itself left out.

    Both have (vec_id, v) as vectors() makes them. Ties go to the smaller vec_id; where fewer candidates than top
    exist, all of them come; an empty table gives no rows. Vectors all have one length.
    """
    spark = found.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    first = found.select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim, (c1, c2) = int(first[0]), fit(found, centroids)
    half = dim // 2

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            near = [((c**2).sum(1)[None] - 2 * y @ c.T).argmin(1) for y, c in ((x[:, :half], c1), (x[:, half:], c2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((near[0] * len(c2) + near[1]).astype(np.int32))], [*batch.schema.names, "cell"])

    index = stored(found.mapInArrow(assign, "vec_id long, v array<double>, cell int"))
    sizes = np.zeros(len(c1) * len(c2), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes[cell] = n
    total = int(sizes.sum())
    enough = min(total, max(least, top + 1, int(share * total)))
    shards = max(1, -(-total // SHARD_ROWS))
    blocks = np.maximum(1, -(-sizes // (SHARD_ROWS // 4)))  # blocks of each cell

    def shard_of(cell: int, block: int) -> int:
        return (cell * 2654435761 + block * 40503) % 2**32 % shards

    def visit(batches):
        for batch in batches:
            x, rows = _matrix(batch.column("v"), dim), []
            s1, s2 = -(x[:, :half] @ c1.T), -(x[:, half:] @ c2.T)
            for i, q in enumerate(batch.column("vec_id").to_pylist()):
                cells: dict[int, list[int]] = {}
                for cell in traverse(s1[i], s2[i], sizes, enough):
                    for s in {shard_of(cell, b) for b in range(int(blocks[cell]))}:
                        cells.setdefault(s, []).append(cell)
                rows += [(s, q, x[i], c) for s, c in cells.items()]
            yield pa.record_batch([pa.array(z, t) for z, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())))], names=["shard", "query_id", "q", "cells"])

    block = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(blocks.tolist()), F.col("cell") + 1).cast("long"))
    postings = index.withColumn("shard", F.pmod(F.pmod(F.col("cell").cast("long") * 2654435761 + block * 40503, F.lit(2**32)), F.lit(shards)).cast("int"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(entries: pa.Table, asked: pa.Table) -> pa.Table:
        if not entries.num_rows or not asked.num_rows:
            return out.empty_table()
        ids, cell, x = entries.column("vec_id").to_numpy(), entries.column("cell").to_numpy(), _matrix(entries.column("v"), dim)
        order = np.argsort(cell, kind="stable")
        ids, cell, x = ids[order], cell[order], x[order]
        present, begin = np.unique(cell, return_index=True)
        span = dict(zip(present.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(cell)])))
        tables = []
        for q, v, cells in zip(asked.column("query_id").to_pylist(), _matrix(asked.column("q"), dim), asked.column("cells").to_pylist()):
            at = np.concatenate([np.arange(*span[c]) for c in cells if c in span] or [np.zeros(0, np.int64)])
            at = at[ids[at] != q]
            score = x[at] @ v
            if len(at) > top:
                limit = np.partition(score, len(at) - top)[len(at) - top]
                at, score = at[score >= limit], score[score >= limit]
            best = np.lexsort((ids[at], -score))[:top]
            tables.append((np.full(len(best), q), ids[at[best]], score[best]))
        return pa.table([np.concatenate(z) for z in zip(*tables)], schema=out)

    near = postings.select("shard", "vec_id", "v", "cell").groupBy("shard").cogroup(queries.mapInArrow(visit, "shard int, query_id long, q array<double>, cells array<int>").groupBy("shard")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors(read(spark, sf_dir, "embeddings"))
    return search(found, found.filter("vec_id % 20 = 0"))
