"""What the operators share: reading tables, a shared scratch folder, and numpy views of Arrow text.

Text work in tasks sees a whole Arrow column as one byte buffer with offsets, so that words are found and
hashed by array operations and not by a loop over words.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns over at a time.
CHUNK_BYTES = 6 << 20
#: Bytes hashed at a time: eight of these in 64-bit words are held.
_BLOCK = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on one machine where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, *partition_by: str, deltas: bool = False, dictionaries: bool = True) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    deltas writes whole numbers as differences, which takes less room where they are sorted. Without dictionaries Parquet
    does not try them, which saves time for hashes.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd").option("parquet.writer.version", "v2" if deltas else "v1").option("parquet.enable.dictionary", str(dictionaries).lower())
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A stored df, marked for broadcasting if its strings and columns are few bytes; otherwise as it is, for Spark to shuffle."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.coalesce(F.sum(sum(texts, F.lit(24 * len(df.columns)))), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= most_bytes else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are stored."""
    gc.collect()
    spark.range(1).count()  # a next job, as Spark holds on to the one just ended
    spark.sparkContext._jvm.System.gc()


def text_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)"""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def crc_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Arrow batches cut into runs of rows with about limit bytes of text, a longer text alone."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts: start and end bytes, and the first word of each text."""

    def __init__(self, column, lower: bool = False):
        raw, off = utf8(column)
        self.buf = LOWER[raw] if lower else raw
        self.off = off
        space = SPACE[self.buf]
        word = ~space
        n = len(self.buf)
        begins = np.zeros(n + 1, dtype=bool)
        begins[off] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        before |= begins[:n]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        after |= begins[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, off)  # words of text i: first[i] to first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): the words with one space between those of a text, and none between texts."""
        keep = ~SPACE[self.buf]
        inner = np.ones(len(self.starts), dtype=bool)
        inner[self.first[:-1][self.counts() > 0]] = False
        gaps = self.starts[inner] - 1  # the byte before each word that isn't the first of its text
        keep[gaps] = True
        flat = self.buf.copy()
        flat[gaps] = 32
        place = np.cumsum(keep) - 1
        return flat[keep], place[self.starts], place[self.ends - 1] + 1

    def codes(self) -> pa.DictionaryArray:
        """The words themselves, dictionary-encoded."""
        flat = self.buf[~SPACE[self.buf]]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK)))
            lo = self.starts[i]
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            m = int(e[-1])
            size = max(_BLOCK, 1 << m.bit_length())
            up, down = power(_P, size), power(_P_INV, size)
            with np.errstate(over="ignore"):
                total = np.zeros(m + 1, np.uint64)
                np.cumsum((self.buf[lo : lo + m].astype(np.uint64) + np.uint64(1)) * up[:m], out=total[1:])
                out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out


def power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(n, base, np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got)
        if n <= _BLOCK:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_P) + h[j : j + n]
    return mix(out)
