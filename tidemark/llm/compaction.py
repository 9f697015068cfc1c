"""Size-tiered compaction of immutable shards under a versioned manifest.

A dataset is a folder of runs, each a folder of Parquet files that is never changed, and of manifests, one JSON file
per version, which list the live runs. Arrivals are appended as small runs. Runs of a similar size are a tier (by
powers of the fan-in over the smallest size); when a tier holds as many as the fan-in, they are merged into one run of
files near the target size. A version is committed by creating its manifest, which fails if another writer has
created it first; readers see the newest whole manifest, and a run that no manifest lists is not read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, shared_dir

FAN_IN, TARGET_BYTES, SMALLEST_BYTES = 4, 64 << 20, 256 << 10


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    files: int
    rows: int


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._new = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark = spark

    def names(self, child: str) -> list[str]:
        p = self._new(f"{self.path}/{child}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def usage(self, child: str) -> tuple[int, int]:
        """(bytes, data files)"""
        found = [s for s in self._fs.listStatus(self._new(f"{self.path}/{child}")) if s.getPath().getName().endswith(".parquet")]
        return sum(s.getLen() for s in found), len(found)

    def create(self, child: str, text: str) -> None:
        """Creates a file whole: written under another name, then renamed, which fails where the name is taken."""
        target, part = self._new(f"{self.path}/{child}"), self._new(f"{self.path}/{child}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(child)

    def text(self, child: str) -> str:
        return "\n".join(r[0] for r in self._spark.read.text(f"{self.path}/{child}", wholetext=True).collect())

    def delete(self, child: str) -> None:
        self._fs.delete(self._new(f"{self.path}/{child}"), True)


class Dataset:
    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, smallest_bytes: int = SMALLEST_BYTES):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path, self.fan_in, self.target, self.smallest = path.rstrip("/"), fan_in, target_bytes, smallest_bytes

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """(version, live runs), of the newest version if none is given; (0, []) before the first."""
        version = version or max(self.versions(), default=0)
        return version, [Run(**x) for x in json.loads(self.folder.text(f"manifests/{version:012d}.json"))["runs"]] if version else []

    def commit(self, based_on: int, runs: list[Run]) -> int:
        text = json.dumps({"version": based_on + 1, "runs": [r.__dict__ for r in sorted(runs, key=lambda r: r.name)]})
        self.folder.create(f"manifests/{based_on + 1:012d}.json", text)
        return based_on + 1

    def _written(self, name: str, rows: int) -> Run:
        return Run(name, *self.folder.usage(f"runs/{name}"), rows)

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Appends arrivals as one run, or as one run for each value of the column `by`, and commits one version.

        by is not stored. An empty arrival commits nothing and returns the present version. Nulls, ties, repeated rows and
        any further columns are kept as they are.
        """
        version, runs = self.manifest()
        if by is None:
            name = uuid.uuid4().hex
            arrivals.write.parquet(f"{self.path}/runs/{name}")
            made = [(name, self.spark.read.schema(arrivals.schema).parquet(f"{self.path}/runs/{name}").count())]
        else:
            # Cut by the value within each task, so that no value's rows meet in one.
            prefix = uuid.uuid4().hex
            arrivals.write.partitionBy(by).parquet(f"{self.path}/runs/{prefix}")
            at = self.spark.read.parquet(f"{self.path}/runs/{prefix}") if any("=" in n for n in self.folder.names(f"runs/{prefix}")) else None
            # By the name of their folder, which escapes the value; paths have that name encoded once more.
            name = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("+"), F.lit("%2B")))
            counts = {r[0]: r[1] for r in at.groupBy(name).count().collect()} if at is not None else {}
            made = [(f"{prefix}/{n}", counts[n]) for n in self.folder.names(f"runs/{prefix}") if "=" in n]
        new = [self._written(name, rows) for name, rows in made if rows]
        return self.commit(version, runs + new) if new else version

    def tier(self, run: Run) -> int:
        return max(0, int(math.log(max(run.bytes, 1) / self.smallest, self.fan_in)) + 1) if run.bytes > self.smallest else 0

    def compact(self) -> int:
        """Merges tiers that are full until none is; each merge is a job and a version. Returns the version."""
        while True:
            version, runs = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in sorted(runs, key=lambda r: (r.bytes, r.name)):
                if r.bytes < self.target * max(1, r.files / 2):  # others are made of files near the target size
                    tiers.setdefault(self.tier(r), []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if full is None:
                return version
            merged = tiers[full]
            name = uuid.uuid4().hex
            files = max(1, round(sum(r.bytes for r in merged) / self.target))
            n_rows = sum(r.rows for r in merged)
            # Whole input splits are put together in tasks, without a shuffle; a task with more than a file's rows writes several.
            out = self.read_runs(merged).coalesce(files).write.option("maxRecordsPerFile", -(-n_rows // files))
            out.parquet(f"{self.path}/runs/{name}")
            run = replace(self._written(name, 0), rows=n_rows)
            self.commit(version, [r for r in runs if r not in merged] + [run])

    def read_runs(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/runs/{r.name}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        _, runs = self.manifest(version)
        if not runs:
            raise ValueError(f"{self.path} has no rows")
        return self.read_runs(runs)

    def vacuum(self) -> list[str]:
        """Deletes runs that the newest version doesn't list; older versions can't be read after it."""
        _, runs = self.manifest()
        live, gone = {r.name for r in runs}, []
        for top in self.folder.names("runs"):
            parts = [f"{top}/{n}" for n in self.folder.names(f"runs/{top}") if "=" in n] or [top]
            for name in parts:
                if name not in live:
                    self.folder.delete(f"runs/{name}")
                    gone.append(name)
        return gone


def op3_size_tiered_compaction(spark: SparkSession, sf_dir: str, arrivals: int = 8) -> DataFrame:
    """documents in eight arrivals, compacted, and read back through the manifest; an empty table is read as it is."""
    docs = read(spark, sf_dir, "documents")
    data = Dataset(spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}")
    version = data.append(docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by="_arrival")
    if version:
        data.compact()
        data.vacuum()
        docs = data.read()
    return docs.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP3_SQL = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"
