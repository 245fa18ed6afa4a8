r"""Size-tiered compaction of immutable shards, in DataFrame functions and the session's file system.

Each arrival is written as a small run of Parquet files that never change. Runs are of a tier, the whole
logarithm of their bytes to the base of the fan-in; whenever a tier has `fan_in` runs, these are read
together and written as one run of files of about the target size, which lands in a higher tier. So a row is
written again once a tier, not once an arrival. A manifest lists the runs of a version; the next version is
written aside and renamed into place, which fails if another writer was first. Readers of a version see its
runs alone. The newest `keep` versions (two if not said otherwise) can be read; compact() deletes older ones after each merge, with
the runs that only they name. A reader of the newest version may go on through keep - 1 further commits.

A job that loses executors runs its lost tasks again; one that fails altogether leaves files that no
manifest names. Null and empty texts, repeated rows and further columns are stored as they are. An empty
arrival adds no run, and a store of no run reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import unused


@dataclass(frozen=True)
class Run:
    run_id: int
    path: str
    rows: int
    bytes: int
    files: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: object, fan_in: int = 4, target_bytes: int = 64 << 20, base_bytes: int = 1 << 20, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep
        self.fan_in, self.target_bytes, self.base_bytes = fan_in, target_bytes, base_bytes
        self.java = spark._jvm
        self.fs = self.java.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str) -> object:
        return self.java.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _size(self, path: str) -> tuple[int, int]:
        """Bytes and number of a run's Parquet files."""
        sizes = [s.getLen() for s in self.fs.listStatus(self.java.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().endswith(".parquet")]
        return sum(sizes), len(sizes)

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base_bytes, self.fan_in)))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v")), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self.fs.open(self._manifest(version))
        try:
            text = self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> None:
        """Makes runs the version after `version`, or raises Conflict."""
        aside = self._path("manifests", f".{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version + 1, "runs": [asdict(r) for r in runs]}, indent=1).encode()))
        out.close()
        files = self.java.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.java.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, self._path("manifests", f"v{version + 1:010d}.json"), none)
        except Exception as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version + 1} is there") from error
            raise

    def append(self, arrivals: DataFrame, arrival: str) -> int:
        """Writes each value of the arrival column as a run of small shards, all in one job, and commits them together.

        Values may be of any type, and null is one too: folders are named by a hash. Rows of one arrival come together first, and large
        arrivals are split, so files are as many as their bytes ask for and not one for each task and arrival.
        """
        version, runs = self.version(), self.runs()
        folder, own = f"{self.path}/data/{uuid.uuid4().hex}", unused(arrivals, "arrival")
        named = F.concat(F.lit("a"), F.hex(F.xxhash64(F.col(arrival).isNull(), F.col(arrival).cast("string"))))  # never read back as a number or a date
        rows = arrivals.withColumn(own, named).select(*(f.name for f in self.schema.fields), own)
        self.write(rows.hint("rebalance", own), folder, own)
        landed = any(s.isDirectory() and "=" in s.getPath().getName() for s in self.fs.listStatus(self.java.org.apache.hadoop.fs.Path(folder)))
        counts = {r[0]: r[1] for r in self.spark.read.parquet(folder).groupBy(own).count().collect()} if landed else {}
        next_id = 1 + max((r.run_id for r in runs), default=0)
        for k, value in enumerate(sorted(counts)):
            at = f"{folder}/{own}={value}"
            runs.append(Run(next_id + k, at, counts[value], *self._size(at)))
        self.commit(version, runs)
        return version + 1

    def write(self, rows: DataFrame, folder: str, *by: str) -> None:
        rows.write.partitionBy(*by).option("compression", "zstd").parquet(folder)

    def due(self, runs: list[Run]) -> list[Run]:
        """The smallest runs of the lowest tier that is full."""
        by_tier: dict[int, list[Run]] = {}
        for run in runs:
            by_tier.setdefault(self.tier(run), []).append(run)
        for _, own in sorted(by_tier.items()):
            if len(own) >= self.fan_in:
                return sorted(own, key=lambda r: (r.bytes, r.run_id))[: self.fan_in]
        return []

    def compact(self) -> int:
        """Merges until no tier is full; every merge is a version of its own. Returns the number of merges."""
        merges = 0
        while True:
            version = self.version()
            runs = self.runs(version)
            old = self.due(runs)
            if not old:
                return merges
            size = sum(r.bytes for r in old)
            at = f"{self.path}/data/{uuid.uuid4().hex}"
            # read partitions are joined, not shuffled: rows move once, from old files to new ones
            self.write(self.spark.read.schema(self.schema).parquet(*(r.path for r in old)).coalesce(max(1, math.ceil(size / self.target_bytes))), at)
            gone = {r.run_id for r in old}
            merged = Run(1 + max(r.run_id for r in runs), at, sum(r.rows for r in old), *self._size(at))
            self.commit(version, [r for r in runs if r.run_id not in gone] + [merged])
            self.vacuum()
            merges += 1

    def vacuum(self) -> None:
        """Deletes the versions before the newest `keep` ones, and the files of runs that only those name."""
        newest = self.version()
        first = max(1, newest - self.keep + 1)
        named = {r.path for v in range(first, newest + 1) for r in self.runs(v)}
        for version in range(first - 1, 0, -1):
            if not self.fs.exists(self._manifest(version)):
                break
            for path in {r.path for r in self.runs(version)} - named:
                self.fs.delete(self.java.org.apache.hadoop.fs.Path(path), True)
            self.fs.delete(self._manifest(version), False)

    def _manifest(self, version: int) -> object:
        return self._path("manifests", f"v{version:010d}.json")

    def read(self, version: int | None = None, added: tuple[str, str, str] = ("__run", "__tier", "__files")) -> DataFrame:
        """The rows of a version, with the run that holds them, its tier and its number of files, under the names of `added`."""

        def of(df: DataFrame, *values: int) -> DataFrame:
            return df.withColumns({name: F.lit(x).cast(kind) for name, x, kind in zip(added, values, ("long", "int", "int"), strict=True)})

        taken = {f.name.lower() for f in self.schema.fields} & {x.lower() for x in added}
        if taken:
            raise ValueError(f"the table has columns of these names, give others: {sorted(taken)}")
        parts = [of(self.spark.read.schema(self.schema).parquet(r.path), r.run_id, self.tier(r), r.files) for r in self.runs(version)]
        return reduce(DataFrame.unionByName, parts) if parts else of(self.spark.createDataFrame([], self.schema), 0, 0, 0)
