"""Tables between the steps of a job, in the folder that driver and executors share; and versions of many tables that change at once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: To so many partitions a task writes its rows straight to files; to more, it holds them all until it ends (Spark's spark.shuffle.sort.bypassMergeThreshold).
STRAIGHT = 200


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine alone gets a folder of its own where that is unset, any other one an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="podium-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Steps:
    """The tables of one job; each can be deleted when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df as a written table: cuts the lineage, and survives lost executors. Rows are in a folder for each value of `by`, so that readers of one value open no other file."""
        path = f"{self.folder}/{len(self.kept)}-{name}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.kept:
            if any(table is x for x in tables):
                at, fs = file_system(self.spark, path)
                fs.delete(at, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _ in self.kept if not any(t is x for x in tables)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of its own."""
    return Steps(df.sparkSession, name).keep(df, name)


class Conflict(RuntimeError):
    """Another writer has published the version."""


class Versions:
    """Versions of a set of tables under one folder. A version is a manifest that names a folder for each table; it is written aside and renamed
    into its place, once, so readers see all tables of a version or none. Atomic where renames are; on a store without them a
    lock or a catalog has to take the manifest's place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The newest version; 0 before the first."""
        at, fs = file_system(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest-{version:08d}.json").collect()))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.manifest(version)[table]}")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """A version with these tables anew and all others as in the base version. If another writer was faster, nothing is published and this raises Conflict."""
        base = self.version() if base is None else base
        named = dict(self.manifest(base))
        for name, df in tables.items():
            named[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{named[name]}")
        aside, fs = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(json.dumps(named).encode())
        out.close()
        at, _ = file_system(self.spark, f"{self.folder}/manifest-{base + 1:08d}.json")
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            raise Conflict(f"version {base + 1} is there already")
        return base + 1
