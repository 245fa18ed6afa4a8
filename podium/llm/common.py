"""What the operators share: reading tables, the shared scratch folder, word hashes and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: long texts must not add up to gigabytes in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of documents holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a session on one machine alone, one of our own where it is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context._jsc.sc().getCheckpointDir().getOrElse(None) if context._jsc.sc().getCheckpointDir().isDefined() else None
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="podium-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df is called so; Spark's names don't tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    return Tables(df.sparkSession, name).keep(df, name)


class Tables:
    """The tables between the steps of one job, in a folder of its own under the shared one; each can be deleted when it is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table: cuts the lineage, and survives lost executors."""
        path = f"{self.folder}/{len(self.kept)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.kept:
            if any(table is x for x in tables):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _ in self.kept if not any(t is x for x in tables)))


def words_of(text: str | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ as UTF-8, A-Z in lower case: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered for the frequent ones; the memory is bounded."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in words:
                if word not in known:
                    known[word] = digest(word)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of df, twice that at most: those whose hash of all columns is smallest. For fitting classifiers only.

    The same rows whatever the partitions are; each task passes on its own share, so what is gathered doesn't grow with the number of tasks.
    """
    share, hashed = min(1.0, 1.1 * rows / max(1, df.count())), unused(df, "hashed")
    threshold = int(-(2**63) + share * (2**64 - 1))
    own = df.withColumn(hashed, F.xxhash64(*df.columns)).where(F.col(hashed) <= F.lit(min(threshold, 2**63 - 1)))
    return own.orderBy(hashed, *df.columns).limit(2 * rows).select(*df.columns)


#: A table is broadcast up to so many rows of 8 to 40 bytes; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has few and shuffled if not."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Stands for a missing id where ids are stored as plain integers.
NO_ID = -(2**63)


def ids_in(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=np.asarray(ids) == NO_ID)
