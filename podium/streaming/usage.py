"""Streams: daily usage counters, latest states, queues merged batch by batch, and drop folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def events_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 8) -> DataFrame:
    """The events files of a folder as a stream; their schema is that of what is there now."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant; the session's zone is the tables'


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events a day and route; days close when the watermark passes them."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("route")).agg(F.count("*").alias("count"))
    return counted.select(F.to_date("w.start").alias("day"), "route", "count")


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each user."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")


def run_now(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete", key: list[str] | None = None) -> DataFrame:
    """Runs the stream over all that is there, and returns the table it leaves.

    Complete results replace the table; of updates each batch writes what it has changed, and the newest row of a key counts. Each batch is written to
    a path of its own, so that a batch that is run again after a failure replaces only itself.
    """
    spark = stream.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start().awaitTermination()
    last = last_batch(spark, table)
    if last is None:
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return spark.read.parquet(f"{table}/batch={last}")
    newest = spark.read.parquet(table).groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")


def last_batch(spark: SparkSession, table: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=None)


def drop_folder(spark: SparkSession, folder: str, done: str, schema: str) -> DataFrame:
    """JSON files of a folder; a file that has been processed is moved to done."""
    return spark.readStream.schema(schema).option("cleanSource", "archive").option("sourceArchiveDir", done).json(folder)


class Progress(StreamingQueryListener):
    """Messages of a stream's progress: (message, rows so far)."""

    def __init__(self) -> None:
        self.messages: list[tuple[str, int]] = []

    def onQueryStarted(self, event: object) -> None:
        self.messages.append(("started", 0))

    def onQueryProgress(self, event: object) -> None:
        self.messages.append(("progress", event.progress.numInputRows))

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.messages.append(("ended", 0))
