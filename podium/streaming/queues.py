"""A queue with retries as keyed state: runs of a queue's jobs, counted across batches, with timers for jobs that nobody takes up again.

Each event is a run of the job that its queue has open. A job ends in one of three ways: with a run that succeeds; with the MOST_RUNS-th run that doesn't; or when nothing has
come for IDLE, which a timer in event time tells. The next event opens a new job. What a job is doesn't depend on how events are cut into batches: a
run that comes later than IDLE after the one before it ends that job first, whether the timer has fired or not.

State is a row for each queue with an open job, and goes when the job ends; ended jobs are appended, each once. A batch is written to a path of its own, so a
batch that runs again after a failure replaces only itself, and state and timers come back from the checkpoint.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Runs that a job gets, and how long it waits for the next one.
MOST_RUNS, IDLE = 5, datetime.timedelta(hours=6)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Times are microseconds since 1970, so they are whole numbers in state.
JOB = "queue long, started long, last_run long, process_runs int, failures int, done boolean, ended string"


class Runs(StatefulProcessor):
    """The open job of a queue: started, last_run, process_runs, failures."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, last_run long, process_runs int, failures int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        idle = int(IDLE.total_seconds() * 1_000_000)
        job = self.job.get() if self.job.exists() else None
        ended: list[tuple] = []
        for at, _, failed, succeeded in sorted(r for part in rows for r in zip(part["at"], part["event_id"], part["failed"], part["succeeded"], strict=True)):
            if job and at - job[1] > idle:
                ended.append((key[0], *job, False, "idle"))
                job = None
            started, _, runs, failures = job or (at, at, 0, 0)
            job = (int(started), int(at), int(runs) + 1, int(failures) + int(failed))
            if succeeded or job[2] >= MOST_RUNS:
                ended.append((key[0], *job, bool(succeeded), "done" if succeeded else "given up"))
                job = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job:
            self.job.update(job)
            self.handle.registerTimer((job[1] + idle) // 1000 + 1)
        elif self.job.exists():
            self.job.clear()
        yield pd.DataFrame(ended, columns=["queue", "started", "last_run", "process_runs", "failures", "done", "ended"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else None
        self.job.clear()
        yield pd.DataFrame([(key[0], *job, False, "idle")] if job else [], columns=["queue", "started", "last_run", "process_runs", "failures", "done", "ended"])

    def close(self) -> None:
        pass


def runs(events: DataFrame, queue: str, succeeded: str, failed: str, late: str = "1 hour") -> DataFrame:
    """The ended jobs of a stream of events (event_id, ts, ..); succeeded and failed say in SQL what a run is."""
    rows = events.withWatermark("ts", late).select(F.col(queue).alias("queue"), "ts", F.unix_micros("ts").alias("at"), "event_id", F.expr(succeeded).alias("succeeded"), F.expr(failed).alias("failed"))
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=Runs(), outputStructType=JOB, outputMode="append", timeMode="eventTime")


def append_now(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs the stream over all that is there, and returns the table that its batches have appended to."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state with timers needs it

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    try:
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return landed(spark, table, stream)


def landed(spark: SparkSession, table: str, stream: DataFrame) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(table)
