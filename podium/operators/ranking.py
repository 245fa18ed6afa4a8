"""Windows over results: best rows, ranks, splits, and greedy pages. All orders end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.sources.shared import Steps


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")


def best_results(results: DataFrame, years: int | None = None, as_of: str | None = None, events: list[str] | None = None) -> DataFrame:
    """The best valid time of each swimmer, event and pool: least time, then latest date, then id; seasons that ended before the window are left out."""
    valid = results.where(~F.col("disqualified") & (F.col("hundredths") > 0))
    if events:
        valid = valid.where(F.col("event").isin(events))
    if years:
        valid = valid.where(F.make_date("season", F.lit(12), F.lit(31)) >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    return first_per(valid, ["swimmer_id", "event", "pool"], [F.col("hundredths"), F.col("meeting_date").desc(), F.col("mir_id")])


def ranks(results: DataFrame, program: list[str], untimed: str = "last") -> DataFrame:
    """results with a rank in their program; rows without a time come last, or are left out (`drop`)."""
    rows = results.where("hundredths > 0") if untimed == "drop" else results
    order = Window.partitionBy(*program).orderBy((F.col("hundredths") == 0), "hundredths", "mir_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def lap_deltas(laps: DataFrame, key: str = "mir_id", at: str = "length") -> DataFrame:
    """Each lap's own time: its cumulative time minus that of the lap before; the first is its own. Of laps at one place the smaller is the one before."""
    return laps.withColumn("delta", F.col("cumulative") - F.lag("cumulative", 1, 0).over(Window.partitionBy(key).orderBy(at, "cumulative")))


def running_totals(laps: DataFrame, key: str = "mir_id", at: str = "length") -> DataFrame:
    """The sum of delta up to a lap's place, with all laps that are there."""
    return laps.withColumn("from_start", F.sum("delta").over(Window.partitionBy(key).orderBy(at)))


def completed_halves(laps: DataFrame, key: str = "mir_id", at: str = "length") -> DataFrame:
    """Where exactly one of delta and cumulative is present (above 0), the other is derived; else both stay as they are."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.coalesce(F.lag("cumulative").over(Window.partitionBy(key).orderBy(at, "cumulative", "delta")), F.lit(0))
    summed = F.sum(F.coalesce("delta", F.lit(0))).over(order)  # laps at one place count together
    has_delta, has_total = F.coalesce(F.col("delta") > 0, F.lit(False)), F.coalesce(F.col("cumulative") > 0, F.lit(False))
    return laps.select(
        "*",
        F.when(has_total & ~has_delta, F.col("cumulative") - before).otherwise(F.col("delta")).alias("full_delta"),
        F.when(has_delta & ~has_total, summed).otherwise(F.col("cumulative")).alias("full_cumulative"),
    )


def carried(df: DataFrame, column: str, keys: list[str], order: str, name: str) -> DataFrame:
    """The last value that isn't null, up to this row: a header carried to the rows below it."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered(df: DataFrame, order: list[str], name: str, steps: Steps | None = None, start: int = 0) -> DataFrame:
    """df with the rows' numbers by order, from start + 1: inside each of its ranges, plus the rows of the ranges before it."""
    steps = steps or Steps(df.sparkSession, "numbered")
    ranges = steps.keep(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))  # a row a range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(name, nth).join(F.broadcast(starts), "__range").withColumn(name, F.col(name) + F.col("__start") + F.lit(start)).drop("__range", "__start")


def greedy_pages(df: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Pages filled in order: an item opens a new page when it doesn't fit into what is left. One array a key, folded once."""
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("page"), F.array().cast("array<struct<o:bigint,s:bigint,page:int>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["used"] > 0) & (acc["used"] + x["s"] > limit)
        page = acc["page"] + F.when(fresh, 1).otherwise(0)
        used = F.when(fresh, x["s"]).otherwise(acc["used"] + x["s"])
        return F.struct(used.cast("long").alias("used"), page.alias("page"), F.concat(acc["done"], F.array(F.struct(x["o"].cast("long").alias("o"), x["s"].alias("s"), page.alias("page")))).alias("done"))

    done = items.select(*keys, F.explode(F.aggregate("items", start, step, lambda a: a["done"])).alias("x"))
    return done.select(*keys, F.col("x.o").alias(order), F.col("x.s").alias(size), F.col("x.page").alias("page"))
