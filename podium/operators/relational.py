"""Joins and set operations of the checks: duplicates, twins, alignment, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def later_twins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of a key but the first. Rows with a null in the key have no twin, as in a self join."""
    whole = df.dropna(subset=keys)
    return whole.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth > 1").drop("__nth")


def signatures(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """The children of each parent as one text, in ascending order."""
    return children.groupBy(*parent).agg(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c.cast("string")), ",").alias("signature"))


def align(source: DataFrame, target: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both sides by key: source and target values (the last of each), and the side that has it."""
    a = source.groupBy(*key).agg(F.max(value).alias("source_id"))
    b = target.groupBy(*key).agg(F.max(value).alias("target_id"))
    side = F.when(F.col("target_id").isNull(), "source").when(F.col("source_id").isNull(), "target").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side)


def first_match_in_range(df: DataFrame, ranges: DataFrame, value: Column, how: str = "left") -> DataFrame:
    """The first range, by its begin and code, that holds the value. Ranges are a small table of bands, broadcast."""
    small = F.broadcast(ranges)
    joined = df.withColumn("__value", value).join(small, (F.col("__value") >= small.age_begin) & (F.col("__value") <= small.age_end), how)
    keys = df.columns
    return joined.groupBy(*keys).agg(F.min(F.struct("age_begin", "code")).alias("__band")).select(*keys, F.col("__band.code").alias("code"))


def fallback_lookup(df: DataFrame, exact: DataFrame, exact_key: list[str], loose: DataFrame, loose_key: list[str], value: str, name: str) -> DataFrame:
    """value by the exact key, or else the least one by the loose key."""
    a = exact.groupBy(*exact_key).agg(F.min(value).alias("__exact"))
    b = loose.groupBy(*loose_key).agg(F.min(value).alias("__loose"))
    return df.join(a, exact_key, "left").join(b, loose_key, "left").withColumn(name, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")
