"""Merges of swimmers: chains of pairs resolved to their roots, conflicts told before anything is written, and all tables re-keyed in one plan.

`closure` follows pairs (source, target) to the end by pointer jumping: each round a target becomes its target's target, so a chain of k pairs takes
about log2 k rounds, each one join. Circles, and sources with two targets, are errors.

Of the badges that become one (same season, root and team) the root's own survives, else the least; results and relay legs move to the survivor and to the root.
Results that meet in one program with the same time are one: the least stays, the others go with their laps. With different times they are a conflict,
and nothing of that root is merged unless it is forced. A relay that would have the root twice keeps the leg of the smallest id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.sources.shared import Steps


class Circle(ValueError):
    """Pairs that lead back to themselves."""


def closure(pairs: DataFrame, steps: Steps) -> DataFrame:
    """(source, root) of pairs (source, target). A pair of an id with itself is none; repeated pairs are one."""
    at = steps.keep(pairs.where("source is not null and target is not null and source <> target").select("source", "target").distinct(), "pairs")
    twice = at.groupBy("source").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"more than one target: {sorted(r.source for r in twice)}")
    rounds = at.count().bit_length() + 1
    for _ in range(rounds):
        further = at.select(F.col("source").alias("target"), F.col("target").alias("next"))
        jumped = at.join(further, "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved"))
        after = steps.keep(jumped, "jumped")
        steps.drop(at)
        at = after.select("source", "target")
        if after.where("moved").isEmpty():
            return after.select("source", F.col("target").alias("root"))
    raise Circle(f"pairs in a circle, one of them {at.where('source = target').select('source').first() or at.first()}")


def rekeyed(table: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """table with new_<column>: the root where column is a source, else column itself."""
    of = roots.select(F.col("source").alias(column), F.col("root").alias("__root"))
    return table.join(of, column, "left").withColumn(f"new_{column}", F.coalesce("__root", column)).drop("__root")


@dataclass
class Merge:
    roots: DataFrame  # source, root
    conflicts: DataFrame  # root, program..., times
    badges: DataFrame  # id, new_swimmer_id, survivor
    changes: DataFrame  # step, table, operation, id, swimmer_id, badge_id


def change(step: int, table: str, operation: Column, key: str, swimmer: Column | None = None, badge: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("long")
    return [F.lit(step).alias("step"), F.lit(table).alias("table"), operation.alias("operation"), F.col(key).alias("id"), (none if swimmer is None else swimmer).alias("swimmer_id"), (none if badge is None else badge).alias("badge_id")]


def merge_swimmers(pairs: DataFrame, badges: DataFrame, results: DataFrame, laps: DataFrame, legs: DataFrame, program: list[str], steps: Steps, force: bool = False) -> Merge:
    """The changes that make each source of pairs its root, in tables that have id and swimmer_id; badges also season and team_id, results badge_id, team_id, the columns of program and
    hundredths, laps result_id and swimmer_id, legs relay_id and badge_id."""
    roots = closure(pairs, steps)
    involved = roots.select(F.col("root").alias("new_swimmer_id")).distinct()
    of_roots = lambda table: rekeyed(table, "swimmer_id", roots).join(involved, "new_swimmer_id", "left_semi")
    moved = steps.keep(of_roots(results), "results-of-roots")
    times = moved.groupBy("new_swimmer_id", *program).agg(F.count_distinct("swimmer_id").alias("swimmers"), F.count_distinct("hundredths").alias("times"))
    conflicts = steps.keep(times.where("swimmers > 1 and times > 1").select(F.col("new_swimmer_id").alias("root"), *program, "times"), "conflicts")
    if not force:
        refused = conflicts.select("root").distinct()
        roots = steps.keep(roots.join(refused, "root", "left_anti"), "roots")
        involved = roots.select(F.col("root").alias("new_swimmer_id")).distinct()
        moved = moved.join(involved, "new_swimmer_id", "left_semi")
    # badges of one season, root and team become one
    own = F.col("swimmer_id") == F.col("new_swimmer_id")
    survivor = F.min_by("id", F.struct(~own, "id")).alias("survivor")
    found = of_roots(badges)
    held = steps.keep(found.join(found.groupBy("season", "new_swimmer_id", "team_id").agg(survivor), ["season", "new_swimmer_id", "team_id"]), "badges")
    lost = F.col("id") != F.col("survivor")
    badge_changes = held.where(lost | ~own).select(*change(5, "badges", F.when(lost, "DELETE").otherwise("UPDATE"), "id", F.when(~lost, F.col("new_swimmer_id"))))
    to = held.select(F.col("id").alias("badge_id"), "survivor")
    # results that meet in one program with one time
    first = F.min("id").over(Window.partitionBy("new_swimmer_id", *program, "team_id", "hundredths"))
    several = F.size(F.collect_set("swimmer_id").over(Window.partitionBy("new_swimmer_id", *program, "team_id", "hundredths"))) > 1
    judged = steps.keep(moved.withColumn("twin", several & (F.col("id") != first)).join(to, "badge_id", "left"), "judged-results")
    left = judged.where(~F.col("twin") & (~own | (F.col("badge_id") != F.col("survivor"))))
    result_changes = judged.where("twin").select(*change(3, "results", F.lit("DELETE"), "id")).unionByName(left.select(*change(3, "results", F.lit("UPDATE"), "id", F.col("new_swimmer_id"), F.col("survivor"))))
    of_twins = laps.join(judged.where("twin").select(F.col("id").alias("result_id")), "result_id", "left_semi").select(*change(1, "laps", F.lit("DELETE"), "id"))
    of_moved = laps.join(judged.where(~F.col("twin") & ~own).select(F.col("id").alias("result_id"), "new_swimmer_id"), "result_id").select(*change(2, "laps", F.lit("UPDATE"), "id", F.col("new_swimmer_id")))
    # a relay has each swimmer once
    leg = of_roots(legs).join(to, "badge_id", "left")
    leg = leg.withColumn("twin", F.col("id") != F.min("id").over(Window.partitionBy("relay_id", "new_swimmer_id")))
    leg_changes = leg.where(F.col("twin") | ~own | (F.col("badge_id") != F.col("survivor"))).select(*change(4, "relay_swimmers", F.when(F.col("twin"), "DELETE").otherwise("UPDATE"), "id", F.when(~F.col("twin"), F.col("new_swimmer_id")), F.when(~F.col("twin"), F.col("survivor"))))
    swimmers = roots.select(*change(6, "swimmers", F.lit("DELETE"), "source"))
    changes = of_twins.unionByName(of_moved).unionByName(result_changes).unionByName(leg_changes).unionByName(badge_changes).unionByName(swimmers)
    return Merge(roots, conflicts, held, changes)


@dataclass(frozen=True)
class Branch:
    """A level of a tree of tables: its rows' parent column, what tells rows of one parent apart, and whole numbers that a merged row takes over."""

    name: str
    parent: str
    natural: tuple[str, ...]
    values: tuple[str, ...] = ()


def merge_trees(roots: DataFrame, branches: list[Branch], tables: dict[str, DataFrame], steps: Steps) -> DataFrame:
    """(step, table, operation, id, column, value): the changes by which each source of roots (source, root) becomes its root, level by level from the top.

    A row under a source goes under the root. If the root has a row of the same natural key there (the least, if it has several), the two are one: the row is deleted, its children go
    on to that row, and its values win where they are above 0 (of several rows the one of the largest id). Else it moves with all below it. Deletes come after all levels, the lowest first.
    """
    to = roots.select(F.col("source").alias("__id"), F.col("root").alias("__to"))
    out, merged = [], []
    for step, b in enumerate(branches, 1):
        parent = F.col(b.parent)
        # rows below neither a source nor its root neither move nor have others come to them
        heads = to.select(F.col("__to").alias("__id")).distinct().join(to, "__id", "left_anti").select("__id", F.col("__id").alias("__to"))
        rows = tables[b.name].join(to.unionByName(heads), parent == F.col("__id")).withColumnRenamed("__to", "__new").drop("__id")
        stays = rows.where(F.col("__new") == parent).groupBy(F.col(b.parent).alias("__new"), *b.natural).agg(F.min("id").alias("__twin"))
        moved = steps.keep(rows.where(F.col("__new") != parent).join(stays, ["__new", *b.natural], "left"), f"moved-{b.name}")
        change = lambda df, operation, key, column, value, step=step, b=b: df.select(F.lit(step).alias("step"), F.lit(b.name).alias("table"), F.lit(operation).alias("operation"), F.col(key).alias("id"), F.lit(column).cast("string").alias("column"), value.cast("long").alias("value"))
        out.append(change(moved.where("__twin is null"), "UPDATE", "id", b.parent, F.col("__new")))
        twins = moved.where("__twin is not null")
        for value in b.values:
            won = steps.keep(twins.where(F.col(value) > 0).groupBy("__twin").agg(F.max_by(value, "id").alias("__won")), f"won-{b.name}-{value}")
            held = tables[b.name].select(F.col("id").alias("__twin"), F.col(value).alias("__held"))
            out.append(change(won.join(held, "__twin").where(~F.col("__won").eqNullSafe(F.col("__held"))), "UPDATE", "__twin", value, F.col("__won")))
        merged.append((b.name, twins))
        to = steps.keep(twins.select(F.col("id").alias("__id"), F.col("__twin").alias("__to")), f"twins-{b.name}")  # small if few are, and read as such
    none = F.lit(None)
    for k, (name, twins) in enumerate(reversed(merged), len(branches) + 1):
        out.append(twins.select(F.lit(k).alias("step"), F.lit(name).alias("table"), F.lit("DELETE").alias("operation"), "id", none.cast("string").alias("column"), none.cast("long").alias("value")))
    return reduce(DataFrame.unionByName, out)
