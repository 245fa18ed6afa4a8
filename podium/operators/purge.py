"""Purges along foreign keys: which rows go with the rows of one table, in an order that leaves no row without its parent.

The foreign keys are data: (child, column, parent). From them the planner derives the levels of the graph below the root; a table's doomed ids are those
that refer to a doomed row of any parent, a semi-join a foreign key. Each id set is computed once, written, and reused by every table below it and by the deletes. Deletes
come in reverse: a table before all that it refers to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.sources.shared import Steps


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


def below(keys: list[ForeignKey], root: str) -> list[str]:
    """The tables that depend on root, root first, each after all of its parents among them; equal ones in the order of the keys. A cycle is an error."""
    reached, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for k in keys:
            if k.parent == at and k.child not in reached:
                reached.add(k.child)
                todo.append(k.child)
    order, names = [], [root, *dict.fromkeys(k.child for k in keys if k.child in reached and k.child != root)]
    while len(order) < len(names):
        ready = [n for n in names if n not in order and all(k.parent in order for k in keys if k.child == n and k.parent in reached)]
        if not ready:
            raise ValueError(f"foreign keys in a circle: {sorted(set(names) - set(order))}")
        order.append(ready[0])
    return order


def doomed(tables: dict[str, DataFrame], keys: list[ForeignKey], root: str, ids: DataFrame, steps: Steps) -> dict[str, DataFrame]:
    """For each table below root, and root, the ids of the rows that go with `ids` of root. tables have id and the foreign keys' columns."""
    gone: dict[str, DataFrame] = {}
    for name in below(keys, root):
        if name == root:
            own = tables[root].join(ids.select("id").distinct(), "id", "left_semi").select("id")
        else:
            mine = [k for k in keys if k.child == name and k.parent in gone]
            own = reduce(DataFrame.unionByName, (tables[name].join(gone[k.parent].withColumnRenamed("id", k.column), k.column, "left_semi").select("id") for k in mine))
            own = own.distinct() if len(mine) > 1 else own
        gone[name] = steps.keep(own, f"doomed-{name}")
    return gone


def deletes(gone: dict[str, DataFrame], spared: set[str] = frozenset()) -> DataFrame:
    """(step, table, id): what to delete, each table before those it refers to; spared ones stay."""
    order = [n for n in reversed(gone) if n not in spared]
    return reduce(DataFrame.unionByName, (gone[n].select(F.lit(k).alias("step"), F.lit(n).alias("table"), "id") for k, n in enumerate(order, 1)))


def orphans(tables: dict[str, DataFrame], keys: list[ForeignKey], deleted: DataFrame) -> DataFrame:
    """(child, column, id): rows that stay and whose parent is deleted; a right plan leaves none."""
    parts = []
    for k in keys:
        left = tables[k.child].join(deleted.where(F.col("table") == k.child).select("id"), "id", "left_anti")
        lost = deleted.where(F.col("table") == k.parent).select(F.col("id").alias(k.column))
        parts.append(left.join(lost, k.column, "left_semi").select(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), "id"))
    return reduce(DataFrame.unionByName, parts)
