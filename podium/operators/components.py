"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def hung(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components, and mostly far fewer: the smaller neighbours of a node hang on the smallest of them, as does the node."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.withColumn("least", F.min("dst").over(Window.partitionBy("src")))
    return least.select("src", F.col("least").alias("dst")).unionByName(least.where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))).distinct()


def connected_components(edges: DataFrame, keep: Keep, src: str = "src", dst: str = "dst", drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(node, component): each node that has an edge to another, and the smallest node it reaches.

    Every round gives a node the smallest label among its neighbours, then the label of its label, so that
    a chain halves. keep(df, name) stores a round's labels and cuts their lineage, drop(df) deletes what is stored and
    no longer needed; the driver learns only whether a label has changed.
    Null ends and loops are dropped; an empty table of edges has no components. Nodes of a dense cluster have about an edge each in the rounds, not one for each neighbour.
    """
    few = keep(hung(hung(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst"))), "hung")
    both = keep(few.unionByName(few.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    drop(few)
    labels = keep(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        lower = keep(labels.select("node", F.col("label").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("label")), "labels")
        of = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = keep(lower.join(of, lower.label == of.at, "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        drop(labels)
        drop(lower)
        if jumped.where("label <> old").isEmpty():
            drop(both)
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped
