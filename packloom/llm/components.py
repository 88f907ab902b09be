"""Connected components of a table of links, by hooking and contraction.

In each round every node hooks to its least smaller neighbour, hooks are followed to their
ends by pointer doubling, and the links are contracted to links between those ends. Each step
is an aggregate or a join, so a node with many links is split like any other skewed key. Only
"is there a link left" comes to the driver. New links can be added to labels found before, at
the cost of the new links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, grown


def _renamed(df: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """`column` replaced by its label where it has one."""
    to = grown(label.select(F.col("node").alias(column), F.col("label").alias("_to")))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _between(df: DataFrame, label: DataFrame | None) -> DataFrame:
    """Links (u > v) between the components that the ends a and b of `df` are in."""
    if label is not None:
        df = _renamed(_renamed(df, "a", label), "b", label)
    return df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, kept: Stored, label: DataFrame | None = None) -> DataFrame:
    """(node, label) for all nodes but those that are the least of their component: the label is
    that least node. `label` has the components so far. Self-links and repeats are harmless."""
    edges = kept.put(_between(links.select("a", "b"), label))
    while not edges.isEmpty():
        hooks = kept.put(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        while True:
            followed = kept.put(_renamed(hooks.withColumn("was", F.col("label")), "label", hooks))
            moved = not followed.filter("label != was").isEmpty()
            kept.drop(hooks)
            hooks = followed.drop("was")
            hooks._stored_path = followed._stored_path
            if not moved:
                break
        old = label
        label = kept.put(hooks if old is None else _renamed(old, "label", hooks).select("node", "label").unionByName(hooks.select("node", "label")))
        before, edges = edges, kept.put(_between(edges, hooks))
        kept.drop(hooks, before, *([old] if old is not None else []))
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
