"""Connected components of an edge list, by hooking and contraction in DataFrame code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); the label is
    the smallest node of its component.

    In each round every component hooks onto its smallest neighbour, hooks are
    shortened by pointer jumping, and edges are contracted to edges between
    labels, so few rounds are needed and each has fewer edges. Edges are kept
    distinct; a node with very many neighbours is folded by partial aggregation.
    """
    edges = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges"
    )
    labels = edges.select(F.explode(F.array("high", "low")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy("high").agg(F.min("low").alias("to")), "hooks")
        for _ in range(JUMPS):
            next_hooks = hooks.select(F.col("high").alias("via"), F.col("to").alias("further"))
            longer = hooks.join(next_hooks, hooks["to"] == next_hooks["via"], "left").select("high", F.coalesce("further", "to").alias("to"))
            longer = materialize(longer, "hooks")
            release(hooks)
            hooks = longer
        labelled = labels.join(hooks, labels["label"] == hooks["high"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labelled = materialize(labelled, "labels")
        if hasattr(labels, "_scratch"):
            release(labels)
        labels = labelled
        ends = hooks.select(F.col("high").alias("key"), F.col("to").alias("new"))
        moved = edges.join(ends, edges["high"] == ends["key"]).select(F.col("new").alias("x"), "low")
        moved = moved.join(ends, moved["low"] == ends["key"], "left").select("x", F.coalesce("new", "low").alias("y"))
        moved = moved.filter("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct()
        moved = materialize(moved, "edges")
        release(edges, hooks)
        edges = moved
    return labels
