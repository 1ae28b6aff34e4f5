"""Rounds over tables of nodes and edges: what a node takes from those above it, and what a root leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .placement import stable


def inherited(nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(file, object, value): each node's own value, else that of the nearest node above it, up to 2^rounds nodes counting itself.

    ``nodes`` is (file, object, parent, value), one row an object. Pointers are doubled: a round lets every node look where
    the node looks that it points to, so that five rounds see the 32 nodes that a walk of 32 steps sees. A parent that isn't there ends the
    walk, and so does a cycle without a value, with null.
    """
    now = nodes.select("file", "object", F.when(F.col("value").isNull(), F.col("parent")).alias("next"), "value")
    for _ in range(rounds):
        now = stable(now)
        seen = now.select(F.col("file").alias("_file"), F.col("object").alias("_object"), F.col("next").alias("_next"), F.col("value").alias("_value"))
        met = now.join(seen, (F.col("file") == F.col("_file")) & (F.col("next") == F.col("_object")), "left")
        value = F.coalesce("value", "_value")
        now = met.select("file", "object", F.when(value.isNull(), F.col("_next")).alias("next"), value.alias("value"))
    return now.select("file", "object", "value")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, object): the ``roots`` (file, object) and all that ``edges`` (file, from, to) lead to from them.

    A round follows the edges of what the round before has found new, and of that keeps what no round has seen; it ends when a round
    finds nothing. The rounds are as many as the longest shortest way from a root.
    """
    new = stable(roots.select("file", "object").distinct())
    seen = new
    by = edges.select("file", F.col("from").alias("object"), "to")
    while True:
        met = new.join(by, ["file", "object"]).select("file", F.col("to").alias("object")).distinct()
        new = stable(met.join(seen, ["file", "object"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)  # each round is written once
