"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gannet.llm.common import cut, drop


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a-b in order, and the smallest node each can reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def connected(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) of every id in edges (columns a and b, long), as a table written by cut.

    Large-star and small-star steps in turn until nothing changes, each round written out. No
    node's neighbours are gathered anywhere: a node meets its smallest neighbour by a partial
    minimum and a join that Spark can split where one node has many edges. Edges with a null end
    are ignored, loops give a component of one.
    """
    known = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    every = cut(known.distinct())
    now, before = cut(every.where("hi != lo")), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), now)
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.union(lowest.select("hi", "m")).distinct(), large)
    nodes = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    # what is nobody's higher end is a root, or stands alone in a loop
    roots = every.select(F.col("lo").alias("id")).distinct().join(nodes, "id", "left_anti")
    found = cut(nodes.union(roots.select("id", "id")), every)
    drop(now)
    return found
