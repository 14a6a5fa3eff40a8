"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, written


def local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that edges a-b reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges and result: tables of (u, v) with v < u. Every neighbour list is reduced by partial
    aggregation, and the join's one side has a row per node: a hub's list is never one group.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    out = written(out.distinct(), "stars")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component.

    edges: any numbers, in either direction, repeats and loops allowed; null ends are ignored.
    Rounds grow with the logarithm of the longest chain; each is a table in the shared folder.
    """
    at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        middle = _star(at, True)
        drop(at)
        at = _star(middle, False)
        drop(middle)
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
