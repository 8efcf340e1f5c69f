"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a group-by on the vertex and shuffles each edge a constant number of times; lineage is cut by a table in
the shared folder. The number of rounds is logarithmic in practice, and no vertex or edge reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest node of its component, node) for the nodes, in order, of edges that fit in a task: labels hook and jump."""
    node, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return node[label], node
        label = new


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component = its lowest node.

    Null ends and loops are ignored; repeated edges count once; no edge gives an empty table.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = materialize(edges.where("a is not null and b is not null and a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
