"""Connected components of links that may be stars of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import kept


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join what the links (a, b) of one task join: fewer than it has nodes."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of ``links`` (x, y); a component is named by its smallest node.

    Every round takes the smallest name among a node and its neighbours and then the name that this name's node has.
    Both steps join tables that were written before, so that Spark can split the key of a node with many neighbours.
    """
    ends = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = kept(ends.unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct(), "links", 8)
    names = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "names", 8)
    while True:
        heard = both.join(names, both["a"] == names["node"]).groupBy("b").agg(F.min("component").alias("m"))
        lower = names.join(heard, names["node"] == heard["b"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        lower = kept(lower, "lower", 8)
        roots = lower.select(F.col("node").alias("root"), F.col("low").alias("top"))
        names = kept(lower.join(roots, lower["low"] == roots["root"]).select("node", "old", F.least("low", "top").alias("component")), "names", 8)
        if names.where("component != old").limit(1).count() == 0:
            return names.select("node", "component")
        names = names.select("node", "component")
