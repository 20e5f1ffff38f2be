"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Alternating star contraction: each round hangs the larger neighbours of a node on
    its smallest one, then does the same seen from the other end. A round is a
    partially aggregated minimum and a join, so no task ever holds the neighbours of
    a node; rounds grow with the logarithm of the longest chain. Each round's table
    is written to the shared folder. Links with a null end or to itself are ignored;
    no links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage_table(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = hung.distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        turned = edges.join(least, "a")
        edges = turned.select("a", F.col("m").alias("b")).unionByName(
            turned.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = stage_table(edges.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def smallest_labels(size: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Labels of ``size`` nodes joined by the links a-b within one task; a label is a node of the component."""
    label = np.arange(size) if start is None else start.copy()
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label
