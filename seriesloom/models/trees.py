"""Fitted tree ensembles as column expressions.

A forecast that is fed back needs the model inside an expression over the window of a
series. The nodes of all trees are numbered in the order of a walk that goes left
first, so a left child is the next node; what a row needs is then the same few array
look-ups a level, however large the ensemble is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = -1


@dataclass(frozen=True)
class Ensemble:
    """Weighted regression trees by node: the feature asked (LEAF: none), its threshold, the right child, the value."""

    feature: list[int]
    threshold: list[float]
    right: list[int]
    value: list[float]
    roots: list[int]
    weights: list[float]
    depth: int

    def predict(self, x: Column) -> Column:
        """The prediction for an array of features."""
        feature, right = (F.array(*[F.lit(v) for v in values]) for values in (self.feature, self.right))
        threshold, value = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.threshold, self.value))
        levels = F.array(*[F.lit(0)] * self.depth).cast("array<int>")

        def below(at: Column, _level: Column) -> Column:
            asked = F.get(feature, at)
            goes_left = F.get(x, asked) <= F.get(threshold, at)
            return F.when(asked == LEAF, at).when(goes_left, at + 1).otherwise(F.get(right, at))

        trees = F.array(*[F.struct(F.lit(r).alias("root"), F.lit(float(w)).alias("weight")) for r, w in zip(self.roots, self.weights, strict=True)])

        def add(total: Column, tree: Column) -> Column:
            return total + tree["weight"] * F.get(value, F.aggregate(levels, tree["root"], below))

        return F.aggregate(trees, F.lit(0.0), add)


def compile_trees(model: GBTRegressionModel) -> Ensemble:
    """The nodes of a fitted model, read once; its size is that of the model, whatever the data."""
    feature, threshold, right, value, roots = [], [], [], [], []

    def visit(node) -> int:
        at = len(feature)
        feature.append(LEAF)
        threshold.append(0.0)
        right.append(at)
        value.append(float(node.prediction()))
        if node.getClass().getSimpleName() == "LeafNode":
            return 0
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("Only splits at a threshold can be compiled")
        feature[at], threshold[at] = split.featureIndex(), float(split.threshold())
        left_depth = visit(node.leftChild())
        right[at] = len(feature)
        return 1 + max(left_depth, visit(node.rightChild()))

    depth = 0
    for tree in model.trees:
        roots.append(len(feature))
        depth = max(depth, visit(tree._call_java("rootNode")))
    return Ensemble(feature, threshold, right, value, roots, list(model.treeWeights), depth)
