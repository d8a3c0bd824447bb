"""Exact Shapley values of a shallow tree's class shares, as column expressions.

What a set of features S tells is the tree's expectation when splits on other features are taken by
the training weights that went each way. A leaf depends only on which of its path's features agree
with the path, so each leaf has, for each of these patterns, the Shapley weights of its features
worked out beforehand. A row's values are then looked up and added: a narrow projection without a
shuffle, whole-stage compiled, on a frame or a stream.

Nulls in a feature make the row's values null. A tree of one leaf gives zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Features on one path; a path's table has two to this power entries.
MOST = 8


@dataclass
class Leaf:
    """A leaf's class shares, and for each feature on its path the interval (low, high] and the share of weight that follows it."""

    share: np.ndarray
    cover: float
    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)
    follow: dict[int, float] = field(default_factory=dict)


def leaves_of(model) -> list[Leaf]:
    """Leaves of a fitted decision tree with continuous splits."""
    root = model._java_obj.rootNode()
    weight = lambda node: float(sum(node.impurityStats().stats()))
    total, out = weight(root), []
    todo = [(root, {}, {})]
    while todo:
        node, bounds, follow = todo.pop()
        if not node.getClass().getSimpleName().startswith("Internal"):
            stats = np.array(list(node.impurityStats().stats()), np.float64)
            out.append(Leaf(stats / stats.sum(), weight(node) / total, bounds, follow))
            continue
        split = node.split()
        feature, cut = int(split.featureIndex()), float(split.threshold())
        low, high = bounds.get(feature, (-math.inf, math.inf))
        for child, interval in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            share = follow.get(feature, 1.0) * weight(child) / weight(node)
            todo.append((child, bounds | {feature: interval}, follow | {feature: share}))
    return out


def pattern_weights(follow: Sequence[float]) -> np.ndarray:
    """(pattern, feature): Shapley weight of each path feature, for each pattern of agreement (bit i: feature i agrees).

    The leaf's game pays the product over its features of 1 or 0 (known: agrees or not) or the followed share (unknown).
    """
    m = len(follow)
    out = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        agrees = [float(pattern >> i & 1) for i in range(m)]
        for i in range(m):
            poly = np.zeros(m)  # by the number of known others
            poly[0] = 1.0
            for j in range(m):
                if j != i:
                    poly = poly * follow[j] + np.concatenate([[0.0], poly[:-1] * agrees[j]])
            size = sum(math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) * poly[s] for s in range(m))
            out[pattern, i] = size * (agrees[i] - follow[i])
    return out


def expected(leaves: Sequence[Leaf]) -> np.ndarray:
    """Class shares when no feature is known."""
    return sum(leaf.share * math.prod(leaf.follow.values()) for leaf in leaves)


def contribution_columns(leaves: Sequence[Leaf], features: Sequence[str], classes: int) -> list[Column]:
    """For each class an array with the value of every feature."""
    terms: dict[tuple[int, int], list[Column]] = {}
    for leaf in leaves:
        path = sorted(leaf.follow)
        if not path:
            continue
        if len(path) > MOST:
            raise ValueError(f"a path with more than {MOST} features: fit a shallower tree")
        weights = pattern_weights([leaf.follow[f] for f in path])
        bit = lambda f, leaf=leaf: (F.col(features[f]) > leaf.bounds[f][0]) & (F.col(features[f]) <= leaf.bounds[f][1])
        pattern = sum((bit(f).cast("int") * (1 << i) for i, f in enumerate(path)), F.lit(0))
        for i, f in enumerate(path):
            looked = F.get(F.lit(weights[:, i].tolist()), pattern)
            for c in range(classes):
                if leaf.share[c]:
                    terms.setdefault((c, f), []).append(looked * float(leaf.share[c]))
    return [F.array(*(sum(terms.get((c, f), []), F.lit(0.0)) for f in range(len(features)))) for c in range(classes)]


def contributions(model, rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and ``contributions``: an array over classes of arrays over features."""
    leaves = leaves_of(model)
    return rows.select(*keep, F.array(*contribution_columns(leaves, features, model.numClasses)).alias("contributions"))


def check_additivity(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(rows, largest_error): values and the base must add up to the class shares that the tree predicts."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base = F.lit(expected(leaves_of(model)).tolist())
    made = contributions(model, rows, features, keep=features)
    told = model.transform(VectorAssembler(inputCols=list(features), outputCol="_features").transform(made))
    sums = F.transform("contributions", lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    gap = F.zip_with(F.zip_with(sums, base, lambda a, b: a + b), vector_to_array("probability"), lambda a, b: F.abs(a - b))
    return told.agg(F.count("*").alias("rows"), F.max(F.array_max(gap)).alias("largest_error"))


def _means(long: DataFrame, features: Sequence[str], *keys: str) -> DataFrame:
    """Mean size of each feature's value by ``keys``, and its place among the features."""
    from pyspark.sql import Window

    boxed = F.array(*(F.struct(F.lit(f).alias("feature"), F.abs(F.get("own", F.lit(i))).alias("size")) for i, f in enumerate(features)))
    mean = long.select(*keys, F.explode(boxed).alias("p")).groupBy(*keys, F.col("p.feature").alias("feature")).agg(F.avg("p.size").alias("mean_absolute_shap"))
    order = Window.partitionBy(*keys).orderBy(F.desc("mean_absolute_shap"), "feature")  # a row for each feature
    return mean.withColumn("place", F.row_number().over(order).cast("long"))


def importance(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_absolute_shap, place) over all rows and classes."""
    made = contributions(model, rows, features).select(F.explode("contributions").alias("own"))
    return _means(made, features)


def importance_by_cluster(model, rows: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """(cluster, feature, mean_absolute_shap, place): a row counts with the values of its own cluster's class; cluster null: all rows."""
    made = contributions(model, rows, features, keep=[label]).select(F.col(label).cast("long").alias("cluster"), F.get("contributions", F.col(label).cast("int")).alias("own"))
    whole = _means(made, features).withColumn("cluster", F.lit(None).cast("long"))
    return _means(made, features, "cluster").unionByName(whole)
