"""Exact Shapley values of tree ensembles, path-dependent: what a feature adds to a prediction, on average over all orders in which features become known.

A feature that isn't known is passed by both branches of its splits, with the shares of the training rows that went there.  A leaf's value is
then a product over the distinct features of its path: for each whether the row keeps to the path, against the share of rows that do.
The Shapley value of such a product is a sum over sizes of subsets, whose weights come from the coefficients of a polynomial, so a leaf
with d features costs d squared steps, for all rows of a batch at once, and not 2 to the power of d.

Trees are read from what MLlib saves of a model (a table of nodes), are bounded by the model, and go to tasks with the function; rows are worked on in
Arrow batches where they are.

Explained are a regression's prediction, the margin of a boosted classifier (before the logistic function), and the probability of
the last class of a forest.  A pipeline with an ensemble a class has values of each class.

Defined cases
* Values of a row sum to its prediction minus `expectation`, the mean of the leaves by training rows.
* A split that no training row went through on one side has share 0 there.  NULL or NaN features go right, as in MLlib's comparison.
* An ensemble of single leaves gives zeros.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources.scratch import delete, fresh


@dataclass
class Leaf:
    """One path to a leaf: its value, and for each distinct feature the half-open interval that keeps to the path and the share of rows that do."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves_of(nodes: dict[int, dict], weight: float = 1.0) -> list[Leaf]:
    """The paths of one tree.  A node has value, count, and unless it is a leaf feature, threshold (at most goes left), left and right."""
    out = []
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        n = nodes[at]
        if n["left"] < 0:
            f = sorted(path)
            out.append(Leaf(weight * n["value"], f, [path[x][0] for x in f], [path[x][1] for x in f], [path[x][2] for x in f]))
            continue
        for child, low, high in ((n["left"], -np.inf, n["threshold"]), (n["right"], n["threshold"], np.inf)):
            was = path.get(n["feature"], (-np.inf, np.inf, 1.0))
            share = nodes[child]["count"] / n["count"] if n["count"] else 0.0
            stack.append((child, path | {n["feature"]: (max(was[0], low), min(was[1], high), was[2] * share)}))
    return out


def ensembles(model: Transformer) -> list[Transformer]:
    """The tree ensembles of a pipeline in order: one, or one a class."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    return [s for s in stages if hasattr(s, "treeWeights")]


def read_leaves(spark: SparkSession, ensemble: Transformer) -> list[Leaf]:
    """The paths of all trees, from the nodes as MLlib saves them."""
    path = fresh(spark, "trees")
    ensemble.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    delete(spark, [path])
    forest = "numClasses" in dir(ensemble) and not type(ensemble).__name__.startswith("GBT")
    weights = [1.0 / len(ensemble.treeWeights)] * len(ensemble.treeWeights) if "Forest" in type(ensemble).__name__ else ensemble.treeWeights
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        stats = r["impurityStats"]
        # A forest's leaf votes with its classes' shares; all other leaves are numbers.  The first statistic of a regression is its count.
        count = sum(stats) if forest else stats[0]
        value = stats[-1] / count if forest and count else r["prediction"]
        if r["leftChild"] >= 0 and r["split"]["numCategories"] != -1:
            raise ValueError("splits by category aren't covered")
        threshold = r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else None
        trees.setdefault(r["treeID"], {})[r["id"]] = {"value": value, "count": count, "left": r["leftChild"], "right": r["rightChild"], "feature": r["split"]["featureIndex"], "threshold": threshold}
    return [leaf for t, nodes in trees.items() for leaf in leaves_of(nodes, weights[t])]


def expectation(leaves: list[Leaf]) -> float:
    return float(sum(x.value * np.prod(x.share) for x in leaves))


def shapley_values(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Values by row and feature of a matrix of rows and features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        v = x[:, leaf.features]
        # A comparison with NaN is false, so it is never at most a threshold and goes right.
        keeps = (~(v <= np.array(leaf.low)) | np.isneginf(leaf.low)) & ((v <= np.array(leaf.high)) | np.isposinf(leaf.high))
        share = np.array(leaf.share)
        weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        for i in range(d):
            # Coefficient k: the sum over subsets of k of the other features of what the known keep times what the unknown share.
            c = np.zeros((len(x), d))
            c[:, 0] = 1.0
            for n, j in enumerate(j for j in range(d) if j != i):
                known = c[:, : n + 1] * keeps[:, j, None]
                c[:, : n + 1] *= share[j]
                c[:, 1 : n + 2] += known
            out[:, leaf.features[i]] += leaf.value * (keeps[:, i] - share[i]) * (c @ weights)
    return out


def contributions(model: Transformer, rows: DataFrame, features: list[str], key: str = "bar_seq") -> DataFrame:
    """(key, class, feature, value, contribution): the Shapley values of each row's features, for each class that has an ensemble of its own (else class 0)."""
    spark = rows.sparkSession
    paths = [read_leaves(spark, e) for e in ensembles(model)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].to_numpy(dtype=float)
            for k, own in enumerate(paths):
                v = shapley_values(own, x)
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(features)), "class": k, "feature": np.tile(np.array(features, object), len(b)), "value": x.ravel(), "contribution": v.ravel()})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *(F.col(f).cast("double").alias(f) for f in features)).mapInPandas(run, f"{key} {kind}, class int, feature string, value double, contribution double")


def expectations(spark: SparkSession, model: Transformer) -> list[float]:
    """What values are counted from, of each ensemble."""
    return [expectation(read_leaves(spark, e)) for e in ensembles(model)]
