"""Shapley values against all subsets, and their sum against the model's own prediction."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tickforge.operators import shapley

NAMES = ["a", "b", "c", "d"]


def random_tree(r, features, depth):
    nodes = {}

    def grow(count, left):
        at = len(nodes)
        nodes[at] = {"value": float(r.normal()), "count": count, "left": -1, "right": -1}
        if left and count > 1 and (left == depth or r.random() < 0.8):
            share = int(r.integers(0, count + 1))
            nodes[at] |= {"feature": int(r.integers(features)), "threshold": float(r.integers(4)), "left": grow(share, left - 1)}
            nodes[at]["right"] = grow(count - share, left - 1)
        return at

    grow(1000, depth)
    return nodes


def known_mean(nodes, x, known, at=0):
    """The prediction with only some features known, by walking the tree."""
    n = nodes[at]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return known_mean(nodes, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    total = n["count"]
    return sum(nodes[c]["count"] / total * known_mean(nodes, x, known, c) for c in (n["left"], n["right"])) if total else 0.0


def by_subsets(nodes, x):
    d = len(x)
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            for s in combinations(rest, k):
                out[i] += factorial(k) * factorial(d - 1 - k) / factorial(d) * (known_mean(nodes, x, {*s, i}) - known_mean(nodes, x, set(s)))
    return out


def test_values_are_those_of_all_subsets():
    r = np.random.default_rng(4)
    for depth in (0, 1, 2, 4, 7):
        for _ in range(12):
            nodes = random_tree(r, 5, depth)
            x = np.vstack([r.integers(-1, 5, (6, 5)).astype(float), [np.nan] * 5])
            leaves = shapley.leaves_of(nodes)
            got = shapley.shapley_values(leaves, x)
            for row, v in zip(x, got, strict=True):
                assert np.allclose(v, by_subsets(nodes, row), atol=1e-12)
                assert abs(v.sum() + shapley.expectation(leaves) - known_mean(nodes, row, set(range(5)))) < 1e-9
    assert np.allclose(shapley.shapley_values(shapley.leaves_of(nodes, 3.0), x), 3 * got)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    a, b, c, d = r.normal(size=(4, 600))
    y = 2 * a - b * (c > 0) + 0.1 * r.normal(size=600)
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(a, b, c, d, y, strict=True))], "bar_seq long, a double, b double, c double, d double, y double").withColumn("label", (F.col("y") > 0).cast("double")).cache()


@pytest.mark.parametrize("kind", [GBTRegressor, RandomForestRegressor, GBTClassifier, RandomForestClassifier])
def test_values_sum_to_the_prediction(spark, rows, kind, tmp_path):
    trees = {"maxIter": 5} if "GBT" in kind.__name__ else {"numTrees": 5}
    learner = kind(maxDepth=4, seed=1, **trees, labelCol="label" if "Class" in kind.__name__ else "y")
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), learner]).fit(rows)
    # As read back: a forest's classifier that was just fitted holds its session by its summary, and a session that observes can't go to tasks.
    model.write().save(f"{tmp_path}/model")
    model = PipelineModel.load(f"{tmp_path}/model")
    said = model.transform(rows)
    if kind is GBTClassifier:
        value = vector_to_array("rawPrediction")[1]
    elif kind is RandomForestClassifier:
        value = vector_to_array("probability")[1]
    else:
        value = F.col("prediction")
    want = {x["bar_seq"]: x["v"] for x in said.select("bar_seq", value.alias("v")).collect()}
    found = shapley.contributions(model, rows, NAMES)
    base = shapley.expectations(spark, model)[0]
    got = {x["bar_seq"]: x["s"] for x in found.groupBy("bar_seq").agg(F.sum("contribution").alias("s")).collect()}
    # MLlib keeps the margin of its classes as -m and m.
    assert len(got) == 600 and all(abs(got[k] + base - want[k]) < 1e-9 for k in want)
    size = {x["feature"]: x["s"] for x in found.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("s")).collect()}
    assert max(size, key=size.get) == "a" and size["d"] < 0.5 * size["b"]
    assert shapley.contributions(model, rows.limit(0), NAMES).count() == 0
