"""Boosted trees outside their library: a fitted model's nodes as arrays, which predict inside any
task, and the shares that features have in its predictions.

Shares are Shapley values of the game in which a tree follows the row at nodes of known features and
goes both ways, by the training rows' numbers, at the others. A leaf is reached along a path, and
its part of the game is a product over the path's features: 1 or 0 (the row goes that way or not)
for a known one, the share of training rows for an unknown one. A feature's value at a leaf
follows from the polynomial whose coefficients sum those products by the number of known features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Arrays by node; ``feature`` is -1 at leaves, ``left`` is taken at or below the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows, node = np.flatnonzero(inner), at[inner]
            down = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(down, self.left[node], self.right[node])
        return self.value[at]

    def paths(self) -> Iterator[tuple[float, dict[int, tuple[list[tuple[float, bool]], float]]]]:
        """Each leaf: its value, and for each feature on its path the (threshold, goes left) of its
        nodes and the product of their shares of rows."""
        open_nodes = [(0, {})]
        while open_nodes:
            node, path = open_nodes.pop()
            if self.feature[node] < 0:
                yield float(self.value[node]), path
                continue
            f = int(self.feature[node])
            steps, share = path.get(f, ([], 1.0))
            for child, down in ((self.left[node], True), (self.right[node], False)):
                part = share * self.cover[child] / self.cover[node]
                open_nodes.append((int(child), path | {f: ([*steps, (float(self.threshold[node]), down)], part)}))

    def shares(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for value, path in self.paths():
            features, u = list(path), len(path)
            known = {f: np.all([(x[:, f] <= t) == down for t, down in path[f][0]], axis=0).astype(float) for f in features}
            weight = [factorial(k) * factorial(u - 1 - k) / factorial(u) for k in range(u)]
            for f in features:
                # Column k: the sum of products over sets of k known features among the others.
                sums = np.ones((len(x), 1))
                for g in features:
                    if g != f:
                        wider = np.zeros((len(x), sums.shape[1] + 1))
                        wider[:, :-1] += sums * path[g][1]
                        wider[:, 1:] += sums * known[g][:, None]
                        sums = wider
                out[:, f] += value * (sums @ weight) * (known[f] - path[f][1])
        return out

    def mean(self) -> float:
        """What is expected of the training rows."""
        leaves = self.feature < 0
        return float((self.value[leaves] * self.cover[leaves]).sum() / self.cover[0])


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((w * t.predict(x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(len(x)))

    def shares(self, x: np.ndarray) -> np.ndarray:
        return sum((w * t.shares(x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(x.shape))

    def mean(self) -> float:
        return sum(w * t.mean() for t, w in zip(self.trees, self.weights, strict=True))


def forest_of(model: GBTRegressionModel, folder: str) -> Forest:
    """The model's nodes, by way of ``folder``, where it is saved. Their number is bounded by the
    model's own parameters (trees and depth), whatever it was fitted on."""
    model.write().overwrite().save(folder)
    node = SparkSession.getActiveSession().read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    rows = node.select(
        "treeID", "id", "prediction", F.col("rawCount").cast("double").alias("cover"), "leftChild", "rightChild",
        "split.featureIndex", F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
    ).toPandas().sort_values(["treeID", "id"])
    trees = []
    for _, part in rows.groupby("treeID"):
        if (part["id"].to_numpy() != np.arange(len(part))).any():
            raise ValueError("the saved nodes aren't numbered in order")
        inner = part["leftChild"].to_numpy() >= 0
        trees.append(Tree(
            np.where(inner, part["featureIndex"], -1).astype(np.int64), part["threshold"].fillna(0.0).to_numpy(float),
            part["leftChild"].to_numpy(np.int64), part["rightChild"].to_numpy(np.int64), part["prediction"].to_numpy(float), part["cover"].to_numpy(float),
        ))
    return Forest(trees, list(model.treeWeights))


def importance(model: GBTRegressionModel, names: list[str]) -> DataFrame:
    """feature, importance (share of the gain), the largest first."""
    values = model.featureImportances.toArray().tolist()
    rows = SparkSession.getActiveSession().createDataFrame(list(zip(names, map(float, values), strict=True)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def sampled(design: DataFrame, keys: list[str], *, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, the same ones for a seed: those of the smallest hashes of their keys."""
    return design.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(rows)


def shapley_values(design: DataFrame, forest: Forest, names: list[str], keys: list[str]) -> DataFrame:
    """``keys``, feature and shap for every row and feature, in one pass over ``design``."""
    kinds = dict(design.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            made = pd.DataFrame(forest.shares(df[names].to_numpy(float)), columns=names, index=df.index)
            yield pd.concat([df[keys], made], axis=1)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` double" for n in names)])
    return design.select(*keys, *names).mapInPandas(run, schema).unpivot(keys, names, "feature", "shap")


def mean_abs_shap(values: DataFrame) -> DataFrame:
    """feature, mean_abs_shap, the largest first."""
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
