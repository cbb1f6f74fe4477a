"""Toxicity by a classifier chain.

The categories stand in a fixed order. Each has a logistic model over the distinct words of a
text (hashed into a table of fixed size) and over the log-odds of all categories before it. In
training these come from out-of-fold predictions: a row's probability is given by a model that
hasn't seen the row, as it will be for new texts. Predicting runs down the chain with the models
fitted on all training rows. The threshold of each category is the one with the best F1 on its
out-of-fold predictions.

The models are fitted on about ``train_rows`` labelled rows (those of the smallest hashes of
their ids, never more than twice as many); scoring covers every whole text where it is read.

Defined results: null and empty texts have no words and get the models' base rates; labels that
are null, or whose id no document has, teach nothing; a category with one kind of label only, or
none, gets its base rate everywhere (0.5 without any label), and one without a 1 among its labels
is never said of a text; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import sliced

FEATURES = 1 << 18
FOLDS = 3
WORD = re.compile(r"\w+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct table places of the text's lower-case words."""
    found = list(set(WORD.findall((text or "").lower())))
    if not found:
        return np.empty(0, np.int32)
    codes = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    return np.unique((codes >> np.uint64(46)).astype(np.int32))


class Rows:
    """Sparse 0/1 rows, with a few dense columns beside them."""

    def __init__(self, places: list[np.ndarray], dense: np.ndarray):
        self.sizes = np.array([len(p) for p in places], np.int64)
        self.places = np.concatenate(places) if places else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(len(places)), self.sizes)
        self.dense = dense

    def __len__(self) -> int:
        return len(self.sizes)


class Model:
    def __init__(self, width: int):
        self.weights, self.beside, self.base, self.threshold = np.zeros(FEATURES), np.zeros(width), 0.0, 0.5

    def scores(self, rows: Rows) -> np.ndarray:
        """Log-odds."""
        return np.bincount(rows.row, self.weights[rows.places], len(rows)) + rows.dense @ self.beside + self.base

    def fit(self, rows: Rows, y: np.ndarray, *, ridge: float, steps: int, rate: float) -> Model:
        """Gradient descent on all rows, each step scaled by running moments of the gradient. A
        word counts by the log ratio of its rates in the two classes, so that common words weigh
        next to nothing from the start."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return self
        held = np.bincount(rows.places, minlength=FEATURES)
        ones = np.bincount(rows.places, y[rows.row], FEATURES)
        ratio = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((held - ones + 0.5) / (len(y) - y.sum() + 1))
        ratio[held < 4] = 0
        place = np.concatenate([self.weights, self.beside, [self.base]])
        first, second = np.zeros_like(place), np.zeros_like(place)
        for step in range(1, steps + 1):
            off = 1 / (1 + np.exp(-np.clip(self.scores(rows), -30, 30))) - y
            slope = np.concatenate([np.bincount(rows.places, off[rows.row], FEATURES) * ratio, off @ rows.dense, [off.sum()]]) / len(y)
            slope[:FEATURES] += ridge * place[:FEATURES]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            place -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
            self.weights, self.beside, self.base = place[:FEATURES] * ratio, place[FEATURES:-1], float(place[-1])
        return self


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The log-odds with the best F1, midway to the next score below it."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.append(np.diff(scores[order]) < 0, True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][at + 1] if at + 1 < len(y) else scores[order][at] - 1
    return float((scores[order][at] + below) / 2)


def fit_chain(places: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, *, ridge: float = 3e-3, steps: int = 30, rate: float = 0.05) -> list[Model]:
    """labels: (rows, categories) of 0, 1 or nan."""
    chain: list[Model] = []
    dense = np.zeros((len(places), 0))
    how = {"ridge": ridge, "steps": steps, "rate": rate}

    def some(which: np.ndarray) -> Rows:
        return Rows([places[i] for i in np.flatnonzero(which)], dense[which])

    for category in range(labels.shape[1]):
        y = labels[:, category]
        known = ~np.isnan(y)
        out = np.zeros(len(places))
        for fold in range(FOLDS):
            test = folds == fold
            if test.any():
                train = known & ~test
                out[test] = Model(category).fit(some(train), y[train], **how).scores(some(test))
        model = Model(category).fit(some(known), y[known], **how)
        if 0 < y[known].sum() < known.sum():
            model.threshold = best_threshold(out[known], y[known])
        else:  # nothing to tell apart: all or none
            model.threshold = 0.0 if y[known].any() else np.inf
        chain.append(model)
        dense = np.column_stack([dense, np.clip(out, -10, 10)])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, train_rows: int, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places, labels and folds of a bounded number of labelled documents."""
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*(F.max(c.cast("double")).alias(n) for n, c in categories.items()))
    held = judged.count()
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, train_rows / max(1, held)) * (1 << 20))
    chosen = judged.where(near).limit(2 * train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most 2 * train_rows rows of a few numbers: small enough to send to every executor.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", F.array(*categories).alias("labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int32())), batch.column("labels")], names=["id", "places", "labels"])

    found = rows.mapInArrow(run, "id long, places array<int>, labels array<double>").dropDuplicates(["id"])
    places, marks, folds = [], [], []
    for r in found.toLocalIterator():
        places.append(np.array(r["places"], np.int32))
        marks.append([np.nan if v is None else v for v in r["labels"]])
        folds.append(r["id"])
    order = np.argsort(folds)
    spread = np.array(folds, np.int64)[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return [places[i] for i in order], np.array(marks, float).reshape(-1, len(categories))[order], (spread % np.uint64(FOLDS)).astype(int)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, train_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and, for each category, p_<category> (double) and <category> (boolean), for
    every row. ``categories`` maps names, in the order of the chain, to expressions over
    ``labels`` that give 0, 1 or null."""
    chain = fit_chain(*training_rows(docs, labels, categories, train_rows=train_rows, id_col=id_col, text_col=text_col))
    # Most places have no weight; what tasks get is the list of those that have.
    packed = [(np.flatnonzero(m.weights).astype(np.int32), m.weights[np.flatnonzero(m.weights)].astype(np.float32), m.beside, m.base, m.threshold) for m in chain]
    names = [(f"p_{c}", c) for c in categories]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []
        for at, weights, beside, base, threshold in packed:
            model = Model(len(beside))
            model.weights[at], model.beside, model.base, model.threshold = weights, beside, base, threshold
            models.append(model)
        for batch in sliced(batches):
            places = [features(t.as_py()) for t in batch.column("text")]
            dense, arrays = np.zeros((len(places), 0)), [batch.column("id")]
            for model in models:
                score = model.scores(Rows(places, dense))
                dense = np.column_stack([dense, np.clip(score, -10, 10)])
                arrays += [pa.array(1 / (1 + np.exp(-np.clip(score, -30, 30)))), pa.array(score >= model.threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *(n for pair in names for n in pair)])

    schema = f"id {id_type}, " + ", ".join(f"`{p}` double, `{c}` boolean" for p, c in names)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
