"""Random forest with known bags, and what its out-of-bag rows say.

Spark's forest draws its bags inside. Here the number of times a row is in a tree's bag is a
hash of its key and the tree, distributed like Poisson(1), and enters as the row's weight. A
tree's out-of-bag rows are then known: they are scored by that tree alone, and one feature at
a time is exchanged among them, which gives the mean decrease in accuracy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.values import hash_uniform
from tenure.models.classifiers import largest_category
from tenure.models.design import FEATURES, fit_design, training_rows
from tenure.models.together import together
from tenure.session import stage

#: Seeds of the trees of one forest; those of forests with neighbouring seeds do not meet.
SEEDS = 1000
#: Rows among which a feature is exchanged at a time, in expectation.
SLICE_ROWS = 20_000
#: P(X <= n) of a Poisson variable with mean 1, as far as doubles tell them apart.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(12)]


def bag_count(key: Column, tree: int, seed: int = 1) -> Column:
    """How often the row with this key is in the bag of a tree."""
    u = hash_uniform(key, seed=seed * SEEDS + tree)
    count = F.lit(len(POISSON))
    for n, share in reversed(list(enumerate(POISSON))):
        count = F.when(u < share, n).otherwise(count)
    return count


class FlatTree:
    """A fitted tree as arrays: feature (-1 in a leaf), threshold, categories to the left, children, class."""

    def __init__(self, text: str) -> None:
        self.feature, self.threshold, self.left, self.right, self.leaf = [], [], [], [], []
        self.categories: dict[int, list[float]] = {}
        lines = iter([line.strip() for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)\b", line)])
        self._read(lines)
        self.feature, self.threshold = np.array(self.feature), np.array(self.threshold)
        self.left, self.right, self.leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)

    def _read(self, lines: Iterator[str]) -> int:
        line, node = next(lines), len(self.feature)
        for column in (self.feature, self.threshold, self.left, self.right, self.leaf):
            column.append(-1)
        if line.startswith("Predict"):
            self.leaf[node] = float(line.split(":")[1])
            return node
        m = re.match(r"If \(feature (\d+) (<=|in) (.*)\)$", line)
        self.feature[node] = int(m[1])
        if m[2] == "in":
            self.categories[node] = [float(x) for x in m[3].strip("{}").split(",") if x]
        else:
            self.threshold[node] = float(m[3])
        self.left[node] = self._read(lines)
        next(lines)  # the line that begins the other branch
        self.right[node] = self._read(lines)
        return node

    def used(self) -> set[int]:
        return set(self.feature[self.feature >= 0].tolist())

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = self.feature[at]
            rows = np.flatnonzero(feature >= 0)
            if not len(rows):
                return self.leaf[at]
            value = x[rows, feature[rows]]
            goes_left = value <= self.threshold[at[rows]]
            for node in np.unique(at[rows]).tolist() if self.categories else ():
                if node in self.categories:
                    here = at[rows] == node
                    goes_left[here] = np.isin(value[here], self.categories[node])
            at[rows] = np.where(goes_left, self.left[at[rows]], self.right[at[rows]])


@dataclass
class BaggedForest:
    """Trees with the prepared training rows: key, label, feature vector and ``bags``, one count for each tree."""

    stages: list
    trees: list[FlatTree]
    features: list[str]
    rows: DataFrame
    key: str
    label: str

    def _with_arrays(self) -> DataFrame:
        return self.rows.select(self.key, F.col(self.label).alias("y"), vector_to_array(FEATURES).alias("x"), "bags")

    def out_of_bag_votes(self) -> DataFrame:
        """(key, label, ``trees_out``, ``votes``): trees that did not see the row, and how many of them vote for 1."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.trees)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, out = _matrix(batch.column(2)), _matrix(batch.column(3)) == 0
                votes = np.zeros(len(x), np.int64)
                for t, tree in enumerate(shared.value):
                    votes[out[:, t]] += tree.predict(x[out[:, t]]) == 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out.sum(axis=1)), pa.array(votes)], names=["key", "y", "trees_out", "votes"])

        kind = self.rows.schema[self.key].dataType.simpleString()
        voted = self._with_arrays().mapInArrow(vote, f"key {kind}, y double, trees_out long, votes long")
        return voted.select(F.col("key").alias(self.key), F.col("y").alias(self.label), "trees_out", "votes")

    def importance(self) -> DataFrame:
        """Mean decrease in accuracy of each feature over the trees, its standard error and their ratio.

        Rows are dealt to slices by a hash of the key. In the hash order of a slice, every
        out-of-bag row of a tree takes the value of the next one, the last that of the first.
        """
        rows, n_trees = self._with_arrays(), len(self.trees)
        slices = max(1, self.rows.count() // SLICE_ROWS)
        place = hash_uniform(F.col(self.key), seed=SEEDS - 1)
        shared = self.rows.sparkSession.sparkContext.broadcast(self.trees)

        def exchange(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            order = np.argsort(table["place"].to_numpy(), kind="stable")
            x, out = _matrix(table["x"].chunk(0))[order], (_matrix(table["bags"].chunk(0)) == 0)[order]
            y, counts = table["y"].to_numpy()[order], []
            for t, tree in enumerate(shared.value):
                own, truth = x[out[:, t]], y[out[:, t]]
                right = int((tree.predict(own) == truth).sum())
                counts.append((t, -1, len(own), right))
                used = tree.used()
                for f in range(x.shape[1]):
                    moved = right
                    if f in used:
                        other = own.copy()
                        other[:, f] = np.roll(own[:, f], -1)
                        moved = int((tree.predict(other) == truth).sum())
                    counts.append((t, f, len(own), moved))
            columns = zip(*counts, strict=True)
            return pa.table(dict(zip(("tree", "feature", "n", "hits"), (pa.array(c, pa.int64()) for c in columns), strict=True)))

        dealt = rows.withColumns({"place": place, "slice": F.floor(place * slices)})
        counted = dealt.groupBy("slice").applyInArrow(exchange, "tree long, feature long, n long, hits long")
        counted = stage(counted.groupBy("tree", "feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
        whole = counted.where("feature = -1").select("tree", F.col("hits").alias("right"))
        loss = counted.where("feature >= 0 and n > 0").join(whole, "tree")
        decrease = (F.col("right") - F.col("hits")) / F.col("n")
        judged = loss.groupBy("feature").agg(F.avg(decrease).alias("importance"), (F.stddev_samp(decrease) / math.sqrt(n_trees)).alias("std_error"))
        names = F.array(*[F.lit(f) for f in self.features])
        ratio = F.try_divide("importance", "std_error").alias("z_value")
        return judged.select(F.element_at(names, (F.col("feature") + 1).cast("int")).alias("feature"), "importance", "std_error", ratio)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def fit_bagged(
    train: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 100, depth: int = 8, seed: int = 1, parallel: int = 4
) -> BaggedForest:
    """Forest whose bags follow from a unique ``key``; rows that miss an input are left out, as in ``fit_forest``."""
    rows = training_rows(train, [*features, key], label)
    stages, names = fit_design(rows, features, one_hot=False)
    bags = F.array(*[bag_count(F.col(key), t, seed) for t in range(trees)]).alias("bags")
    prepared = stage(PipelineModel(stages).transform(rows).select(key, label, FEATURES, bags))
    bins = max(32, largest_category(rows, stages))

    def fit(t: int) -> FlatTree:
        bag = prepared.select(label, FEATURES, F.element_at("bags", t + 1).cast("double").alias("times")).where("times > 0")
        one = RandomForestClassifier(
            featuresCol=FEATURES, labelCol=label, weightCol="times", numTrees=1, bootstrap=False, maxDepth=depth,
            maxBins=bins, featureSubsetStrategy="sqrt", seed=seed * SEEDS + t,
        )
        return FlatTree(one.fit(bag).toDebugString)

    fitted = together(train.sparkSession, [partial(fit, t) for t in range(trees)], parallel)
    return BaggedForest(stages, fitted, names, prepared, key, label)
