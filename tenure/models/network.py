"""Feed-forward network with rectified units and dropout, trained by mini-batches in Spark.

Spark's own perceptron has sigmoid units and no dropout. Here every step is a Spark sum: tasks
take the rows of the step's mini-batch (by a hash of their key), run the network forward and
backward with the current weights, and send one gradient each. The driver holds the weights,
which are as many as the model's, and their moments. Units that drop out are drawn from a hash
of row, epoch and unit, so a run is repeatable whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.models.classifiers import fit_recipe
from tenure.models.design import FEATURES, fit_design, training_rows
from tenure.session import stage

Weights = list[np.ndarray]
#: Decay of the mean and of the squares of the gradients, and what keeps the quotient finite.
MEAN_DECAY, SQUARE_DECAY, TINY = 0.9, 0.999, 1e-8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(31))


def kept_units(rows: np.ndarray, epoch: int, layer: int, units: int, dropout: float) -> np.ndarray:
    """Mask of a layer's units for each row (64-bit hashes), scaled so that its mean is one."""
    place = np.arange(1, units + 1, dtype=np.uint64) * _A + np.uint64(epoch * 64 + layer)
    drawn = _mixed(_mixed(rows.astype(np.uint64)[:, None] + place[None, :]))
    return (drawn >= np.uint64(int(dropout * 2**63) * 2)) / (1 - dropout)


def first_weights(layers: Sequence[int], seed: int) -> Weights:
    """Uniform weights in the range that keeps the spread of signals, zero biases."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(layers, layers[1:], strict=False):
        limit = np.sqrt(6 / (a + b))
        out += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
    return out


def forward(x: np.ndarray, weights: Weights, masks: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probability of each row and the signals of all layers."""
    signals = [x]
    for k in range(0, len(weights) - 2, 2):
        hidden = np.maximum(signals[-1] @ weights[k] + weights[k + 1], 0)
        signals.append(hidden * masks[k // 2] if len(masks) else hidden)
    z = np.clip((signals[-1] @ weights[-2] + weights[-1])[:, 0], -500, 500)
    return 1 / (1 + np.exp(-z)), signals


def gradient(x: np.ndarray, y: np.ndarray, weights: Weights, masks: Sequence[np.ndarray] = ()) -> tuple[float, Weights]:
    """Summed cross-entropy of the rows and its derivatives."""
    p, signals = forward(x, weights, masks)
    safe = np.clip(p, 1e-12, 1 - 1e-12)
    loss = -float(np.sum(np.where(y > 0, np.log(safe), np.log(1 - safe))))
    back, out = (p - y)[:, None], []
    for k in range(len(weights) - 2, -1, -2):
        below = signals[k // 2]
        out = [below.T @ back, back.sum(axis=0), *out]
        if k:
            back = (back @ weights[k].T) * (below > 0)
            back = back * masks[k // 2 - 1] if len(masks) else back
    return loss, out


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    edges = np.cumsum([w.size for w in like])[:-1]
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, edges), like, strict=True)]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


@dataclass
class Network:
    """Fitted preparation, weights, and the mean training loss of every epoch."""

    stages: list
    weights: Weights
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """All rows with their probability; NULL where an input is missing."""
        prepared = PipelineModel(self.stages).transform(df).select(*df.columns, vector_to_array(FEATURES).alias("__x"))
        shared, names = df.sparkSession.sparkContext.broadcast(self.weights), df.columns
        width = len(names)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(width)) if batch.num_rows else np.zeros((0, shared.value[0].shape[0]))
                known = ~np.isnan(x).any(axis=1)
                p, _ = forward(np.where(known[:, None], x, 0.0), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p, mask=~known)], names=[*names, out])

        return prepared.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def fit_network(
    train: DataFrame, features: Sequence[str], label: str, key: str, zero_based_logs: Sequence[str] = (), positive_logs: Sequence[str] = (),
    hidden: Sequence[int] = (32, 32), dropout: float = 0.1, epochs: int = 20, batches: int = 8, rate: float = 0.01, seed: int = 1,
) -> Network:
    """Rectified hidden layers with dropout, a logistic output, adaptive steps on mini-batches.

    An epoch deals the rows to ``batches`` mini-batches by a hash of a unique ``key``; each is one
    sum over the partitions. Missing inputs leave a row out of the fit.
    """
    rows = training_rows(train, [*features, key], label)
    if zero_based_logs or positive_logs:
        stages, names = fit_recipe(rows, features, zero_based_logs, positive_logs)
    else:
        stages, names = fit_design(rows, features, scale_all=True)
    place = F.xxhash64(F.col(key), F.lit(seed))
    prepared = stage(PipelineModel(stages).transform(rows).select(place.alias("row"), F.col(label).alias("y"), vector_to_array(FEATURES).alias("x")))
    weights = first_weights([len(names), *hidden, 1], seed)
    flat, mean, square = _flat(weights), 0.0, 0.0
    losses, step = [], 0
    spark = train.sparkSession
    for epoch in range(epochs):
        lost = seen = 0
        for part in range(batches):
            step += 1
            shared = spark.sparkContext.broadcast(_shaped(flat, weights))

            def sums(arrow: Iterator[pa.RecordBatch], shared=shared, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
                now, loss, n = shared.value, 0.0, 0
                total = np.zeros(sum(w.size for w in now))
                for batch in arrow:
                    if not batch.num_rows:
                        continue
                    ids, y, x = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), _matrix(batch.column(2))
                    masks = [kept_units(ids, epoch, k, units, dropout) for k, units in enumerate(hidden)] if dropout else ()
                    cost, slope = gradient(x, y, now, masks)
                    loss, n, total = loss + cost, n + len(y), total + _flat(slope)
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["loss", "n", "slope"])

            dealt = prepared.where(F.pmod(F.xxhash64("row", F.lit(epoch)), F.lit(batches)) == part)
            found = dealt.mapInArrow(sums, "loss double, n long, slope array<double>").collect()
            shared.unpersist()
            n = sum(r["n"] for r in found)
            if not n:
                continue
            # Sorted, so that the order in which tasks end does not change the sum.
            slope = np.sum(sorted(r["slope"] for r in found), axis=0) / n
            mean = MEAN_DECAY * mean + (1 - MEAN_DECAY) * slope
            square = SQUARE_DECAY * square + (1 - SQUARE_DECAY) * slope**2
            flat = flat - rate * (mean / (1 - MEAN_DECAY**step)) / (np.sqrt(square / (1 - SQUARE_DECAY**step)) + TINY)
            lost, seen = lost + sum(r["loss"] for r in found), seen + n
        losses.append(lost / seen if seen else float("nan"))
    return Network(stages, _shaped(flat, weights), losses)
