"""Radial kernel by random Fourier features, for linear solvers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.values import hash_of_text


def uniform(seed: int, *place: int) -> float:
    """Number in (0, 1) that follows from a seed and a place; the same rule as the hashes of row keys."""
    return (int(hash_of_text(f"{seed}:{'.'.join(map(str, place))}")[:8], 16) + 0.5) / 2**32


def frequencies(seed: int, inputs: int, size: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions with variance 2 gamma (one column for each feature) and uniform phases."""
    w = np.empty((inputs, size))
    for i in range(inputs):
        for j in range(size):
            radius, turn = (uniform(seed, i, j, k) for k in range(2))
            w[i, j] = math.sqrt(-4 * gamma * math.log(radius)) * math.cos(2 * math.pi * turn)
    return w, np.array([2 * math.pi * uniform(seed, j) for j in range(size)])


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Features sqrt(2 / size) cos(w x + b), whose products estimate exp(-gamma |x - y|^2).

    Directions and phases follow from the seed, so the stage holds four numbers however many
    features it makes, and loads anywhere.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "length of the input vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "inverse width of the kernel", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, inputs=1, gamma=1.0, seed=1):  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(size=256, inputs=1, gamma=1.0, seed=1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = self.getOrDefault(self.size)
        w, b = frequencies(self.getSeed(), self.getOrDefault(self.inputs), size, self.getOrDefault(self.gamma))
        scale = math.sqrt(2 / size)

        @F.pandas_udf("array<double>")
        def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                made = scale * np.cos(np.stack(x.to_numpy()) @ w + b) if len(x) else np.zeros((0, size))
                yield pd.Series(list(made))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(self.getInputCol()))))
