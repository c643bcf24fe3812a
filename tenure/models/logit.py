"""Logistic regression with its coefficient table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors.exceptions.captured import UnsupportedOperationException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.models.design import FEATURES, fit_design, known, training_rows
from tenure.session import stage


#: Share of a column's variance that the terms before it must leave unexplained.
LEAST_OWN_VARIANCE = 1e-9


def independent_terms(correlations: np.ndarray, least: float = LEAST_OWN_VARIANCE) -> list[int]:
    """Terms that do not follow linearly from the intercept and the terms before them.

    A Cholesky factorisation of the correlation matrix in the order of the terms: what is left
    of a diagonal element is the term's own share of its variance. NaN marks a constant term.
    """
    kept: list[int] = []
    factor = np.zeros((0, len(correlations)))
    for j in range(len(correlations)):
        own = correlations[j, j] - factor[:, j] @ factor[:, j]
        if not np.isfinite(own) or own < least:
            continue
        row = (np.nan_to_num(correlations[j]) - factor[:, j] @ factor) / np.sqrt(own)
        factor = np.vstack([factor, row])
        kept.append(j)
    return kept


class Logit:
    """A fitted pipeline with its term names and summary statistics.

    ``kept`` are the terms of the fit; the others depend on terms before them.
    """

    def __init__(self, pipeline: PipelineModel, terms: list[str], kept: Sequence[int] | None = None):
        self.pipeline = pipeline
        self.terms = terms
        self.kept = list(range(len(terms))) if kept is None else list(kept)

    def coefficients(self) -> DataFrame:
        """Estimate, standard error, z and p per term; all NULL for a dependent term. A handful of rows."""
        model = self.pipeline.stages[-1]
        summary = model.summary
        estimates = [*model.coefficients.toArray().tolist(), model.intercept]
        try:
            tests = list(
                zip(summary.coefficientStandardErrors, summary.tValues, summary.pValues, strict=True)
            )
        except UnsupportedOperationException:  # the solver has no covariance to report
            tests = [(None, None, None)] * len(estimates)
        names = [self.terms[i] for i in self.kept] + ["(Intercept)"]
        fitted = {name: (float(estimate), *test) for name, estimate, test in zip(names, estimates, tests, strict=True)}
        rows = [(term, *fitted.get(term, (None,) * 4)) for term in [*self.terms, "(Intercept)"]]
        return _session().createDataFrame(
            rows, "term string, estimate double, std_error double, z_value double, p_value double"
        )

    def fit_statistics(self) -> DataFrame:
        s = self.pipeline.stages[-1].summary
        row = (
            float(s.nullDeviance), int(s.residualDegreeOfFreedomNull),
            float(s.deviance), int(s.residualDegreeOfFreedom), float(s.aic),
        )
        return _session().createDataFrame(
            [row],
            "null_deviance double, null_df long, residual_deviance double, residual_df long, aic double",
        )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def fit_logit(
    train: DataFrame, features: Sequence[str], label: str, scaled: Sequence[str] = ()
) -> Logit:
    """Binomial regression with a logit link, fitted by iterated least squares.

    A term that follows linearly from the terms before it (a copy, a sum of others, a constant)
    is left out of the fit and of predictions, and has no coefficient.
    """
    rows = training_rows(train, features, label)
    stages, names = fit_design(rows, features, scaled=scaled)
    # The solver reads its rows once for every iteration.
    prepared = stage(PipelineModel(stages).transform(rows).select(FEATURES, label))
    kept, inputs = list(range(len(names))), FEATURES
    if names:
        correlations = Correlation.corr(prepared, FEATURES).head()[0].toArray()
        constant = prepared.select(Summarizer.variance(F.col(FEATURES))).head()[0].toArray() == 0
        correlations[constant, constant] = np.nan
        kept = independent_terms(correlations)
    if len(kept) < len(names):
        inputs = "__independent"
        stages.append(VectorSlicer(inputCol=FEATURES, outputCol=inputs, indices=kept))
        prepared = stages[-1].transform(prepared)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol=inputs, labelCol=label,
        predictionCol="probability", maxIter=25, tol=1e-8,
    ).fit(prepared)
    return Logit(PipelineModel([*stages, model]), names, kept)


def predict_logit(model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    """All rows of ``df`` with the predicted probability; NULL where an input is missing."""
    scored = model.transform(df)
    return scored.select(*df.columns, known(F.col("probability")).alias(out))
