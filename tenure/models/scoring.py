"""The scoring job: dataset, model, predictions and the two upserted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, instant
from tenure.models.features import LOGIT_SCORING
from tenure.models.logit import fit_logit, predict_logit
from tenure.plans.dataset import clean_scoring_dataset, scoring_dataset
from tenure.session import stage
from tenure.sources.files import upsert_parquet
from tenure.sources.tables import Sources

# Name and version written with every prediction.
MODEL_NAME = "logistic_regression"
MODEL_VERSION = "0.1"


def get_model(
    path: str | None, fit: Callable[[], PipelineModel], save_to: str | None = None
) -> PipelineModel:
    """Load a saved pipeline, or fit one (and save it) when no path is given."""
    if path is not None:
        return PipelineModel.load(path)
    model = fit()
    if save_to is not None:
        model.write().save(save_to)
    return model


def score(
    model: PipelineModel, df: DataFrame, run_ts: Instant, name: str = MODEL_NAME,
    version: str = MODEL_VERSION, key: str = "subscription_id",
) -> DataFrame:
    """Rounded probability per subscription with run time, model and a prediction id."""
    probability = F.round("pred", 2)
    parts = [F.col(key), probability, instant(run_ts), F.lit(name), F.lit(version)]
    return predict_logit(model, df).select(
        key,
        probability.alias("churn_probability"),
        instant(run_ts).alias("created_at"),
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.concat(*[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts]).alias("id"),
    )


def scoring_batch(src: Sources, t: Instant, usage_t: Instant | None = None) -> DataFrame:
    """The staged rows of the job. A missing recency is 0, as the regression needs complete rows."""
    return stage(clean_scoring_dataset(scoring_dataset(src, t, usage_t, fill_recency=True), t))


def run_scoring(
    spark: SparkSession,
    src: Sources,
    t: Instant,
    run_ts: Instant,
    features_table: tuple[str | None, str],
    predictions_table: tuple[str | None, str],
    model_path: str | None = None,
    save_model_to: str | None = None,
    usage_t: Instant | None = None,
    batch: DataFrame | None = None,
) -> DataFrame:
    """Build the dataset, fit or load the model, score, and upsert both tables.

    Each table is given as (current path or None, new path). A run that repeats a batch
    takes its ``scoring_batch`` as it was built. Predictions are computed once, for the
    check of their keys and for the upsert.
    """
    data = scoring_batch(src, t, usage_t) if batch is None else batch
    upsert_parquet(
        spark, features_table[0],
        data.drop("did_churn").withColumn("features_created_at", instant(run_ts)),
        ["subscription_id"], features_table[1],
    )
    model = get_model(
        model_path, lambda: fit_logit(data, LOGIT_SCORING, "did_churn").pipeline, save_model_to
    )
    predictions = stage(score(model, data, run_ts))
    return upsert_parquet(spark, predictions_table[0], predictions, ["id"], predictions_table[1])
