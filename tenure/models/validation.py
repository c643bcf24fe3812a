"""Preparing exported files for a model and validating it on a later snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.values import spelled_flag
from tenure.models.features import EXPORT_DROPPED, EXPORT_FLAGS
from tenure.operators.columns import fill_missing
from tenure.operators.ranking import auc, threshold_metrics
from tenure.operators.reshape import Levels, align_columns, one_hot


def prepare_export(
    df: DataFrame,
    levels: Levels,
    dropped: Sequence[str] = tuple(EXPORT_DROPPED),
    flags: Sequence[str] = tuple(EXPORT_FLAGS),
    spelling: tuple[str, str] = ("t", "f"),
) -> DataFrame:
    """Indicators for the categories, trial flag, real booleans, zeros for missing numbers.

    ``levels`` lists the indicators of each category (``find_levels`` and ``level_lists``
    on the training file); a later file takes the same lists, so both have one layout. The
    defaults fit the exported training file; the flat feature file spells its flags
    ``Yes`` / ``No`` and has its own lists.
    """
    present = set(df.columns)
    encoded = one_hot(df, levels)
    if "trial_start_at" in present:
        encoded = encoded.withColumn("trialed", F.col("trial_start_at").isNotNull())
    read = {
        c: spelled_flag(F.col(c), *spelling)
        for c in flags
        if c in present and isinstance(df.schema[c].dataType, T.StringType)
    }
    return fill_missing(encoded.withColumns(read).drop(*dropped))


def train_and_validation(
    train: DataFrame, validation: DataFrame, levels: Levels
) -> tuple[DataFrame, DataFrame]:
    """Both files prepared with the same levels and in the training column order."""
    prepared = prepare_export(train, levels)
    return prepared, align_columns(prepare_export(validation, levels), prepared.columns)


def validate(
    scored: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """AUC, confusion counts, precision, recall and enrichment of scored rows."""
    metrics = threshold_metrics(scored, score, label, threshold, by)
    area = auc(scored, score, label, by)
    if by:
        return metrics.join(area, list(by))
    return metrics.withColumn("auc", area.scalar())
