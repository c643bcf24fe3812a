"""Quality of a score against a 0/1 label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.running import running_totals


def is_number(x: Column) -> Column:
    """Neither NULL nor NaN."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def score_tallies(
    df: DataFrame, score: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score. Rows without score (NULL or NaN) or label are ignored."""
    positive = F.col(label).cast("int")
    return (
        df.where(is_number(F.col(score)) & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )


def auc_of_tallies(tallies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL if a class is missing."""
    ranked = running_totals(tallies, "score", ["neg"], by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return auc_of_tallies(score_tallies(df, score, label, by), by)


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positive rate when everything at or above a score is flagged.

    The row without a threshold is the start of the curve, where nothing is flagged.
    """
    ranked = running_totals(score_tallies(df, score, label), "score", ["pos", "neg"])

    def rate(name: str) -> Column:
        return F.try_divide(F.col(f"{name}_total") - F.col(f"{name}_before"), F.col(f"{name}_total"))

    points = ranked.select(
        F.col("score").alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr")
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"),
        F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"),
    )
    return points.unionByName(start)


def confusion(
    df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of the four outcomes when scores of at least ``threshold`` are flagged.

    Rows without a score (NULL or NaN) count nowhere.
    """
    flagged, actual = F.col(score) >= threshold, F.col(label).cast("boolean")

    def cell(condition: Column) -> Column:
        return F.count_if(condition).cast("long")

    return df.where(is_number(F.col(score))).groupBy(*by).agg(
        cell(~flagged & ~actual).alias("tn"),
        cell(~flagged & actual).alias("fn"),
        cell(flagged & ~actual).alias("fp"),
        cell(flagged & actual).alias("tp"),
    )


def threshold_metrics(
    df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and enrichment over the positive rate of the evaluated rows."""
    cells = confusion(df, score, label, threshold, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.try_divide(tp, tp + fp)
    base_rate = F.try_divide(tp + fn, tp + fp + fn + tn)
    return cells.select(
        "*",
        precision.alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(precision, base_rate).alias("enrichment"),
    )
