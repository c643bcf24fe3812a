"""Categories with any number of levels as numbers: cross-fitted rates of the label.

A level becomes the smoothed positive rate of its training rows. Rows of the training set take
the rate of the other folds, so that a row's own label never enters its inputs. Levels live in
a staged table and are looked up by joins; the driver holds none of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.models.classifiers import fit_forest, predict_classifier
from tenure.operators.grouping import packed_groups
from tenure.operators.sampling import fold_number
from tenure.session import stage

FOLDS, PRIOR_ROWS = 5, 10.0


def _of(column: str) -> str:
    return f"{column}__rate"


@dataclass
class TargetStats:
    """Level table (``name``, ``level``, ``n``, ``pos`` and both by fold), the totals of all rows, and the settings."""

    levels: DataFrame
    totals: DataFrame
    columns: list[str]
    key: str
    folds: int
    prior_rows: float
    seed: int

    def encode(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Replace every column by its rate (``<column>__rate``).

        With ``training`` the rows are those of the fit and take the rates of the other folds.
        NULL is a level of its own; a level that the fit has not seen takes the overall rate.
        """
        total = self.totals.select(F.struct("n", "pos", "by_fold")).scalar()
        fold = fold_number(F.col(self.key), self.folds, self.seed)
        out = df.withColumn("__fold", fold if training else F.lit(None).cast("int"))
        for i, column in enumerate(self.columns):
            own = self.levels.where(F.col("name") == column).select(
                F.col("level").alias(f"__level{i}"), F.struct("n", "pos", "by_fold").alias(f"__stats{i}")
            )
            out = out.join(own, F.col(column).cast("string").eqNullSafe(F.col(f"__level{i}")), "left").drop(f"__level{i}")
        rates = {_of(c): self._rate(F.col(f"__stats{i}"), total) for i, c in enumerate(self.columns)}
        return out.withColumns(rates).drop("__fold", *self.columns, *[f"__stats{i}" for i in range(len(self.columns))])

    def _rate(self, stats: Column, total: Column) -> Column:
        def outside(of: Column, what: str) -> Column:
            """Rows, or positive ones, of the other folds; of all folds where no fold is left out."""
            held = F.element_at(of.getField("by_fold"), F.col("__fold")).getField(what)
            return F.coalesce(of.getField(what), F.lit(0)) - F.coalesce(held, F.lit(0))

        prior = F.try_divide(outside(total, "pos"), outside(total, "n"))
        return (outside(stats, "pos") + self.prior_rows * prior) / (outside(stats, "n") + F.lit(self.prior_rows))


def fit_target_stats(
    train: DataFrame, columns: Sequence[str], label: str, key: str, folds: int = FOLDS, prior_rows: float = PRIOR_ROWS, seed: int = 1
) -> TargetStats:
    """Rates of every level of the columns by fold of a unique ``key``, smoothed towards the overall rate.

    Rows without a label do not count. All columns are counted in one pass, combined before the
    shuffle; a level's entry has one part for each fold.
    """
    fold = fold_number(F.col(key), folds, seed)
    levels = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns])
    rows = train.where(F.col(label).isNotNull()).select(
        fold.alias("fold"), F.col(label).cast("int").alias("y"), F.explode(levels).alias("l")
    ).select("fold", "y", "l.*")
    counted = packed_groups(rows, ["name", "level", "fold"], F.count("*").alias("n"), F.sum("y").alias("pos"))
    parts = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "pos")))).alias("by_fold")
    table = stage(counted.groupBy("name", "level").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), parts))
    everything = table.where(F.col("name") == columns[0]).select(F.explode("by_fold").alias("fold", "s"))
    per_fold = everything.groupBy("fold").agg(F.sum("s.n").alias("n"), F.sum("s.pos").alias("pos"))
    totals = stage(per_fold.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), parts))
    return TargetStats(table, totals, list(columns), key, folds, prior_rows, seed)


def fit_forest_on_rates(
    train: DataFrame, features: Sequence[str], label: str, key: str, by_rate: Sequence[str], trees: int = 100, depth: int = 8, seed: int = 1
) -> tuple[TargetStats, PipelineModel]:
    """Forest in which the ``by_rate`` features, of any number of levels, enter as cross-fitted rates."""
    rows = stage(train.select(*dict.fromkeys([key, label, *features])))
    stats = fit_target_stats(rows, by_rate, label, key, seed=seed)
    inputs = [_of(f) if f in by_rate else f for f in features]
    return stats, fit_forest(stats.encode(rows, training=True), inputs, label, trees, depth, seed)


def predict_on_rates(stats: TargetStats, model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    """All rows of ``df`` with their score; NULL where another input is missing."""
    kept = [F.col(c).alias(f"__own_{c}") for c in stats.columns]
    scored = predict_classifier(model, stats.encode(df.select("*", *kept)), out)
    own = {f"__own_{c}": c for c in stats.columns}
    return scored.withColumnsRenamed(own).select(*df.columns, out)
