"""Models that use one variable: the smoothed positive rate of its level or bin."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.values import right_closed_bin, right_closed_bin_of
from tenure.operators.ranking import auc_of_tallies
from tenure.operators.tally import exact_quantiles, quantile_sketches, sketched_quantiles
from tenure.session import stage

# Smoothing weight, decile steps, and the extra lowest cut point.
SMOOTHING = 1.0e-3
DECILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LOWEST_CUT = -1.0


def _rate(level: Column, pos: Column, n: Column, prior: Column) -> Column:
    """Smoothed rate of a level; the rate among missing values is not smoothed."""
    return F.when(level.isNull(), F.try_divide(pos, n)).otherwise(
        (pos + SMOOTHING * prior) / (n + SMOOTHING)
    )


def fit_rate_table(train: DataFrame, variable: str, label: str) -> DataFrame:
    """Columns ``level``, ``rate`` and ``prior``; one row per level seen in training.

    The table is the fitted model, so it is staged: applying it never refits, and a
    frequent level can be split in the join because both sides are plain scans.
    """
    levels = train.groupBy(F.col(variable).alias("level")).agg(
        F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n")
    )
    prior = levels.select(F.sum("pos") / F.sum("n")).scalar()
    rated = levels.withColumn("prior", prior)
    rate = _rate(F.col("level"), F.col("pos"), F.col("n"), F.col("prior"))
    return stage(rated.select("level", rate.alias("rate"), "prior"))


def apply_rate_table(
    df: DataFrame, table: DataFrame, variable: str, out: str = "prediction"
) -> DataFrame:
    """Look every row up by value; values not seen in training get the prior rate."""
    prior = table.select(F.max("prior")).scalar()
    rates = table.select("level", "rate")
    return (
        df.join(rates, F.col(variable).eqNullSafe(F.col("level")), "left")
        .withColumn(out, F.coalesce("rate", prior))
        .drop("level", "rate")
    )


def _cuts(quantiles: Column) -> Column:
    known = F.filter(quantiles, lambda q: q.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(LOWEST_CUT)), known)))


def decile_cuts(train: DataFrame, variable: str) -> list[float]:
    """The distinct deciles of the variable with the lowest cut added: at most 12 numbers."""
    quantiles = exact_quantiles(train, variable, DECILES)
    return quantiles.select(_cuts(F.col("quantiles"))).first()[0]


def binned(df: DataFrame, cuts: Sequence[float], variable: str, out: str = "bin") -> DataFrame:
    return df.withColumn(out, right_closed_bin(F.col(variable).cast("double"), cuts))


def fit_binned_rate(
    train: DataFrame, variable: str, label: str
) -> tuple[list[float], DataFrame]:
    """Cut points and the rate table over their bins."""
    cuts = decile_cuts(train, variable)
    return cuts, fit_rate_table(binned(train, cuts, variable), "bin", label)


def apply_binned_rate(
    df: DataFrame, cuts: Sequence[float], table: DataFrame, variable: str, out: str = "prediction"
) -> DataFrame:
    return apply_rate_table(binned(df, cuts, variable), table, "bin", out).drop("bin")


PARTS = ("train", "test")
COUNTS = [f"{part}_{count}" for part in PARTS for count in ("pos", "n")]


def _long_tallies(df: DataFrame, variables: Sequence[str], kind: str, label: str, is_train: str) -> DataFrame:
    """Class counts per variable and value, for training and testing rows in one pass.

    Categories are counted for their combinations first, so that few rows are copied once
    for each variable; numbers, whose combinations hardly repeat, are copied directly.
    """
    y, train = F.col(label).cast("int").alias("_y"), F.col(is_train).alias("_train")
    if kind == "string":
        rows = df.select(y, train, *variables).groupBy("_y", "_train", *variables).agg(F.count("*").alias("_n"))
    else:
        rows = df.select(y, train, *variables, F.lit(1).cast("long").alias("_n"))
    cells = [F.struct(F.lit(v).alias("variable"), F.col(v).cast(kind).alias("value")) for v in variables]
    long = rows.select("_y", "_train", "_n", F.inline(F.array(*cells)))
    of_part = {"train": F.col("_train"), "test": ~F.col("_train")}
    counts = []
    for part, belongs in of_part.items():
        counts.append(F.coalesce(F.sum(F.when(belongs, F.col("_y") * F.col("_n"))), F.lit(0)).alias(f"{part}_pos"))
        counts.append(F.coalesce(F.sum(F.when(belongs, F.col("_n"))), F.lit(0)).alias(f"{part}_n"))
    return stage(long.groupBy("variable", "value").agg(*counts))


def _sketched_bins(df: DataFrame, variables: Sequence[str], label: str, is_train: str) -> DataFrame:
    """Class counts per variable and bin, with cuts from sketches: two passes that copy and shuffle no row.

    A task counts the bins of all variables in arrays and sends a few rows for each variable.
    """
    train = df.where(is_train)
    deciles = sketched_quantiles(quantile_sketches(train, variables), DECILES).select("variable", _cuts(F.col("quantiles")).alias("cuts"))
    cuts = {r["variable"]: np.array(r["cuts"] or [LOWEST_CUT]) for r in deciles.collect()}  # at most 12 numbers for each variable

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By variable, bin (0: none), part and class.
        totals = np.zeros((len(variables), len(DECILES) + 2, 2, 2), np.int64)
        for batch in batches:
            y, part = (batch.column(i).to_numpy() for i in range(2))
            for k, variable in enumerate(variables):
                x = batch.column(k + 2).to_numpy(zero_copy_only=False)
                bins = np.searchsorted(cuts[variable], x, side="left")
                bins[~((x > cuts[variable][0]) & (x <= cuts[variable][-1]))] = 0
                np.add.at(totals[k], (bins, part, y), 1)
        k, bins, part, y = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([variables[i] for i in k], pa.string()), pa.array(bins), pa.array(part), pa.array(y), pa.array(totals[k, bins, part, y])],
            names=["variable", "bin", "part", "y", "n"],
        )

    x = [F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(variables)]
    rows = df.where(F.col(label).isNotNull() & F.col(is_train).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(is_train).cast("int").alias("part"), *x)
    counted = rows.mapInArrow(count, "variable string, bin long, part long, y long, n long")
    of = {f"{part}_{what}": (F.col("part") == i) & ((F.col("y") == 1) if what == "pos" else F.lit(True)) for i, part in ((1, "train"), (0, "test")) for what in ("pos", "n")}
    value = F.when(F.col("bin") > 0, F.col("bin")).cast("string").alias("value")
    return stage(counted.groupBy("variable", value).agg(*[F.coalesce(F.sum(F.when(of[c], F.col("n"))), F.lit(0)).alias(c) for c in COUNTS]))


def _aucs(levels: DataFrame, prior: Column) -> DataFrame:
    """Train and test AUC per variable from level tallies; each level is one score."""
    rate = _rate(F.col("value"), F.col("train_pos"), F.col("train_n"), prior)
    parts = [
        F.struct(F.lit(p).alias("part"), F.col(f"{p}_pos").alias("pos"), F.col(f"{p}_n").alias("n"))
        for p in PARTS
    ]
    tallies = (
        levels.select(
            "variable",
            F.when(F.col("train_n") > 0, rate).otherwise(prior).alias("score"),
            F.inline(F.array(*parts)),
        )
        .where("n > 0")
        .groupBy("variable", "part", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    )
    return auc_of_tallies(tallies, ["variable", "part"])


def single_variable_report(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    label: str,
    is_train: str = "is_train",
    exact: bool = True,
) -> DataFrame:
    """Train and test AUC of the one-variable model of every listed column.

    Rows are collapsed to counts per (variable, value) once. Cut points, rates and AUC are
    then all computed from those counts, for all variables together, instead of one
    model and two scoring passes per variable. With ``exact=False`` the cut points of numbers
    come from quantile sketches, which spares a copy of every row for each variable.
    """
    parts, one = [], None
    if categorical:
        one = _long_tallies(df, categorical, "string", label, is_train)
        parts.append(one.select("variable", "value", *COUNTS))
    if numeric and not exact:
        bins = _sketched_bins(df, list(numeric), label, is_train)
        one = one if one is not None else bins
        parts.append(bins.select("variable", "value", *COUNTS))
    elif numeric:
        numbers = _long_tallies(df, numeric, "double", label, is_train)
        one = one if one is not None else numbers
        cuts = exact_quantiles(
            numbers.where("train_n > 0"), "value", DECILES, ["variable"], "train_n"
        ).select(F.col("variable").alias("_variable"), _cuts(F.col("quantiles")).alias("cuts"))
        # One row per variable, so the broadcast is bounded by the number of columns.
        bins = (
            numbers.join(F.broadcast(cuts), F.col("variable") == F.col("_variable"), "left")
            .select("variable", right_closed_bin_of(F.col("value"), F.col("cuts")).cast("string").alias("value"), *COUNTS)
            .groupBy("variable", "value")
            .agg(*[F.sum(c).alias(c) for c in COUNTS])
        )
        parts.append(bins.select("variable", "value", *COUNTS))
    first = [*categorical, *numeric][0]
    prior = one.where(F.col("variable") == first).select(F.sum("train_pos") / F.sum("train_n")).scalar()
    levels = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _aucs(levels, prior).groupBy("variable").agg(
        *[F.max(F.when(F.col("part") == p, F.col("auc"))).alias(f"{p}_auc") for p in PARTS]
    )
