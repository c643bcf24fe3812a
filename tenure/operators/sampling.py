"""Repeatable splits, folds and the random baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.values import hash_uniform, key_hash
from tenure.operators.running import running_totals


def hash_split(
    df: DataFrame, key: str, fraction: float = 0.8, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Training and testing rows by a hash of the key (at most ``fraction`` trains).

    Every row is in one part; rows without a key share one hash and stay together.
    """
    group = hash_uniform(F.col(key), seed=seed)
    return df.where(group <= fraction), df.where(group > fraction)


def fold_number(key: Column, k: int = 5, seed: int = 1) -> Column:
    return F.floor(hash_uniform(key, seed=seed) * k).cast("int")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 1) -> DataFrame:
    """Add ``fold`` (0 to k - 1): the rows of each label, in hash order of a unique key, dealt in turn.

    Folds differ by at most one row for each label. The order is cut into range slices,
    so a label with most of the rows does not meet in one task.
    """
    hashed = key_hash(F.col(key), seed=seed)
    rows = df.withColumns(
        {"_order": F.concat(hashed, F.coalesce(F.col(key).cast("string"), F.lit(""))), "_one": F.lit(1).cast("long")}
    )
    ranked = running_totals(rows, "_order", ["_one"], [label])
    return ranked.select(*df.columns, (F.col("_one_before") % k).cast("int").alias("fold"))


def random_baseline(train: DataFrame, df: DataFrame, key: str, label: str, seed: int = 1) -> DataFrame:
    """Flag rows at random with the positive rate of the training rows."""
    rate = train.select(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn("flagged", hash_uniform(F.col(key), seed=seed) < rate)


def holdout(
    train_snapshot: DataFrame, later_snapshot: DataFrame, key: str,
    fraction: float = 0.8, seed: int = 1,
) -> DataFrame:
    """All rows tagged train / test / validation; the later snapshot is never split."""
    group = hash_uniform(F.col(key), seed=seed)
    tagged = train_snapshot.withColumn(
        "part", F.when(group <= fraction, F.lit("train")).otherwise("test")
    )
    return tagged.unionByName(later_snapshot.withColumn("part", F.lit("validation")))
