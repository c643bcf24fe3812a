"""Grouping that stays balanced after a join on one of the grouping keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed_groups(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``groupBy(*keys).agg(...)`` with the keys packed into one struct.

    After a shuffled join on ``user_id``, a plain grouping by (user_id, id) reuses
    that partitioning: all rows of one busy user stay in one task, and adaptive
    execution may not split the join either. The packed key asks for its own
    shuffle. Rows are combined before it, the busy user spreads over all tasks, and
    the join below becomes splittable.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_key")).agg(*aggregates)
    return grouped.select("_key.*", *[c for c in grouped.columns if c != "_key"])


def packed_distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, combined before a shuffle that spreads them evenly."""
    return df.select(F.struct(*df.columns).alias("_key")).distinct().select("_key.*")


#: Logarithm of the words of 64 bits in the bitmap of ``may_match``.
WORD_BITS = 20


def may_match(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids``; an exact join has to follow.

    The ids' hashes are bits of a bitmap of at most 2^WORD_BITS rows, which is broadcast
    whatever the number of ids. No row with an id is lost. The semi-join goes below an
    aggregate by the key, so rows that cannot match are never shuffled.
    """
    if df.schema[key].dataType != ids.schema[id_col].dataType:  # equal values would have other hashes
        return df

    def place(c: Column) -> tuple[Column, Column]:
        hashed = F.xxhash64(c)
        return F.shiftrightunsigned(hashed, 64 - WORD_BITS), hashed.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(F.col(id_col))
    marks = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    word, bit = place(F.col(key))
    is_set = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(marks), (word == F.col("_word")) & is_set, "left_semi")
