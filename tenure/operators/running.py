"""Exact running totals over a sorted column, spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.session import stage


def renamed(keys: Sequence[str]) -> list[Column]:
    """Group keys under a leading underscore, for joining totals back without ambiguity."""
    return [F.col(key).alias(f"_{key}") for key in keys]


def same_group(keys: Sequence[str]) -> Column:
    """Null-safe match of keys with their ``renamed`` form, so NULL groups find their totals."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return condition


#: Rows of a slice, in expectation; more rows make more slices.
SLICE_ROWS = 250_000


def _before(x: np.ndarray, starts: np.ndarray, held: int | float) -> np.ndarray:
    """Sum of the earlier values of each value's group; groups begin at ``starts``, and what
    stands before the first of them goes on from the sum ``held``."""
    goes_on = not len(starts) or starts[0] > 0
    edges = np.concatenate(([0] if goes_on else [], starts, [len(x)])).astype(np.int64)
    if x.dtype == np.int64:
        before = np.cumsum(x) - x
        before -= np.repeat(before[edges[:-1]], np.diff(edges))
        before[: edges[1]] += held if goes_on else 0
        return before
    before = np.empty(len(x))  # apart, so that a large sum does not blur the small ones after it
    for a, b in zip(edges, edges[1:], strict=False):
        before[a:b] = np.cumsum(np.append(held if goes_on and a == 0 else 0.0, x[a : b - 1]))
    return before


def _running(sums: Sequence[str], integral: Sequence[bool], group: str):
    """Add the totals of the rows before each one, over rows sorted by group and order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index(group)).to_numpy()
            starts = np.flatnonzero(np.concatenate(([groups[0] != last], groups[1:] != groups[:-1])))
            columns = []
            for k, name in enumerate(sums):
                x = batch.column(batch.schema.get_field_index(name)).fill_null(0).to_numpy(zero_copy_only=False)
                x = x.astype(np.int64 if integral[k] else np.float64)
                before = _before(x, starts, held[k])
                held[k] = before[-1] + x[-1]
                columns.append(pa.array(before))
            last = groups[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f"{s}_before" for s in sums]])

    return add


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add running totals per group: ``<name>_before`` over the rows that sort before this
    one, and ``<name>_total`` over all rows of the group.

    ``df`` must have one row per (group, order value). A window over a whole group would put
    that group into one task, so rows are cut into sorted slices by one range exchange,
    as many as their staged number asks for. Each task adds up its slice; what the slices
    before it hold (one small row for each slice and group) is added by a join. Rows keep
    the slice they were added up in, so both agree by construction. NULL adds nothing.
    """
    by = list(by)
    integral = [isinstance(df.schema[s].dataType, T.IntegralType) for s in sums]
    rows = stage(df)
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    cut = rows.withColumn("_group", group).repartitionByRange(slices, *by, order).sortWithinPartitions(*by, order)
    sliced = cut.withColumn("_slice", F.spark_partition_id())
    added = [T.StructField(f"{s}_before", T.LongType() if w else T.DoubleType()) for s, w in zip(sums, integral, strict=True)]
    local = stage(sliced.mapInArrow(_running(sums, integral, "_group"), T.StructType([*sliced.schema.fields, *added])))
    if slices == 1:
        # The slice number comes from the rows: a literal would leave a join without a key.
        totals = local.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"{s}_total") for s in sums])
        offsets = totals.select(*renamed(by), F.col("_slice").alias("_slice_id"), *[F.lit(0).alias(f"_{s}") for s in sums], *[f"{s}_total" for s in sums])
    else:
        earlier_slices = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = local.groupBy(*by, "_slice").agg(*[F.sum(s).alias(s) for s in sums]).select(
            *renamed(by),
            F.col("_slice").alias("_slice_id"),
            *[F.coalesce(F.sum(s).over(earlier_slices), F.lit(0)).alias(f"_{s}") for s in sums],
            *[F.sum(s).over(Window.partitionBy(*by)).alias(f"{s}_total") for s in sums],
        )
    matched = (F.col("_slice") == F.col("_slice_id")) & same_group(by)
    return local.join(offsets, matched).select(
        *df.columns,
        *[(F.col(f"{s}_before") + F.col(f"_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )
