"""Distinct counts over many overlapping windows from one pass over the rows.

The edges of all windows cut time into cells, and every window is a run of cells. A row is
read once and lands in one cell, however many windows hold it. An id that occurs in several
cells would count more than once in a window; each of its cells therefore carries the cell
before it, and counts for the windows that begin after that one. What is left per key, cell
and cell before are sums, and only those are dealt to the windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import instant


class Windows:
    """Windows ``[first, last]`` with both ends inside, each with values of its own."""

    def __init__(self, spans: Sequence[tuple[datetime, datetime]], values: Sequence[Mapping[str, Column]]) -> None:
        if len(spans) != len(values) or not spans:
            raise ValueError("every window needs its values, and there must be one")
        self.spans, self.values = list(spans), list(values)
        # (instant, False) begins a cell at the instant, (instant, True) right after it.
        self.edges = sorted({(a, False) for a, _ in spans} | {(b, True) for _, b in spans})

    def holds(self, ts: Column) -> Column:
        """The range of all windows; as a condition on a column it reaches the scan."""
        return ts.between(instant(min(a for a, _ in self.spans)), instant(max(b for _, b in self.spans)))

    def cell(self, ts: Column) -> Column:
        """Edges that ``ts`` has passed, found by halving."""

        def within(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            at, after = self.edges[middle]
            passed = ts > instant(at) if after else ts >= instant(at)
            return F.when(passed, within(middle + 1, high)).otherwise(within(low, middle))

        return within(0, len(self.edges))

    def list(self) -> Column:
        """All windows as structs of ``low`` and ``high`` cell and their values."""
        place = {edge: i + 1 for i, edge in enumerate(self.edges)}
        return F.array(
            *[
                F.struct(
                    F.lit(place[a, False]).alias("low"), F.lit(place[b, True] - 1).alias("high"),
                    *[column.alias(name) for name, column in own.items()],
                )
                for (a, b), own in zip(self.spans, self.values, strict=True)
            ]
        )


def distinct_steps(df: DataFrame, keys: Sequence[str], id_col: str, cell: str = "cell") -> DataFrame:
    """(keys, ``cell``, ``before``, ``n``): distinct ids by their cell and the one before it.

    The first shuffle is by key and id with the cells combined before it; its cell lists are at
    most as long as the list of edges. A NULL id occupies cells and counts nothing.
    """
    per_id = df.groupBy(F.struct(*keys, F.col(id_col).alias("_id")).alias("_key")).agg(F.sort_array(F.collect_set(cell)).alias("_cells"))
    stepped = per_id.select("_key", F.posexplode("_cells").alias("_at", "_cell"), "_cells")
    counted = stepped.select("_key.*", F.col("_cell").alias(cell), F.get("_cells", F.col("_at") - 1).alias("before"))
    packed = counted.groupBy(F.struct(*keys, cell, "before").alias("_key")).agg(F.count("_id").alias("n"))
    return packed.select("_key.*", "n")


def over_windows(steps: DataFrame, windows: Windows, cell: str = "cell") -> DataFrame:
    """A row for each step and window that holds its cell: ``w`` is the window, ``fresh`` the ids not counted before."""
    held = F.filter(windows.list(), lambda w: F.col(cell).between(w["low"], w["high"]))
    dealt = steps.select("*", F.explode(held).alias("w"))
    new = F.col("before").isNull() | (F.col("before") < F.col("w.low"))
    return dealt.withColumn("fresh", F.when(new, F.col("n")).otherwise(0)).drop(cell, "before", "n")
