"""Grid completion, pivots, one-hot columns and window spans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.running import running_totals
from tenure.session import stage

Levels = Mapping[str, Sequence[object]]


def trim_edge_weeks(weekly: DataFrame, week: str = "week") -> DataFrame:
    """Drop the first and the last week found anywhere in the data (both are partial)."""
    first = weekly.select(F.min(week)).scalar()
    last = weekly.select(F.max(week)).scalar()
    return weekly.where((F.col(week) != first) & (F.col(week) != last))


def complete_grid(counts: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """One row per key and step present in the data; absent cells get 0.

    ``step`` must be bounded by the lookback window (a week or a day of it), which
    makes the list of steps a small constant array. Each key's few observed steps
    are folded into a map and looked up, so the grid needs a single shuffle by key
    and neither a cross join nor a join back.
    """
    steps = counts.select(F.sort_array(F.collect_set(step))).scalar()
    observed = (
        counts.groupBy(key, step)
        .agg(F.sum(value).alias(value))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct(step, value))).alias("_cells"))
    )
    return observed.select(key, "_cells", F.explode(steps).alias(step)).select(
        key, step, F.coalesce(F.col("_cells")[F.col(step)], F.lit(0)).alias(value)
    )


def _label(value: object) -> str:
    """Column-name form of a pivot value: -1 becomes m1."""
    return str(value).replace("-", "m")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column without NULL, as a staged table.

    ``pivot_measures`` takes the values as an explicit list, since each becomes a column.
    """
    return stage(df.select(column).where(F.col(column).isNotNull()).distinct())


def pivot_measures(
    df: DataFrame,
    key: str,
    column: str,
    values: Sequence[object],
    measures: Mapping[str, str],
) -> DataFrame:
    """Long to wide: one summed column per measure and value, 0 where no row matches.

    ``measures`` maps a measure to the prefix of its columns.
    """
    cells = [
        F.sum(F.when(F.col(column) == value, F.col(measure)).otherwise(0)).alias(
            f"{prefix}{_label(value)}"
        )
        for measure, prefix in measures.items()
        for value in values
    ]
    return df.groupBy(key).agg(*cells)


def week_columns(
    weekly: DataFrame, numbers: Sequence[int], measure: str = "number_of_updates"
) -> DataFrame:
    """``week_<n>_updates`` columns for the complete weeks (the partial week -1 is left out)."""
    kept = [n for n in numbers if n >= 0]
    wide = pivot_measures(weekly, "user_id", "week_number", kept, {measure: "week_"})
    return wide.withColumnsRenamed({f"week_{n}": f"week_{n}_updates" for n in kept})


def span_counts(wide: DataFrame, columns: Sequence[str], prefix: str = "span_") -> DataFrame:
    """Totals of every contiguous run of columns, as differences of running totals."""
    cells: list[Column] = [F.coalesce(F.col(c), F.lit(0)) for c in columns]
    running = [f"_upto_{i}" for i in range(len(columns))]
    totals = dict(zip(running, accumulate(cells), strict=True))
    other = [c for c in wide.columns if c not in set(columns)]
    spans = [
        (F.col(running[j]) - (F.col(running[i - 1]) if i else F.lit(0))).alias(f"{prefix}{i}_{j}")
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return wide.select(*other, *[c.alias(n) for n, c in totals.items()]).select(*other, *spans)


def find_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels of several text columns as a staged table, however many there are.

    Columns ``name``, ``level`` (not NULL) and ``position``, the number of the level in
    the order of its column, from 0.
    """
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns]
    found = df.select(F.inline(F.array(*cells))).where("level is not null").distinct()
    counted = running_totals(found.withColumn("one", F.lit(1).cast("long")), "level", ["one"], ["name"])
    return stage(counted.select("name", "level", F.col("one_before").alias("position")))


def level_lists(levels: DataFrame) -> dict[str, list[str]]:
    """The table of ``find_levels`` as lists for ``one_hot``.

    Every level becomes a column there, so this is for the few columns that are wanted
    wide; ``encode_levels`` is the form for columns with many levels.
    """
    found: dict[str, list[str]] = {}
    for row in levels.orderBy("name", "position").collect():
        found.setdefault(row["name"], []).append(row["level"])
    return found


def encode_levels(df: DataFrame, levels: DataFrame, columns: Sequence[str], out: str = "slots") -> DataFrame:
    """Sparse indicator form: the slots that are 1, one for each column with a known level.

    The slots of the columns follow each other in the given order. Levels are looked up by
    joins with the staged table, so their number does not matter.
    """
    coded, first = df, F.lit(0).cast("long")
    for i, name in enumerate(columns):
        own = levels.where(F.col("name") == name).select(F.col("level").alias(f"_level_{i}"), F.col("position").alias(f"_position_{i}"))
        coded = coded.join(own, F.col(name) == F.col(f"_level_{i}"), "left").withColumn(f"_slot_{i}", F.col(f"_position_{i}") + first)
        first = first + levels.where(F.col("name") == name).select(F.count("*")).scalar()
    slots = F.array(*[F.col(f"_slot_{i}") for i in range(len(columns))])
    return coded.select(*df.columns, F.filter(slots, lambda s: s.isNotNull()).alias(out))


def one_hot(df: DataFrame, levels: Levels) -> DataFrame:
    """Replace each listed column by 0/1 columns for its fixed levels.

    A missing or unlisted value gives zeros everywhere, so applying the training
    levels to a later snapshot always yields the training columns.
    """
    indicators = [
        F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c, values in levels.items()
        for level in values
    ]
    return df.select(*[c for c in df.columns if c not in levels], *indicators)


def align_columns(df: DataFrame, template: Sequence[str]) -> DataFrame:
    """Exactly the template's columns in its order; absent ones are 0."""
    present = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in present else F.lit(0).alias(c) for c in template]
    )
