"""Column-list operations: star-except, ranges, names, missing values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def star_except(df: DataFrame, dropped: Iterable[str]) -> list[Column]:
    hidden = set(dropped)
    return [df[c] for c in df.columns if c not in hidden]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop the columns from ``first`` to ``last``, both included."""
    names = df.columns
    return df.drop(*names[names.index(first) : names.index(last) + 1])


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names with runs of other characters as one underscore; repeats numbered."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = re.sub(r"[^a-z0-9]+", "_", raw.lower())
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        names.append(f"{name}_{repeat}" if repeat else name)
    return df.toDF(*names)


def fill_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing numbers become 0 and missing booleans false; text is left alone."""
    chosen = set(df.columns if columns is None else columns)
    fills: Mapping[str, object] = {
        f.name: False if isinstance(f.dataType, T.BooleanType) else 0
        for f in df.schema.fields
        if f.name in chosen and isinstance(f.dataType, T.NumericType | T.BooleanType)
    }
    return df.fillna(dict(fills)) if fills else df
