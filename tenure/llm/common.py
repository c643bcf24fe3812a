"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the text contracts; bytes.strip() and bytes.split() use the same set.
WHITE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A missing identifier sorts after all others.
NO_ID = 2**63 - 1


def col(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *produced: str) -> list[str]:
    """Columns of ``df`` that an operator passes on: all but those whose name it produces."""
    taken = {name.lower() for name in produced}
    return [c for c in df.columns if c.lower() not in taken]


def extended(df: DataFrame, names: Iterable[str], ddl: str) -> T.StructType:
    """Schema of the named columns of ``df`` followed by the fields of ``ddl``."""
    added = T._parse_datatype_string(ddl)
    return T.StructType([*(df.schema[n] for n in names), *added.fields])


def fold_is_held_out(id_name: str, folds: int = 5) -> Column:
    """Rows of the held-out fold: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(col(id_name).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes (in place on a copy)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
