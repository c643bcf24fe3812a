"""Reading the source tables of a snapshot."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.sources.schemas import TABLES

Sources = Mapping[str, DataFrame]
PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def load_sources(
    spark: SparkSession,
    root: str,
    names: Iterable[str] = tuple(TABLES),
    fmt: str = "parquet",
    renames: Mapping[str, Mapping[str, str]] | None = None,
    table_options: Mapping[str, Mapping[str, str]] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """One lazy scan per table under ``root``, in the declared types.

    ``renames`` maps warehouse column names to the ones used here, per table. Text
    formats are read with the declared types; others are checked and widened (see
    ``conform``). For a warehouse use ``fmt="jdbc"`` with its connection options;
    ``root`` is then the schema name, and ``table_options`` must give every table its
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``, or the
    whole table would be read by one task.
    """
    sources = {}
    for name in names:
        own = {**options, **(table_options or {}).get(name, {})}
        new_names = dict((renames or {}).get(name, {}))
        reader = spark.read.format(fmt).options(**own)
        if fmt == "jdbc":
            absent = [o for o in PARTITIONING if o not in own]
            if absent:
                raise ValueError(f"{name} needs the options {absent}")
            df = reader.option("dbtable", f"{root}.{name}").load()
        else:
            if fmt in ("csv", "json"):
                old_names = {new: old for old, new in new_names.items()}
                reader = reader.schema(
                    T.StructType([T.StructField(old_names.get(f.name, f.name), f.dataType) for f in TABLES[name].fields])
                )
            df = reader.load(f"{root.rstrip('/')}/{name}.{fmt}")
        sources[name] = conform(df.withColumnsRenamed(new_names), name)
    return sources


def _widens(found: T.DataType, declared: T.DataType) -> bool:
    """Values of ``found`` keep their meaning as ``declared``."""
    if found == declared:
        return True
    if isinstance(declared, T.StringType):
        return isinstance(found, T.IntegralType | T.VarcharType | T.CharType)
    if isinstance(declared, T.LongType):
        return isinstance(found, T.IntegralType) or isinstance(found, T.DecimalType) and found.scale == 0
    if isinstance(declared, T.DoubleType):
        return isinstance(found, T.NumericType)
    return isinstance(declared, T.TimestampNTZType) and isinstance(found, T.DateType)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a table in their declared types, then its other columns.

    Whole numbers become text ids, dates become times at midnight. Anything else, such as
    a time with a zone or a time kept as text, is an error: comparing it with a snapshot
    date would depend on the session.
    """
    declared = TABLES[name].fields
    missing = [f.name for f in declared if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    wrong = [
        f"{f.name}: {df.schema[f.name].dataType.simpleString()} instead of {f.dataType.simpleString()}"
        for f in declared if not _widens(df.schema[f.name].dataType, f.dataType)
    ]
    if wrong:
        raise ValueError(f"{name} has other types: {'; '.join(wrong)}")
    known = {f.name for f in declared}
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared],
        *[F.col(f"`{c}`") for c in df.columns if c not in known],
    )
