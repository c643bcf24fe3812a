"""CSV exchange, clustered tables, keyed upserts and uniqueness checks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.session import stage


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, missing: str = "NA"
) -> DataFrame:
    """CSV with a header; gzip or bzip2 is recognised by file extension.

    Without a schema the types are inferred, which costs an extra pass.
    """
    reader = spark.read.option("header", True).option("nullValue", missing)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "NA", compression: str = "none") -> None:
    """One CSV part per partition; the URI decides between file system and object store."""
    df.write.option("header", True).option("nullValue", missing).csv(
        path, compression=compression
    )


def materialize(df: DataFrame, path: str, cluster_by: str, partitions: int | None = None) -> None:
    """Write a table clustered and sorted by a key, so key lookups prune row groups.

    Rebalancing (rather than a plain hash repartition) lets adaptive execution
    cut a key that holds much of the table into several files; ``partitions`` is the
    number of tasks before that.
    """
    target = df.hint("rebalance", *([partitions] if partitions else []), cluster_by)
    target.sortWithinPartitions(cluster_by).write.parquet(path)


def materialize_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Catalog table bucketed and sorted by a key: joins on that key need no shuffle.

    Rebalancing first keeps the number of files near the number of buckets. A bucket is
    read by one task, so prefer ``materialize`` where a single key may dominate.
    """
    df.hint("rebalance", key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def unique_batch(updates: DataFrame, keys: list[str], latest_by: str | None = None) -> DataFrame:
    """One row per key, a NULL key being a key of its own.

    With ``latest_by`` the row with the largest value of that column stays (values must
    differ within a key); without it a repeated key is an error.
    """
    if latest_by is None:
        return require_unique(updates, keys)
    row = F.struct(*updates.columns)
    return updates.groupBy(*keys).agg(F.max_by(row, F.col(latest_by)).alias("_row")).select("_row.*")


def upsert(
    target: DataFrame, updates: DataFrame, keys: list[str], latest_by: str | None = None
) -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with the same key; others are added.

    Keys match null-safely and the batch holds one row per key (see ``unique_batch``), so
    repeating a batch changes nothing.
    """
    batch = unique_batch(updates, keys, latest_by)
    replaced = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return target.join(replaced, same, "left_anti").unionByName(batch, allowMissingColumns=True)


def upsert_parquet(
    spark: SparkSession, current: str | None, updates: DataFrame, keys: list[str], target: str
) -> DataFrame:
    """Write the upserted table to a new path; readers move over once it is complete."""
    merged = unique_batch(updates, keys) if current is None else upsert(spark.read.parquet(current), updates, keys)
    merged.write.parquet(target)
    return spark.read.parquet(target)


def upsert_partitions(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition_by: str
) -> DataFrame:
    """Upsert into a partitioned table, rewriting only the partitions that the batch touches.

    ``partition_by`` must follow from the keys, so that a row never changes its partition.
    NULL is a partition like any other; an empty text is stored in it, since a folder
    name cannot tell the two apart. The merged partitions are staged before the old ones are
    overwritten in place: a failed job can be run again, but a reader must wait until the
    call returns (``upsert_parquet`` writes a new path instead).
    """
    if isinstance(updates.schema[partition_by].dataType, T.StringType):
        updates = updates.withColumn(partition_by, F.nullif(F.col(partition_by), F.lit("")))
    target = spark.read.parquet(path)
    touched = updates.select(F.col(partition_by).cast(target.schema[partition_by].dataType).alias("_touched")).distinct()
    affected = target.join(touched, F.col(partition_by).eqNullSafe(F.col("_touched")), "left_semi")
    merged = stage(upsert(affected, updates, keys))
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition_by).parquet(path)
    return spark.read.parquet(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"rows are not unique on {keys}")
    return df
