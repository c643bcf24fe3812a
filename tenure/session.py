"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution is what keeps the plans safe at scale: it splits skewed
# join partitions, merges small shuffle partitions and turns a join into a
# broadcast only after it has measured the side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "tenure", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Folder of this application's staged tables, below ``spark.checkpoint.dir``.

    Without that setting they go below the warehouse directory, which all executors
    share as well; a machine-local temporary folder is never used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return f"{shared.rstrip('/')}/tenure-{spark.sparkContext.applicationId}"


def release_staging(spark: SparkSession) -> None:
    """Delete the staged tables of this application; call it when their results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Use it where several branches read the same result: the upstream plan runs
    once, lost executors cannot force a recomputation, and the planner sees the
    real size of the result when it picks join strategies.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
