import pytest
from pyspark.sql import functions as F

from tenure.plans.dataset import churn_dataset
from tenure.sources.tables import load_sources
from verification import binding as b


def test_tables_read_from_files_give_the_same_dataset(spark, tmp_path):
    direct = b.sources(spark, "/root/testdata/sf0.001")
    for name in direct:
        df = direct[name].withColumnsRenamed({"was_sent_with_product": "sent_by_us"})
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_sources(
        spark, str(tmp_path), renames={"updates": {"sent_by_us": "was_sent_with_product"}}
    )
    assert set(loaded) == set(direct)
    read, given = (churn_dataset(src, b.T, b.T_USAGE) for src in (loaded, direct))
    assert read.columns == given.columns
    given = given.select(*[F.col(c).cast(read.schema[c].dataType).alias(c) for c in given.columns])
    assert read.schema["subscription_id"].dataType.simpleString() == "string"
    assert read.exceptAll(given).isEmpty() and given.exceptAll(read).isEmpty()
    with pytest.raises(ValueError, match="was_sent_with_product"):
        load_sources(spark, str(tmp_path), names=["updates"])


def test_other_types_and_unpartitioned_reads_are_errors(spark, tmp_path):
    b.sources(spark, "/root/testdata/sf0.001")["updates"].withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(
        str(tmp_path / "updates.parquet")
    )
    with pytest.raises(ValueError, match="created_at: timestamp instead of timestamp_ntz"):
        load_sources(spark, str(tmp_path), names=["updates"])
    with pytest.raises(ValueError, match="partitionColumn"):
        load_sources(spark, "exports", names=["updates"], fmt="jdbc", url="jdbc:none")


def test_text_files_are_read_in_the_declared_types(spark, tmp_path):
    facts = b.sources(spark, "/root/testdata/sf0.001")["user_team_member_facts"]
    facts.withColumnRenamed("user_id", "account").write.option("header", True).csv(str(tmp_path / "user_team_member_facts.csv"))
    read = load_sources(
        spark, str(tmp_path), names=["user_team_member_facts"], fmt="csv",
        renames={"user_team_member_facts": {"account": "user_id"}}, header="true",
    )["user_team_member_facts"]
    assert dict(read.dtypes) == {"user_id": "string", "number_of_team_members": "bigint"}
    assert read.count() == facts.count()
