"""Plans and results when one key holds a large part of the rows."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tenure.plans.activity import action_features, update_growth, weekly_update_features
from tenure.plans.cohort import eligible_subscriptions, subscription_cohort
from tenure.session import stage, staging_root
from tenure.sources import files
from verification import binding as b

SF = "/root/testdata/sf0.01"


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts, and a skew limit small enough for test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def hot_user(spark):
    """Sixty thousand events, two thirds of them by one user."""
    user = F.when(F.col("id") % 3 != 0, 7).otherwise(F.hash("id") % 500)
    created = F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 40)
    events = spark.range(60_000).repartition(6).select(
        "id", user.alias("user_id"), created.alias("created_at"),
        F.when(F.col("id") % 5 == 0, "dashboard settings billing viewed").otherwise("other").alias("full_scope"),
        F.lit("Extension").alias("client_type"), F.lit(True).alias("was_sent_with_product"),
    )
    return stage(events), stage(events.select("user_id").distinct())


def test_busy_user_is_split_in_the_join(spark, shuffled_joins, hot_user):
    events, users = hot_user
    plan = final_plan(action_features(events, users, b.T_USAGE))
    assert "SortMergeJoin(skew=true)" in plan
    assert plan.count("Exchange hashpartitioning") >= 4


def test_busy_user_keeps_exact_counts(spark, shuffled_joins, hot_user):
    events, users = hot_user
    twice = events.unionByName(events.where("user_id = 7"))
    row = action_features(twice, users, b.T_USAGE).where("user_id = 7").first()
    assert row["billing_actions"] == events.where("user_id = 7 and full_scope <> 'other'").count()
    errors = events.where("id % 4 = 0").selectExpr("id + 1000000 as id", "id as update_id")
    weekly = weekly_update_features(
        twice, errors.unionByName(errors), users, b.T_USAGE
    ).where("user_id = 7").agg(F.sum("number_of_updates"), F.sum("number_of_update_errors")).first()
    assert weekly[0] == events.where("user_id = 7").count()
    assert weekly[1] == events.where("user_id = 7 and id % 4 = 0").count()


def test_growth_reads_the_updates_once(spark, shuffled_joins):
    updates, users = b.sources(spark, SF)["updates"], b.all_users(spark, SF)
    plan = final_plan(update_growth(updates, users, b.T_USAGE))
    scans = plan.count("events.parquet")
    assert "ReusedExchange" in plan and scans <= 1


def explained(spark, df):
    return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scans(spark):
    src = b.sources(spark, SF)
    eligible = explained(spark, eligible_subscriptions(src["stripe_subscriptions"], b.T))
    assert "GreaterThanOrEqual(o_orderdate,1997-04-01T00:00)" in eligible
    assert "LessThan(l_shipdate,1998-04-01T00:00)" in explained(spark, subscription_cohort(src, b.T))


def test_errors_are_joined_before_they_are_counted(spark, shuffled_joins):
    """No aggregate reads the whole error log: its first exchange only feeds the join."""
    src, users = b.sources(spark, SF), b.all_users(spark, SF)
    plan = weekly_update_features(src["updates"], src["update_errors"], users, b.T_USAGE)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    log = max(i for i, line in enumerate(lines) if "event_type" in line and "error" in line)
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
    path, level = [], depth[log]
    for i in range(log, -1, -1):
        if depth[i] < level:
            path.append(lines[i])
            level = depth[i]
    first = next(line for line in path if "Aggregate" in line or "Join" in line)
    assert "Join" in first


def test_the_cohort_reads_subscriptions_once(spark):
    plan = subscription_cohort(b.sources(spark, SF), b.T)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderdate" not in plan


def test_stage_uses_the_configured_folder(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging_root(spark).startswith(folder)
    staged = stage(spark.range(5))
    assert staged.count() == 5 and all(folder in path for path in staged.inputFiles())


def test_without_the_setting_the_warehouse_is_used():
    settings = {"spark.sql.warehouse.dir": "/shared/warehouse/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
                              sparkContext=SimpleNamespace(applicationId="app-1"))
    assert staging_root(session) == "/shared/warehouse/_staged/tenure-app-1"
    settings["spark.checkpoint.dir"] = "hdfs:/checkpoints"
    assert staging_root(session) == "hdfs:/checkpoints/tenure-app-1"


def test_a_run_releases_its_own_folder(tmp_path):
    script = """
import os, sys
sys.path.insert(0, sys.argv[1])
from tenure.session import build_session, release_staging, stage, staging_root
spark = build_session("local[1]", **{"spark.checkpoint.dir": sys.argv[2], "spark.ui.enabled": "false"})
stage(spark.range(3))
folder = staging_root(spark)
print("BEFORE", os.path.isdir(folder))
release_staging(spark)
print("AFTER", os.path.isdir(folder), os.path.isdir(sys.argv[2]))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", script, root, str(tmp_path)], capture_output=True, text=True, timeout=120, check=True)
    assert "BEFORE True" in run.stdout and "AFTER False True" in run.stdout


def test_bucketed_tables_join_without_a_shuffle(spark, shuffled_joins):
    rows = spark.range(2000).select((F.col("id") % 400).alias("user_id"), "id")
    for name in ("bucketed_left", "bucketed_right"):
        files.materialize_bucketed(rows, name, "user_id", 8)
    joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "user_id")
    assert joined.count() == 10_000
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
