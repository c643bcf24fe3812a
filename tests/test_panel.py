"""Many snapshots from one pass equal the single builds, and read every source once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenure.operators.windows import Windows, distinct_steps, over_windows
from tenure.plans import dataset, panel
from tenure.plans.activity import action_features, weekly_update_features, wide_update_features
from tenure.plans.cohort import subscription_cohort
from tenure.sources.schemas import TABLES
from tenure.sources.tables import load_sources

# A Sunday, dates within days of each other, times inside a day, one far off.
DATES = ["2018-04-01", "2018-03-28 12:00:00", "2018-04-04", "2018-01-10"]


def moment(rng, around="2018-03-20"):
    edge = rng.choice([*DATES, around, around])
    base = datetime.fromisoformat(edge) - timedelta(weeks=rng.choice([0, 0, 8, 8, 1, 2, 4]))
    return base + timedelta(seconds=rng.choice([0, 0, 1, -1, rng.randint(-20 * 86400, 20 * 86400)]))


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """Few ids that occur again and again, at window edges, without ids, with shared errors and invoices."""
    rng, root = random.Random(11), tmp_path_factory.mktemp("panel")
    ids = lambda n: rng.choice([None, *(str(i) for i in range(n))])
    subs = [
        (str(i % 55), f"c{i % 7}", ids(8), "p", rng.choice(["awesome", "business", "reply", None]), rng.choice(["month", "month", "year"]), 1,
         moment(rng) - timedelta(days=rng.choice([0, 30, 364, 365, 366])), rng.choice([None, moment(rng), moment(rng, "2018-06-01")]), None, None, rng.choice([0, 1, 2]))
        for i in range(80)
    ]
    bills = [(ids(60), str(rng.randrange(55)), rng.choice([True, True, False]), rng.choice([0.0, 5.0]), moment(rng)) for _ in range(300)]
    charges = [(ids(90), ids(60), rng.choice([0.0, 5.0, 5.0]), moment(rng), *(rng.choice([None, True, False]) for _ in range(3))) for _ in range(500)]
    users = [(str(i), moment(rng), f"c{i}", "en", *[None] * 10) for i in range(6)]
    scopes = ["dashboard settings billing viewed", "dashboard settings billing updated", "dashboard analytics posts viewed", "other", None]
    rows = {
        "stripe_subscriptions": subs, "stripe_invoices": bills, "stripe_charges": charges, "users": users,
        "updates": [(ids(60), ids(8), ids(4), moment(rng), rng.choice(["Extension", "web", None]), True) for _ in range(400)],
        "update_errors": [(ids(20), ids(60)) for _ in range(80)],
        "actions_taken": [(ids(60), ids(8), rng.choice(scopes), moment(rng)) for _ in range(400)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{root}/{name}.parquet")
    return load_sources(spark, str(root))


def same(one, other, fill=()):
    names = sorted(set(one.columns) | set(other.columns))
    assert sorted(one.columns) == names or fill

    def plain(df):
        full = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])
        return sorted(str([0 if v is None and c in fill else v for c, v in zip(names, r, strict=True)]) for r in full.collect())

    assert plain(one) == plain(other)
    return one.count()


def test_cohorts_of_all_dates(sources):
    single = dataset.snapshots(lambda t: subscription_cohort(sources, t), DATES)
    assert same(panel.cohort_panel(sources, DATES), single) > 12


def test_activity_of_all_dates(sources):
    users = sources["users"].select(F.col("id").alias("user_id"))
    dates = [datetime.fromisoformat(t) for t in DATES]
    windows = panel._lookback(dates, dates, 8)
    single = dataset.snapshots(lambda t: action_features(sources["actions_taken"], users, t), DATES)
    assert same(panel.action_panel(sources["actions_taken"], users, windows), single) > 8

    def wide(t):
        return wide_update_features(weekly_update_features(sources["updates"], sources["update_errors"], users, t), t)

    numbers = list(range(-1, 9))
    all_weeks = dataset.snapshots(lambda t: wide(t), [t for t in DATES if t != "2018-04-01"])
    all_weeks = all_weeks.unionByName(dataset.snapshots(wide, ["2018-04-01"]), allowMissingColumns=True)
    weeks = [f"{m}{str(n).replace('-', 'm')}" for m in panel.WEEKLY_MEASURES.values() for n in numbers]
    assert same(panel.update_panel(sources["updates"], sources["update_errors"], users, windows, numbers), all_weeks, fill=weeks) > 8


def test_dataset_of_all_dates(sources):
    days = ["2018-04-03", "2018-03-28 12:00:00"]
    single = dataset.snapshots(lambda t: dataset.churn_dataset(sources, t), days)
    found = panel.churn_panel(sources, days)
    assert found.columns == single.columns
    assert same(found, single) > 2
    with pytest.raises(ValueError):
        panel.churn_panel(sources, ["2018-04-01", "2018-04-01 10:00:00"])


def test_every_source_is_scanned_once(spark, sources, monkeypatch):
    plans, real = [], panel.stage

    def plan(df):
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return text.split("== Physical Plan ==")[-1]

    monkeypatch.setattr(panel, "stage", lambda df: plans.append(plan(df)) or real(df))
    plans.append(plan(panel.churn_panel(sources, [f"2018-{m:02d}-01" for m in range(1, 13)])))
    text = "\n".join(plans)
    for name in ("stripe_subscriptions", "stripe_invoices", "stripe_charges", "users", "updates", "update_errors", "actions_taken"):
        assert text.count(f"/{name}.parquet]") == 1, name


def test_ids_count_once_in_each_window(spark):
    """Against counting every window by itself, with ids in many cells."""
    rng = random.Random(2)
    start = datetime(2020, 1, 1)
    data = [(rng.choice("ab"), rng.choice([None, *range(12)]), start + timedelta(hours=rng.randrange(400))) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, id int, ts timestamp_ntz")
    spans = [(start + timedelta(hours=a), start + timedelta(hours=a + rng.randrange(60))) for a in range(0, 400, 13)]
    windows = Windows(spans, [{"name": F.lit(i)} for i in range(len(spans))])
    steps = distinct_steps(df.where(windows.holds(F.col("ts"))).withColumn("cell", windows.cell(F.col("ts"))), ["k"], "id")
    got = {(r["k"], r["name"]): r["n"] for r in over_windows(steps, windows).groupBy("k", "w.name").agg(F.sum("fresh").alias("n")).collect()}
    want = {}
    for i, (a, b) in enumerate(spans):
        for k in "ab":
            held = [x for kk, x, ts in data if kk == k and a <= ts <= b]
            if held:
                want[k, i] = len({x for x in held if x is not None})
    assert got == want
