import pytest

from pyspark.sql import functions as F
from tenure.operators.grouping import may_match
from tenure.plans.cohort import charge_counts, inactive_users, snapshot_label, subscription_cohort

T = "2017-12-31"
SUBSCRIPTION = (
    "id string, customer_id string, metadata_user_id string, plan_id string, simplified_plan_id string, "
    "billing_interval string, quantity long, created_at timestamp_ntz, canceled_at timestamp_ntz, "
    "trial_start_at timestamp_ntz, trial_end_at timestamp_ntz, successful_charges long"
)
INVOICE = "id string, subscription_id string, paid boolean, amount_due long, date timestamp_ntz"
CHARGE = "id string, invoice string, amount long, created timestamp_ntz, captured boolean, paid boolean, refunded boolean"


def sub(key, created="2017-06-01", canceled=None, plan="awesome", interval="month", paid=1):
    return (key, f"c{key}", f"u{key}", "p", plan, interval, 1, created, canceled, None, None, paid)


@pytest.fixture
def source(rows):
    def build(subs, invoices=None, charges=None, users=None):
        invoices = invoices or [(f"i{s[0]}", s[0], True, 10, "2017-07-01") for s in subs]
        charges = charges or [(f"ch{i[0]}", i[0], 10, "2017-07-01", True, True, False) for i in invoices]
        src = {
            "stripe_subscriptions": rows(SUBSCRIPTION, subs),
            "stripe_invoices": rows(INVOICE, invoices),
            "stripe_charges": rows(CHARGE, charges),
        }
        if users:
            src["users"] = rows("id string, billing_stripe_customer_id string", users)
        return src

    return build


def labels(df):
    return {r["subscription_id"]: r["churned_in_next_two_months"] for r in df.collect()}


def test_label_window_is_open_at_t_and_closed_at_the_clamped_end(source):
    src = source(
        [
            sub("at_t", canceled="2017-12-31 00:00:00"),
            sub("just_after", canceled="2017-12-31 00:00:01"),
            sub("end", canceled="2018-02-28 00:00:00"),
            sub("past_end", canceled="2018-02-28 00:00:01"),
            sub("live"),
        ]
    )
    assert labels(subscription_cohort(src, T)) == {
        "just_after": True, "end": True, "past_end": False, "live": False,
    }
    assert labels(subscription_cohort(src, T, horizon=1))["end"] is False


def test_cohort_edges(source):
    src = source(
        [
            sub("year_ago", created="2016-12-31"),
            sub("older", created="2016-12-30 23:59:59"),
            sub("today", created="2017-12-31"),
            sub("reply", plan="reply"), sub("analyze", plan="analyze"), sub("no_plan", plan=None),
            sub("yearly", interval="year"), sub("never_paid", paid=0), sub("business", plan="business"),
            sub("other", plan="small"),
        ]
    )
    assert set(labels(subscription_cohort(src, T))) == {"year_ago", "today", "business", "other"}
    scored = subscription_cohort(src, T, plans=["awesome", "business"])
    assert set(labels(scored)) == {"year_ago", "today", "business"}


def test_only_paid_positive_invoices_and_charges_before_t_count(source):
    src = source(
        [sub(k) for k in "abcdef"],
        invoices=[
            ("ia", "a", True, 10, "2017-07-01"), ("ib", "b", False, 10, "2017-07-01"),
            ("ic", "c", True, 0, "2017-07-01"), ("id", "d", True, None, "2017-07-01"),
            ("ie", "e", True, 10, "2017-12-31"), ("if", "f", True, 10, "2017-07-01"),
        ],
        charges=[(f"c{k}", f"i{k}", 10, "2017-07-01", True, True, False) for k in "abcde"]
        + [("cf", "if", 10, "2017-12-31", True, True, False), ("cg", "if", None, "2017-07-01", True, True, False)],
    )
    assert set(labels(subscription_cohort(src, T))) == {"a"}


def test_charge_outcomes_under_missing_flags_and_copies(rows, source):
    charges = [
        ("ok", "ia", 10, "2017-07-01", True, True, False),
        ("ok", "ia", 10, "2017-07-01", True, True, False),
        ("no_refund_flag", "ia", 10, "2017-07-01", True, True, None),
        ("refunded", "ia", 10, "2017-07-01", True, True, True),
        ("failed", "ia", 10, "2017-07-01", False, False, None),
        ("unknown", "ia", 10, "2017-07-01", None, False, None),
    ]
    src = source([sub("a")], [("ia", "a", True, 10, "2017-07-01")] * 3, charges)
    ids = rows("subscription_id string", [("a",), ("a",)])
    row = charge_counts(src["stripe_invoices"], src["stripe_charges"], ids, T).first()
    assert (row["successful_charges"], row["refunded_charges"], row["failed_charges"]) == (1, 1, 1)


def test_copies_of_a_subscription_stay_one_row(source):
    assert subscription_cohort(source([sub("a")] * 4), T).count() == 1


def test_user_comes_from_the_billing_customer(source):
    src = source([sub("a"), sub("b")], users=[("owner", "ca")])
    found = subscription_cohort(src, T, via_users=True).collect()
    assert [(r["subscription_id"], r["user_id"]) for r in found] == [("a", "owner")]


def test_snapshot_label(rows):
    df = rows(
        "id string, created_at date, canceled_at date",
        [
            ("live", "2017-10-31", None), ("late", "2017-11-01", None), ("gone", "2017-05-01", "2017-12-31"),
            ("churned", "2017-05-01", "2018-03-01"), ("later", "2017-05-01", "2018-03-02"),
            ("first_day", "2017-05-01", "2018-01-01"),
        ],
    )
    out = snapshot_label(df, "2018-01-01", "2018-03-01", "2017-10-31")
    assert {r["id"]: r["did_churn"] for r in out.collect()} == {
        "live": False, "churned": True, "later": False, "first_day": True,
    }


def test_inactive_users(rows):
    cohort, activity = rows("user_id string", [("a",), ("a",), ("b",)]), rows("user_id string", [("b",), ("c",)])
    assert [r[0] for r in inactive_users(cohort, activity).collect()] == ["a"]


def test_rows_that_cannot_match_go_before_the_aggregate(rows, spark):
    ids = rows("id long", [(i,) for i in range(0, 3000, 30)] + [(None,)])
    lines = spark.range(3000).select(F.col("id").alias("key"), F.lit(1).alias("n")).union(spark.range(1).select(F.lit(None).cast("long"), F.lit(1)))
    found = may_match(lines.groupBy("key").agg(F.sum("n").alias("n")), "key", ids, "id")
    kept = {r["key"] for r in found.collect()}
    assert set(range(0, 3000, 30)) <= kept and len(kept) < 130
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate") and "LeftSemi" in plan
    other = rows("id int", [(1,)])
    assert may_match(lines, "key", other, "id").count() == 3001


def test_charges_of_other_subscriptions_are_not_shuffled(spark, rows):
    """With a thousand subscriptions of which one is asked for, few charges reach the join."""
    number = F.col("id").cast("string")
    invoices = spark.range(1000).groupBy(number.alias("subscription_id"), F.concat(F.lit("i"), number).alias("id")).agg(
        F.lit(True).alias("paid"), F.max(F.lit(10)).alias("amount_due"), F.max(F.lit("2017-07-01").cast("timestamp_ntz")).alias("date")
    )
    charges = spark.range(1000).select(
        F.concat(F.lit("c"), number).alias("id"), F.concat(F.lit("i"), number).alias("invoice"), F.lit(10).alias("amount"),
        F.lit("2017-07-01").cast("timestamp_ntz").alias("created"), F.lit(True).alias("captured"), F.lit(True).alias("paid"), F.lit(False).alias("refunded"),
    )
    counted = charge_counts(invoices, charges, rows("subscription_id string", [("7",)]), T)
    assert [tuple(r) for r in counted.collect()] == [("7", 1, 0, 0)]
    assert "LeftSemi" in counted._jdf.queryExecution().optimizedPlan().toString()
