"""Labelled cohorts: which subscriptions are scored, and which of them cancelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, instant, shifted
from tenure.functions.values import true
from tenure.operators.grouping import may_match, packed_distinct
from tenure.session import stage
from tenure.sources.tables import Sources

# Plans that belong to other products, and the plans of the scoring job.
EXCLUDED_PLANS = ["reply", "analyze"]
SCORED_PLANS = ["awesome", "business"]

ATTRIBUTES = [
    "customer_id", "user_id", "plan_id", "simplified_plan_id", "canceled_at", "created_at",
    "quantity", "trial_start_at", "trial_end_at",
]
CHARGE_COUNTS = ["successful_charges", "refunded_charges", "failed_charges"]


def eligible_subscriptions(
    subscriptions: DataFrame, t: Instant, plans: Sequence[str] | None = None
) -> DataFrame:
    """Monthly subscriptions of the past year, active at ``t``, with a successful charge."""
    plan = F.col("simplified_plan_id")
    wanted = plan.isin(list(plans)) if plans else ~plan.isin(EXCLUDED_PLANS)
    canceled = F.col("canceled_at")
    return subscriptions.where(
        (F.col("billing_interval") == "month")
        & wanted
        & F.col("created_at").between(shifted(t, years=-1), instant(t))
        & (canceled.isNull() | (canceled > instant(t)))
        & (F.col("successful_charges") >= 1)
    )


def charge_counts(
    invoices: DataFrame, charges: DataFrame, subscription_ids: DataFrame, t: Instant
) -> DataFrame:
    """Distinct successful, refunded and failed charges of paid invoices before ``t``.

    Each charge is reduced to one row with its outcome flags first, keyed by
    (subscription, charge) so that one huge subscription still spreads over all
    tasks; the counts are then plain sums with map-side combining. Counting three
    conditional distincts directly would copy every charge three times. Invoices and charges
    of other subscriptions are left out before the shuffles, which most of them are.
    """
    # Staged before its filters: they and the semi-join would keep each other above an aggregate.
    near = stage(may_match(invoices, "subscription_id", subscription_ids, "subscription_id"))
    billed = near.where("paid and amount_due > 0").where(F.col("date") < instant(t)).join(
        subscription_ids, "subscription_id", "left_semi"
    )
    billed = stage(packed_distinct(billed.select("subscription_id", F.col("id").alias("invoice"))))
    captured, paid, refunded = (F.col(c) for c in ("captured", "paid", "refunded"))
    outcomes = {
        "successful_charges": captured & paid & ~refunded,
        "refunded_charges": refunded,
        "failed_charges": ~paid & ~captured,
    }
    charged = charges.where(F.col("amount") > 0).where(F.col("created") < instant(t)).select(
        F.col("id").alias("charge"),
        "invoice",
        *[true(c).alias(name) for name, c in outcomes.items()],
    )
    per_charge = (
        may_match(charged, "invoice", billed, "invoice").join(billed, "invoice")
        .groupBy("subscription_id", "charge")
        .agg(*[F.max(name).alias(name) for name in outcomes])
    )
    return per_charge.groupBy("subscription_id").agg(
        *[
            F.count_if(F.col(name) & F.col("charge").isNotNull()).cast("long").alias(name)
            for name in outcomes
        ]
    )


def cancels_within(canceled_at: Column, t: Instant, months: int) -> Column:
    return true(canceled_at.between(instant(t), shifted(t, months=months)))


def subscription_cohort(
    src: Sources,
    t: Instant,
    plans: Sequence[str] | None = None,
    via_users: bool = False,
    attributes: Sequence[str] = tuple(ATTRIBUTES),
    horizon: int = 2,
    label: str = "churned_in_next_two_months",
) -> DataFrame:
    """Subscriptions active at ``t`` with charge counts and the cancellation label.

    ``plans`` restricts to the given plans instead of excluding other products'.
    ``via_users`` takes the user from the account that owns the billing customer
    rather than from the subscription. ``horizon`` is the label window in months.
    """
    eligible = eligible_subscriptions(src["stripe_subscriptions"], t, plans)
    read = {"id", "customer_id", *attributes, "canceled_at"} - {"user_id", "subscription_id"}
    owner = [] if via_users else ["metadata_user_id"]
    # Read by the charge counts and by the description, so it is computed once.
    eligible = stage(eligible.select(*[c for c in eligible.columns if c in read or c in owner]))
    counts = charge_counts(
        src["stripe_invoices"],
        src["stripe_charges"],
        eligible.select(F.col("id").alias("subscription_id")),
        t,
    )
    described = eligible.withColumnRenamed("id", "subscription_id")
    if via_users:
        owners = src["users"].select(
            F.col("id").alias("user_id"), F.col("billing_stripe_customer_id").alias("customer_id")
        )
        described = described.join(owners, "customer_id")
    else:
        described = described.withColumnRenamed("metadata_user_id", "user_id")
    described = packed_distinct(described.select("subscription_id", *attributes))
    return described.join(counts, "subscription_id").select(
        "subscription_id",
        *attributes,
        *CHARGE_COUNTS,
        cancels_within(F.col("canceled_at"), t, horizon).alias(label),
    )


def cohort_users(cohort: DataFrame) -> DataFrame:
    """Distinct users of a cohort, staged so that their real size is known to every join."""
    return stage(cohort.select("user_id").distinct())


def snapshot_label(
    df: DataFrame, active_from: Instant, churn_until: Instant, created_until: Instant
) -> DataFrame:
    """Label and activity filter from dates alone, for the flat feature file."""
    canceled, created = F.col("canceled_at"), F.col("created_at")
    return df.select(
        "*",
        (canceled.isNotNull() & (canceled <= instant(churn_until))).alias("did_churn"),
        (canceled.isNull() | (canceled >= instant(active_from))).alias("was_active_end_of_year"),
        (created <= instant(created_until)).alias("was_active_two_months"),
    ).where("was_active_end_of_year and was_active_two_months")


def inactive_users(cohort: DataFrame, activity: DataFrame, key: str = "user_id") -> DataFrame:
    """Users of the cohort that do not appear in the activity data."""
    return cohort.select(key).distinct().join(activity.select(key).distinct(), key, "left_anti")
