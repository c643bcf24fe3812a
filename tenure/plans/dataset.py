"""Assembled datasets: one row per subscription with all feature sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, as_datetime
from tenure.operators.columns import fill_missing
from tenure.plans.accounts import user_features, user_flags
from tenure.plans.activity import (
    action_features, update_growth, update_recency, update_summary, weekly_update_features,
    wide_update_features,
)
from tenure.plans.cohort import (
    SCORED_PLANS, cohort_users, snapshot_label, subscription_cohort,
)
from tenure.plans.flags import derive_flags
from tenure.session import stage
from tenure.sources.tables import Sources

SCORING_ATTRIBUTES = [
    "user_id", "customer_id", "plan_id", "simplified_plan_id", "canceled_at", "created_at",
]


def churn_dataset(src: Sources, t: Instant, usage_t: Instant | None = None) -> DataFrame:
    """Cohort, account attributes, action features and wide weekly updates.

    ``usage_t`` is the cut-off of the activity logs when it differs from the
    billing snapshot. Features stay NULL where a user has no activity.
    """
    usage_t = usage_t or t
    cohort = stage(subscription_cohort(src, t))
    users = cohort_users(cohort)
    weekly = weekly_update_features(src["updates"], src["update_errors"], users, usage_t)
    return per_user(
        cohort,
        user_features(src["users"], users),
        [
            action_features(src["actions_taken"], users, usage_t),
            wide_update_features(weekly, usage_t),
        ],
    )


def per_user(cohort: DataFrame, accounts: DataFrame, activity: Sequence[DataFrame]) -> DataFrame:
    """Join per-user features to the subscriptions of a staged cohort.

    The features meet on unique users first, where no key can be hot, and are
    staged. One join then brings them to the subscriptions: with plain scans on both
    sides, adaptive execution can split a user who owns many subscriptions.
    """
    features = accounts
    for part in activity:
        features = features.join(part, "user_id", "left")
    joined = cohort.join(stage(features), "user_id")
    return joined.select(*cohort.columns, *[c for c in features.columns if c != "user_id"])


def scoring_dataset(
    src: Sources,
    t: Instant,
    usage_t: Instant | None = None,
    fill_recency: bool = False,
    growth: bool = False,
) -> DataFrame:
    """Dataset of the scoring job; absent activity counts as 0.

    A user without any update keeps a NULL recency, which the idle flag reads as
    "never active"; ``fill_recency`` turns it into 0 instead. ``growth`` adds
    updates per week and the growth slope.
    """
    usage_t = usage_t or t
    cohort = stage(
        subscription_cohort(
            src, t, plans=SCORED_PLANS, via_users=True, attributes=SCORING_ATTRIBUTES,
            label="did_churn",
        )
    )
    users = cohort_users(cohort)
    flags = user_flags(
        src["users"], src["user_team_member_facts"], src["user_client_facts"], users
    ).drop("customer_id")
    activity = [
        update_summary(src["updates"], users, usage_t),
        update_recency(src["updates"], users, usage_t),
        action_features(
            src["actions_taken"], users, usage_t, match="exact", last_week=False
        ),
    ]
    if growth:
        activity.append(
            update_growth(src["updates"], users, usage_t).select(
                "user_id", "updates_per_week", "estimate"
            )
        )
    filled = ["days_since_last_update"] if fill_recency else []
    for features in activity:
        filled += [c for c in features.columns if c != "days_since_last_update"]
    dataset = per_user(cohort, flags, activity).withColumns(
        {c: F.to_date(c) for c in ("created_at", "canceled_at")}
    )
    filled = [c for c in filled if c != "user_id"]
    return fill_missing(dataset, filled).withColumns(
        {
            "has_billing_actions": F.col("billing_actions") > 0,
            "has_analytics_actions": F.col("analytics_actions") > 0,
        }
    )


def clean_scoring_dataset(df: DataFrame, t: Instant) -> DataFrame:
    """Model inputs of the scoring job: ages, charge flags and a 0/1 label."""
    return derive_flags(df, t).withColumn("did_churn", F.col("did_churn").cast("int"))


def feature_file_dataset(
    file: DataFrame,
    src: Sources,
    as_of: Instant,
    active_from: Instant,
    churn_until: Instant,
    created_until: Instant,
    updates_since: Instant,
    updates_until: Instant | None = None,
    usage_t: Instant | None = None,
) -> DataFrame:
    """Modelling dataset from the flat export of subscriptions (``id`` is the user).

    Label and activity filter come from dates; recency, growth and action features of
    the remaining users are added, absent counts become 0, and flags are derived.
    ``updates_until`` ends the weekly series and ``usage_t`` dates the recency and the
    actions; both default to ``as_of``. A validation set is the same call at later dates.
    """
    usage_t = usage_t or as_of
    labelled = stage(
        snapshot_label(file, active_from, churn_until, created_until).withColumnRenamed("id", "user_id")
    )
    users = cohort_users(labelled)
    activity = [
        update_recency(src["updates"], users, usage_t),
        update_growth(src["updates"], users, updates_until or as_of, since=updates_since),
        action_features(src["actions_taken"], users, usage_t, last_week=False),
    ]
    counts = [
        c for part in activity for c in part.columns
        if c not in ("user_id", "days_since_last_update")
    ]
    joined = per_user(labelled, users, activity)
    filled = fill_missing(joined, [*counts, "number_of_team_members"])
    return derive_flags(filled, as_of).withColumnRenamed("user_id", "id")


def snapshots(
    build: Callable[[Instant], DataFrame], dates: Sequence[Instant]
) -> DataFrame:
    """One definition evaluated at several dates, tagged with the ``snapshot`` date."""
    tagged = [build(t).withColumn("snapshot", F.lit(as_datetime(t).date())) for t in dates]
    combined = tagged[0]
    for other in tagged[1:]:
        combined = combined.unionByName(other)
    return combined
