"""Flags and ages derived from the columns of an assembled dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, days_between, snapshot_date
from tenure.functions.values import grouped_number, spelled_flag

IDLE_AFTER_DAYS = 90
RECENT_DAYS = 7


def is_idle(days: Column) -> Column:
    return days.isNull() | (days > IDLE_AFTER_DAYS)


def updated_past_week(days: Column) -> Column:
    return days.isNotNull() & (days < RECENT_DAYS)


def derive_flags(df: DataFrame, as_of: Instant) -> DataFrame:
    """Add every derived column whose inputs are present."""
    c = F.col
    yes_no = {"yes": "Yes", "no": "No"}
    rules: list[tuple[str, list[str], Column]] = [
        ("user_age", ["signup_date", "created_at"],
         days_between(c("signup_date"), c("created_at")).cast("double")),
        ("subscription_age", ["created_at"],
         days_between(c("created_at"), snapshot_date(as_of)).cast("double")),
        ("is_mobile_user", ["ios_user", "android_user"],
         spelled_flag(c("ios_user"), **yes_no) | spelled_flag(c("android_user"), **yes_no)),
        ("is_idle", ["days_since_last_update"], is_idle(c("days_since_last_update"))),
        ("updates_past_week", ["days_since_last_update"],
         updated_past_week(c("days_since_last_update"))),
        ("number_of_profiles", ["number_of_profiles"], grouped_number(c("number_of_profiles").cast("string"))),
        ("has_team_member", ["number_of_team_members"], c("number_of_team_members") >= 1),
        ("has_failed_charge", ["number_of_failed_charges"], c("number_of_failed_charges") >= 1),
        ("has_refunded_charge", ["number_of_refunded_charges"], c("number_of_refunded_charges") >= 1),
        ("has_failed_charge", ["failed_charges"], c("failed_charges") > 0),
        ("has_refunded_charge", ["refunded_charges"], c("refunded_charges") > 0),
        ("has_billing_actions", ["billing_actions"], c("billing_actions") > 0),
        ("has_analytics_actions", ["analytics_actions"], c("analytics_actions") > 0),
        ("no_updates", ["total_updates"], c("total_updates").isNull() | (c("total_updates") == 0)),
    ]
    present = set(df.columns)
    return df.withColumns({name: rule for name, needs, rule in rules if present.issuperset(needs)})
