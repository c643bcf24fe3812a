"""Columns of the billing, account, activity and support tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
    "d": T.DoubleType(),
    "t": T.TimestampNTZType(),
    "D": T.DateType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[code]) for name, code in columns.items()])


# Table and column names the feature definitions rely on.
TABLES: dict[str, T.StructType] = {
    "stripe_subscriptions": _table(
        id="s", customer_id="s", metadata_user_id="s", plan_id="s", simplified_plan_id="s",
        billing_interval="s", quantity="l", created_at="t", canceled_at="t",
        trial_start_at="t", trial_end_at="t", successful_charges="l",
    ),
    "stripe_invoices": _table(id="s", subscription_id="s", paid="b", amount_due="d", date="t"),
    "stripe_charges": _table(
        id="s", invoice="s", amount="d", created="t", captured="b", paid="b", refunded="b"
    ),
    "users": _table(
        id="s", created_at="t", billing_stripe_customer_id="s", locale_browser_language="s",
        is_suspended="b", is_approved="b", has_notifications_enabled="b", has_verified_email="b",
        timezone="s", twofactor_type="s", number_of_bonus_profiles="l",
        number_of_bonus_team_members="l", number_of_default_profiles="l",
        number_of_password_resets="l",
    ),
    "updates": _table(
        id="s", user_id="s", profile_id="s", created_at="t", client_type="s",
        was_sent_with_product="b",
    ),
    "update_errors": _table(id="s", update_id="s"),
    "actions_taken": _table(id="s", user_id="s", full_scope="s", created_at="t"),
    "profiles": _table(id="s", user_id="s"),
    "user_team_member_facts": _table(user_id="s", number_of_team_members="l"),
    "user_client_facts": _table(user_id="s", is_ios_user="b", is_android_user="b"),
    "helpscout_conversations": _table(
        id="l", createdat="t", type="s", isdraft="b", customer="s", createdby="s", mailbox="s"
    ),
}

# The flat feature file exchanged as CSV between feature building and modelling.
FEATURE_FILE = _table(
    id="s", signup_date="D", locale_browser_language="s", number_of_team_members="l",
    signup_client_name="s", signup_option="s", ios_user="s", android_user="s",
    number_of_profiles="s", subscription_id="s", created_at="D", canceled_at="D", plan_id="s",
    simplified_plan_name="s", quantity="l", billing_interval="s", country="s",
    number_of_successful_charges="l", number_of_failed_charges="l",
    number_of_refunded_charges="l", days_since_last_update="l", weeks_with_updates="l",
    total_updates="l", updates_per_week="d", estimate="d", did_churn="b",
)
