"""Features from account tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.values import any_of, true

# Account columns kept as features.
USER_COLUMNS = [
    "locale_browser_language", "is_suspended", "is_approved", "has_notifications_enabled",
    "has_verified_email", "timezone", "twofactor_type", "number_of_bonus_profiles",
    "number_of_bonus_team_members", "number_of_default_profiles", "number_of_password_resets",
]


def user_features(users: DataFrame, cohort: DataFrame) -> DataFrame:
    """Account attributes of the cohort's users, one row per account."""
    ids = cohort.select(F.col("user_id").alias("id"))
    return users.join(ids, "id", "left_semi").select(
        F.col("id").alias("user_id"), F.col("created_at").alias("user_signup_date"), *USER_COLUMNS
    )


def user_flags(
    users: DataFrame, team_facts: DataFrame, client_facts: DataFrame, cohort: DataFrame
) -> DataFrame:
    """Signup date, team and mobile flags; accounts without facts get false."""
    ids = cohort.select(F.col("user_id").alias("id"))
    accounts = users.join(ids, "id", "left_semi").select(
        F.col("id").alias("user_id"),
        F.col("billing_stripe_customer_id").alias("customer_id"),
        F.to_date("created_at").alias("signup_date"),
    )
    mobile = any_of([F.col("is_ios_user"), F.col("is_android_user")])
    return (
        accounts.join(team_facts, "user_id", "left")
        .join(client_facts, "user_id", "left")
        .select(
            "user_id", "customer_id", "signup_date",
            true(F.col("number_of_team_members") >= 1).alias("has_team_member"),
            true(mobile).alias("is_mobile_user"),
        )
        .distinct()
    )
