"""Feature lists of the models. Fixed values."""

# Logistic regression on the flat feature file, three variants.
LOGIT_FULL = [
    "has_team_member", "is_mobile_user", "number_of_profiles", "has_refunded_charge",
    "has_failed_charge", "updates_past_week", "estimate", "weeks_with_updates", "total_updates",
    "simplified_plan_name", "subscription_age", "is_idle", "signup_client_name",
    "has_billing_actions", "has_analytics_actions", "user_age",
]
LOGIT_REDUCED = [
    "has_team_member", "is_mobile_user", "has_refunded_charge", "has_failed_charge",
    "updates_past_week", "estimate", "weeks_with_updates", "simplified_plan_name",
    "subscription_age", "is_idle", "has_billing_actions", "has_analytics_actions",
]
LOGIT_FINAL = [
    "has_team_member", "is_mobile_user", "has_refunded_charge", "has_failed_charge",
    "updates_past_week", "weeks_with_updates", "estimate", "simplified_plan_name",
    "subscription_age", "has_billing_actions", "has_analytics_actions",
]
# The first two variants standardise the subscription age.
LOGIT_SCALED = ["subscription_age"]

# Logistic regression of the scoring job.
LOGIT_SCORING = [
    "has_team_member", "is_mobile_user", "has_refunded_charge", "successful_charges",
    "has_failed_charge", "updates_last_week", "total_updates", "weeks_with_updates", "user_age",
    "has_billing_actions", "number_of_weeks_with_actions", "days_since_last_update",
]

# Random forests, four variants.
FOREST_FULL = [
    "has_team_member", "is_mobile_user", "number_of_profiles", "has_refunded_charge",
    "has_failed_charge", "days_since_last_update", "estimate", "weeks_with_updates",
    "total_updates", "simplified_plan_name", "subscription_age", "is_idle", "updates_past_week",
    "has_billing_actions", "has_analytics_actions",
]
FOREST_NO_PROFILES = [
    "has_team_member", "is_mobile_user", "has_refunded_charge", "has_billing_actions",
    "has_failed_charge", "updates_past_week", "estimate", "weeks_with_updates", "total_updates",
    "simplified_plan_name", "subscription_age",
]
FOREST_RECENCY = [
    "has_team_member", "is_mobile_user", "has_refunded_charge", "has_failed_charge",
    "days_since_last_update", "estimate", "weeks_with_updates", "total_updates",
    "simplified_plan_name", "subscription_age",
]
FOREST_SIGNUP = [
    "has_team_member", "is_mobile_user", "number_of_profiles", "has_refunded_charge",
    "has_failed_charge", "days_since_last_update", "estimate", "weeks_with_updates",
    "total_updates", "simplified_plan_name", "subscription_age", "signup_client_name",
    "signup_option", "no_updates",
]

# Network inputs and the ones that enter as logarithms.
NETWORK = [
    "number_of_profiles", "days_since_last_update", "weeks_with_updates", "total_updates",
    "estimate", "subscription_age", "signup_option", "simplified_plan_name", "quantity",
    "is_mobile_user", "has_team_member", "has_refunded_charge", "has_failed_charge",
]
NETWORK_LOG = ["number_of_profiles", "days_since_last_update", "total_updates"]

# Columns of the exported training file.
EXPORT_CATEGORIES = [
    "locale_browser_language", "plan_id", "simplified_plan_id", "timezone", "twofactor_type",
]
EXPORT_DROPPED = [
    "customer_id", "created_at", "canceled_at", "trial_start_at", "trial_end_at", "user_id",
    "user_signup_date",
]
EXPORT_FLAGS = [
    "churned_in_next_two_months", "has_verified_email", "has_notifications_enabled",
    "is_approved", "is_suspended",
]

# Columns of the flat feature file, as the cross-validated forest reads it.
FLAT_CATEGORIES = [
    "locale_browser_language", "signup_client_name", "signup_option", "plan_id",
    "billing_interval", "country", "simplified_plan_name",
]
FLAT_DROPPED = ["signup_date", "created_at", "canceled_at", "subscription_id", "estimate"]
FLAT_FLAGS = ["ios_user", "android_user"]

# Single-variable models.
SINGLE_CATEGORICAL = [
    "signup_option", "is_mobile_user", "billing_interval", "country", "simplified_plan_name",
    "signup_client_name",
]
SINGLE_NUMERIC = [
    "number_of_profiles", "number_of_twitter_profiles", "number_of_facebook_personal_profiles",
    "number_of_facebook_pages", "number_of_facebook_groups",
    "number_of_instagram_personal_profiles", "number_of_instagram_business_profiles",
    "number_of_successful_charges", "number_of_failed_charges", "number_of_refunded_charges",
    "days_since_last_update", "weeks_with_updates", "total_updates", "updates_per_week",
    "estimate", "subscription_age",
]
