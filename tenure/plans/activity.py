"""Feature sets from activity logs, restricted to a set of users.

``users`` is any DataFrame with a ``user_id`` column. It always enters as a
semi-join: the id list never leaves the cluster, repeated ids cannot multiply
activity rows, and the join strategy follows the measured size of the list. Pass a
table or a staged list (``cohort_users``): with a plain scan on either side, adaptive
execution can split the rows of one busy user in the join.

One user may own a large part of a log. Every feature therefore first collapses
rows on a key finer than the user (see ``packed_groups``), and only then groups by
user.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import (
    Instant, in_lookback, instant, previous_week, snapshot_date, week_number, week_numbers,
    week_offset, week_start, year_fraction,
)
from tenure.functions.values import true
from tenure.operators.grouping import packed_distinct, packed_groups
from tenure.operators.reshape import pivot_measures

# Action scopes, client type and feature names.
BILLING_PREFIX = "dashboard settings billing"
ANALYTICS_PREFIX = "dashboard analytics"
BILLING_VIEW = "dashboard settings billing viewed"
ANALYTICS_VIEW = "dashboard analytics posts viewed"
EXTENSION = "Extension"
WEEKLY_MEASURES = {
    "number_of_updates": "number_of_updates_week_",
    "number_of_days_with_updates": "number_of_days_with_updates_week_",
    "number_of_extension_updates": "number_of_extension_updates_week_",
    "number_of_update_errors": "number_of_update_errors_week_",
}


def of_users(activity: DataFrame, users: DataFrame) -> DataFrame:
    return activity.join(users.select("user_id"), "user_id", "left_semi")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


# Weeks per bit set; a longer lookback takes several sets.
WEEKS_PER_SET = 60


def action_features(
    actions: DataFrame,
    users: DataFrame,
    t: Instant,
    weeks: int = 8,
    match: str = "prefix",
    last_week: bool = True,
) -> DataFrame:
    """Distinct billing and analytics actions, weeks with billing actions, actions last week.

    Actions shrink to one row per (user, action) before the per-user totals.
    Actions that no feature counts all collapse into one row per user. The distinct
    weeks are bit sets, one for every 60 weeks of the lookback window.
    """
    scope, created = F.col("full_scope"), F.col("created_at")
    if match == "prefix":
        billing, analytics = scope.startswith(BILLING_PREFIX), scope.startswith(ANALYTICS_PREFIX)
    else:
        billing, analytics = scope == BILLING_VIEW, scope == ANALYTICS_VIEW
    in_last_week = week_start(created) == F.lit(previous_week(t))
    offset = week_offset(created, t, weeks)
    sets = [f"weeks_{i}" for i in range(0, weeks + 2, WEEKS_PER_SET)]
    week_bits = [
        F.when(true(billing) & offset.between(i * WEEKS_PER_SET, (i + 1) * WEEKS_PER_SET - 1), _bit(offset - i * WEEKS_PER_SET))
        .otherwise(0).alias(name)
        for i, name in enumerate(sets)
    ]
    flagged = of_users(actions.where(in_lookback(created, t, weeks)), users).select(
        "user_id",
        "id",
        true(billing).alias("billing"),
        true(analytics).alias("analytics"),
        (true(in_last_week) if last_week else F.lit(False)).alias("recent"),
        *week_bits,
    )
    used = F.col("billing") | F.col("analytics") | F.col("recent")
    per_action = packed_groups(
        flagged.withColumn("id", F.when(used, F.col("id"))),
        ["user_id", "id"],
        F.max("billing").alias("billing"),
        F.max("analytics").alias("analytics"),
        F.max("recent").alias("recent"),
        *[F.bit_or(s).alias(s) for s in sets],
    )

    def counted(flag: str) -> Column:
        return F.count_if(F.col(flag) & F.col("id").isNotNull()).cast("long")

    features = [
        counted("billing").alias("billing_actions"),
        counted("analytics").alias("analytics_actions"),
        reduce(lambda a, b: a + b, [F.bit_count(F.bit_or(s)) for s in sets]).cast("long").alias("number_of_weeks_with_actions"),
    ]
    if last_week:
        features.append(counted("recent").alias("actions_last_week"))
    return per_action.groupBy("user_id").agg(*features)


def weekly_update_features(
    updates: DataFrame,
    update_errors: DataFrame,
    users: DataFrame,
    t: Instant,
    weeks: int = 8,
    sent_only: bool = False,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Updates, active days, extension updates and errors per user and week.

    Counts are distinct ids: an update is one row per (user, week, id), and an error
    that belongs to several updates of a week counts once. Only errors of updates in the
    window are read. Active days are a bit set of the seven weekdays. With ``profiles``
    the user is the owner of the update's profile, distinct profiles are counted as
    well, and an update under two profiles of one user is one update.
    """
    recent = updates.where(in_lookback(F.col("created_at"), t, weeks))
    if sent_only:
        recent = recent.where("was_sent_with_product")
    if profiles is None:
        recent = of_users(recent, users)
        parts = []
    else:
        owners = packed_distinct(
            of_users(profiles, users).select(F.col("id").alias("profile_id"), "user_id")
        )
        recent = recent.drop("user_id").join(owners, "profile_id")
        parts = ["profile_id"]
    tagged = recent.select(
        "user_id",
        *parts,
        F.col("id").alias("update_id"),
        week_start(F.col("created_at")).alias("week"),
        _bit(F.weekday(F.to_date("created_at"))).alias("days"),
        true(F.col("client_type") == EXTENSION).alias("extension"),
    )
    per_update = packed_groups(
        tagged, ["user_id", "week", "update_id"],
        F.bit_or("days").alias("days"), F.max("extension").alias("extension"),
    )
    known = F.col("update_id").isNotNull()
    weekly = per_update.groupBy("user_id", "week").agg(
        F.count("update_id").alias("updates"),
        F.bit_or("days").alias("days"),
        F.count_if(F.col("extension") & known).alias("extension"),
    )
    failed = update_errors.select("update_id", F.col("id").alias("error_id")).join(
        per_update.select("user_id", "week", "update_id"), "update_id"
    )
    errors = packed_distinct(failed.select("user_id", "week", "error_id")).groupBy("user_id", "week").agg(
        F.count("error_id").alias("errors")
    )
    weekly = weekly.join(errors, ["user_id", "week"], "left")
    named = [
        F.col("updates").cast("long").alias("number_of_updates"),
        F.bit_count("days").cast("long").alias("number_of_days_with_updates"),
        F.lit(1).cast("long").alias("number_of_weeks_with_updates"),
        F.col("extension").cast("long").alias("number_of_extension_updates"),
    ]
    if parts:
        owned = packed_distinct(tagged.select("user_id", "week", "profile_id"))
        counted = owned.groupBy("user_id", "week").agg(F.count("profile_id").alias("profiles"))
        weekly = weekly.join(counted, ["user_id", "week"], "left")
        named.append(F.coalesce("profiles", F.lit(0)).cast("long").alias("number_of_profiles"))
    named.append(F.coalesce("errors", F.lit(0)).cast("long").alias("number_of_update_errors"))
    return weekly.select(
        "user_id", "week", week_number(F.col("week"), t, weeks).alias("week_number"), *named
    )


def wide_update_features(
    weekly: DataFrame, t: Instant, weeks: int = 8, drop_partial: bool = False
) -> DataFrame:
    """One row per user with the four weekly measures side by side."""
    numbers = [n for n in week_numbers(t, weeks) if not drop_partial or 0 <= n < weeks]
    return pivot_measures(weekly, "user_id", "week_number", numbers, WEEKLY_MEASURES)


def weekly_updates(
    updates: DataFrame, users: DataFrame, t: Instant, weeks: int = 10, sent_only: bool = True,
    since: Instant | None = None,
) -> DataFrame:
    """Distinct updates per user and week between ``since`` (or ``t - weeks``) and ``t``."""
    created = F.col("created_at")
    if since is None:
        recent = updates.where(in_lookback(created, t, weeks))
    else:
        recent = updates.where(created.between(instant(since), instant(t)))
    if sent_only:
        recent = recent.where("was_sent_with_product")
    per_update = packed_distinct(
        of_users(recent, users).select("user_id", week_start(created).alias("week"), "id")
    )
    return per_update.groupBy("user_id", "week").agg(F.count("id").alias("updates"))


def _with_calendar(weekly: DataFrame) -> tuple[DataFrame, Column]:
    """Weekly rows marked ``inside`` (not the first or last week), and the calendar.

    The calendar is one small struct over the few distinct weeks. It reads the same
    columns as the main branch and the edge weeks are masked rather than filtered,
    so both branches share one scan and one shuffle of the updates.
    """
    weeks = F.sort_array(F.collect_set(F.when(F.col("updates") > 0, F.col("week"))))
    inner = weekly.select(weeks.alias("w")).select(
        F.element_at("w", 1).alias("first"),
        F.element_at("w", -1).alias("last"),
        F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))).alias("inner"),
    )
    years = F.transform("inner", year_fraction)
    mean = F.try_divide(F.aggregate(years, F.lit(0.0), lambda a, x: a + x), F.size("inner"))
    centred = inner.withColumn("mean", mean)
    spread = F.aggregate(
        years, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))
    )
    calendar = centred.select(
        F.struct(
            "first", "last", "mean",
            F.size("inner").alias("weeks"),
            F.array_max("inner").alias("last_inner"),
            spread.alias("spread"),
        )
    ).scalar()
    inside = (F.col("week") > calendar.getField("first")) & (F.col("week") < calendar.getField("last"))
    return weekly.withColumn("inside", inside), calendar


def update_summary(
    updates: DataFrame, users: DataFrame, t: Instant, weeks: int = 10, sent_only: bool = True,
    since: Instant | None = None,
) -> DataFrame:
    """Weeks with updates, total updates and updates in the last complete week."""
    marked, calendar = _with_calendar(weekly_updates(updates, users, t, weeks, sent_only, since))
    counted = F.when(F.col("inside"), F.col("updates"))
    is_last = F.col("week") == calendar.getField("last_inner")
    return (
        marked.select("user_id", counted.alias("n"), is_last.alias("is_last"))
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("n") > 0).cast("long").alias("weeks_with_updates"),
            F.sum("n").alias("total_updates"),
            F.coalesce(F.sum(F.when(F.col("is_last"), F.col("n"))), F.lit(0)).alias("updates_last_week"),
        )
        .where("weeks_with_updates > 0")
    )


def update_growth(
    updates: DataFrame, users: DataFrame, t: Instant, weeks: int = 10, sent_only: bool = True,
    since: Instant | None = None,
) -> DataFrame:
    """Summary counts, updates per week and the yearly growth slope of weekly updates.

    The slope is the least-squares line over the completed user x week grid. All
    users share the same weeks, so the mean and spread of the time axis are
    constants, weeks without updates add nothing to the cross product, and the grid
    never has to be built.
    """
    marked, calendar = _with_calendar(weekly_updates(updates, users, t, weeks, sent_only, since))
    counted = F.when(F.col("inside"), F.col("updates"))
    lever = (year_fraction(F.col("week")) - calendar.getField("mean")) * counted
    sums = (
        marked.select("user_id", counted.alias("n"), lever.alias("lever"))
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("n") > 0).cast("long").alias("weeks_with_updates"),
            F.sum("n").alias("total_updates"),
            F.sum("lever").alias("lever"),
        )
        .where("weeks_with_updates > 0")
    )
    return sums.select(
        "user_id",
        "weeks_with_updates",
        "total_updates",
        F.try_divide(F.col("total_updates"), calendar.getField("weeks")).alias("updates_per_week"),
        F.try_divide(F.col("lever"), calendar.getField("spread")).alias("estimate"),
    )


def update_recency(
    updates: DataFrame, users: DataFrame, t: Instant, sent_only: bool = True
) -> DataFrame:
    """Days from the last update to the snapshot date."""
    past = updates.where(F.col("created_at") <= snapshot_date(t).cast("timestamp_ntz"))
    if sent_only:
        past = past.where("was_sent_with_product")
    weekly = packed_groups(
        of_users(past, users).select("user_id", week_start(F.col("created_at")).alias("week"), "created_at"),
        ["user_id", "week"],
        F.max("created_at").alias("last"),
    )
    days = F.datediff(snapshot_date(t), F.to_date(F.max("last")))
    return weekly.groupBy("user_id").agg(days.alias("days_since_last_update"))
