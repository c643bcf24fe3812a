"""The churn dataset at many snapshot dates from one pass over every source.

``dataset.snapshots`` builds each date by itself and reads all sources once per date. Here a
source is scanned and shuffled once: rows land in cells of time, counts are combined per
cell, and only these counts meet the dates (see ``operators.windows``). The rows are those
of the single builds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, as_datetime, instant, previous_week, shifted, snapshot_date, week_start, week_zero, week_numbers
from tenure.functions.values import true
from tenure.operators.grouping import packed_distinct, packed_groups
from tenure.operators.windows import Windows, distinct_steps, over_windows
from tenure.plans.accounts import user_features
from tenure.plans.activity import ANALYTICS_PREFIX, BILLING_PREFIX, EXTENSION, WEEKLY_MEASURES, of_users
from tenure.plans.cohort import ATTRIBUTES, CHARGE_COUNTS, EXCLUDED_PLANS
from tenure.session import stage
from tenure.sources.tables import Sources


def _sorted(dates: Sequence[Instant]) -> list[datetime]:
    found = sorted(as_datetime(t) for t in dates)
    if not found or len({t.date() for t in found}) < len(found):
        raise ValueError("snapshot dates must be given and differ")
    return found


def _passed(ts: Column, dates: Sequence[datetime]) -> Column:
    """How many of the sorted dates are not after ``ts``."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(ts >= instant(dates[middle]), within(middle + 1, high)).otherwise(within(low, middle))

    return F.when(ts.isNotNull(), within(0, len(dates)))


def charge_history(invoices: DataFrame, charges: DataFrame, subscription_ids: DataFrame, dates: Sequence[datetime]) -> DataFrame:
    """(subscription_id, ``history``): charges by outcome and by the first date that sees them.

    A charge counts at every date after both its own time and that of its invoice, so the
    earliest such time of each outcome decides for all dates. The list has an entry for each
    date at most.
    """
    last = instant(dates[-1])
    billed = packed_groups(
        invoices.where("paid and amount_due > 0").where(F.col("date") < last)
        .join(subscription_ids, "subscription_id", "left_semi")
        .select("subscription_id", F.col("id").alias("invoice"), "date"),
        ["subscription_id", "invoice"],
        F.min("date").alias("date"),
    )
    captured, paid, refunded = (F.col(c) for c in ("captured", "paid", "refunded"))
    outcomes = dict(zip(CHARGE_COUNTS, (captured & paid & ~refunded, refunded, ~paid & ~captured), strict=True))
    charged = charges.where(F.col("amount") > 0).where(F.col("created") < last).select(
        F.col("id").alias("charge"), "invoice", "created", *[true(c).alias(name) for name, c in outcomes.items()]
    )
    since = F.greatest("created", "date")
    per_charge = charged.join(billed, "invoice").groupBy("subscription_id", "charge").agg(
        F.min(since).alias("billed"), *[F.min(F.when(F.col(name), since)).alias(name) for name in outcomes]
    )
    known = F.col("charge").isNotNull()
    kinds = [("billed", F.lit(True)), *((name, known) for name in outcomes)]
    seen = F.array(*[F.struct(F.lit(name).alias("kind"), F.when(kept, _passed(F.col(name), dates)).alias("date")) for name, kept in kinds])
    entries = per_charge.select("subscription_id", F.explode(F.filter(seen, lambda s: s["date"].isNotNull())).alias("s")).select("subscription_id", "s.*")
    counted = packed_groups(entries, ["subscription_id", "date"], *[F.count_if(F.col("kind") == name).cast("long").alias(name) for name, _ in kinds])
    return counted.groupBy("subscription_id").agg(F.collect_list(F.struct("date", *[name for name, _ in kinds])).alias("history"))


def cohort_panel(
    src: Sources, dates: Sequence[Instant], attributes: Sequence[str] = tuple(ATTRIBUTES), horizon: int = 2, label: str = "churned_in_next_two_months"
) -> DataFrame:
    """``subscription_cohort`` at every date, tagged with the ``snapshot`` date."""
    found = _sorted(dates)
    canceled, created = F.col("canceled_at"), F.col("created_at")
    all_dates = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), snapshot_date(t).alias("snapshot"), shifted(t, years=-1).alias("since"),
                instant(t).alias("at"), shifted(t, months=horizon).alias("until"),
            )
            for i, t in enumerate(found)
        ]
    )
    seen = F.filter(all_dates, lambda d: created.between(d["since"], d["at"]) & (canceled.isNull() | (canceled > d["at"])))
    subscriptions = src["stripe_subscriptions"].where(
        (F.col("billing_interval") == "month") & ~F.col("simplified_plan_id").isin(EXCLUDED_PLANS) & (F.col("successful_charges") >= 1)
        & created.between(shifted(found[0], years=-1), instant(found[-1]))
    )
    named = [F.col("metadata_user_id" if c == "user_id" else c).alias(c) for c in {*attributes, "canceled_at"}]
    eligible = stage(subscriptions.select(F.col("id").alias("subscription_id"), *named, seen.alias("dates")).where(F.size("dates") > 0))
    history = charge_history(src["stripe_invoices"], src["stripe_charges"], eligible.select("subscription_id"), found)
    dated = eligible.select("*", F.explode("dates").alias("d"))
    ends = true(canceled.between(F.col("d.at"), F.col("d.until")))
    dated = packed_distinct(dated.select("subscription_id", *attributes, "d.snapshot", "d.i", ends.alias(label)))

    def until(name: str) -> Column:
        earlier = F.filter("history", lambda e: e["date"] <= F.col("i"))
        return F.aggregate(earlier, F.lit(0).cast("long"), lambda total, e: total + e[name]).alias(name)

    counted = dated.join(history, "subscription_id").select("subscription_id", *attributes, *[until(c) for c in CHARGE_COUNTS], label, "snapshot", until("billed"))
    return counted.where("billed > 0").drop("billed")


def _lookback(dates: Sequence[datetime], tags: Sequence[datetime], weeks: int) -> Windows:
    spans = [(t - timedelta(weeks=weeks), t) for t in dates]
    values = [
        {"snapshot": snapshot_date(tag), "last_week": F.lit(previous_week(t)), "zero": F.lit(week_zero(t, weeks))}
        for t, tag in zip(dates, tags, strict=True)
    ]
    return Windows(spans, values)


def _kinds(*kinds: tuple[str, Column | None, Column | None, Column | None]) -> Column:
    """(kind, week, id) entries of a row, each under a condition (none: always)."""
    entries = [
        F.when(F.lit(True) if when is None else when, F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(None).cast("date") if week is None else week).alias("week"),
            (F.lit(None).cast("string") if key is None else key.cast("string")).alias("id"),
        ))
        for kind, when, week, key in kinds
    ]
    return F.explode(F.array_compact(F.array(*entries))).alias("k")


def action_panel(actions: DataFrame, users: DataFrame, windows: Windows) -> DataFrame:
    """``action_features`` of every window: one row per user and snapshot with any action."""
    scope, created, week = F.col("full_scope"), F.col("created_at"), week_start(F.col("created_at"))
    billing, analytics = true(scope.startswith(BILLING_PREFIX)), true(scope.startswith(ANALYTICS_PREFIX))
    recent = F.array_contains(F.transform(windows.list(), lambda w: w["last_week"]), week)
    seen = of_users(actions.where(windows.holds(created)), users).select(
        "user_id", windows.cell(created).alias("cell"),
        _kinds(
            ("any", None, None, None), ("billing", billing, None, F.col("id")), ("billing_week", billing, week, None),
            ("analytics", analytics, None, F.col("id")), ("recent", recent, week, F.col("id")),
        ),
    )
    steps = distinct_steps(seen.select("user_id", "cell", "k.*"), ["user_id", "kind", "week"], "id")
    dealt = over_windows(steps, windows)

    def total(kind: str, also: Column | None = None) -> Column:
        own = F.col("kind") == kind
        return F.coalesce(F.sum(F.when(own if also is None else own & also, F.col("fresh"))), F.lit(0))

    return dealt.groupBy("user_id", F.col("w.snapshot").alias("snapshot")).agg(
        total("billing").alias("billing_actions"),
        total("analytics").alias("analytics_actions"),
        F.size(F.collect_set(F.when(F.col("kind") == "billing_week", F.col("week")))).cast("long").alias("number_of_weeks_with_actions"),
        total("recent", F.col("week") == F.col("w.last_week")).alias("actions_last_week"),
    )


def update_panel(updates: DataFrame, update_errors: DataFrame, users: DataFrame, windows: Windows, numbers: Sequence[int]) -> DataFrame:
    """``wide_update_features`` of every window: one row per user and snapshot with any update.

    ``numbers`` are the week numbers that become columns; a week that a window does not have is 0.
    """
    created, week = F.col("created_at"), week_start(F.col("created_at"))
    seen = stage(
        of_users(updates.where(windows.holds(created)), users).select(
            "user_id", F.col("id").alias("update_id"), week.alias("week"), windows.cell(created).alias("cell"),
            F.to_date(created).alias("day"), true(F.col("client_type") == EXTENSION).alias("extension"),
        )
    )
    rows = seen.select(
        "user_id", "cell",
        _kinds(
            ("number_of_updates", None, F.col("week"), F.col("update_id")), ("number_of_days_with_updates", None, F.col("week"), F.col("day")),
            ("number_of_extension_updates", F.col("extension"), F.col("week"), F.col("update_id")),
        ),
    ).select("user_id", "cell", "k.*")
    failed = update_errors.select("update_id", F.col("id").alias("error_id")).join(seen.select("user_id", "week", "update_id", "cell"), "update_id")
    errors = failed.select("user_id", "cell", F.lit("number_of_update_errors").alias("kind"), "week", F.col("error_id").cast("string").alias("id"))
    steps = distinct_steps(rows.unionByName(errors), ["user_id", "kind", "week"], "id")
    dealt = over_windows(steps, windows)
    # A Monday week begins a day after its Sunday.
    number = F.floor((F.datediff("week", F.col("w.zero")) - 1) / 7)
    cells = [
        F.sum(F.when((F.col("kind") == measure) & (number == n), F.col("fresh")).otherwise(0)).alias(f"{prefix}{str(n).replace('-', 'm')}")
        for measure, prefix in WEEKLY_MEASURES.items()
        for n in numbers
    ]
    return dealt.groupBy("user_id", F.col("w.snapshot").alias("snapshot")).agg(*cells)


def churn_panel(src: Sources, dates: Sequence[Instant], usage_dates: Sequence[Instant] | None = None, weeks: int = 8) -> DataFrame:
    """``churn_dataset`` at every date, tagged with the ``snapshot`` date, from one scan of each source.

    ``usage_dates`` are the cut-offs of the activity logs, one for each date. Dates may come in
    any order and may be closer than the lookback; two of one day are an error. A week column
    exists if any of the dates has that week.
    """
    tags = [as_datetime(t) for t in dates]
    usage = [as_datetime(t) for t in usage_dates or dates]
    if len(tags) != len(usage):
        raise ValueError("one usage date for each snapshot date")
    cohort = stage(cohort_panel(src, dates))
    owners = stage(cohort.select("user_id", "snapshot").distinct())
    users = stage(owners.select("user_id").distinct())
    windows = _lookback(usage, tags, weeks)
    numbers = sorted({n for t in usage for n in week_numbers(t, weeks)})
    features = owners.join(user_features(src["users"], users), "user_id")
    for part in (action_panel(src["actions_taken"], users, windows), update_panel(src["updates"], src["update_errors"], users, windows, numbers)):
        features = features.join(part, ["user_id", "snapshot"], "left")
    joined = cohort.join(stage(features), ["user_id", "snapshot"])
    own = [c for c in cohort.columns if c != "snapshot"]
    return joined.select(*own, *[c for c in features.columns if c not in ("user_id", "snapshot")], "snapshot")
