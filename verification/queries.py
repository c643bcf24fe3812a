"""One query per operator, each over the whole test tables.

Doubles are rounded through ``tidy`` so both engines print the same value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions import dates, values
from tenure.functions.values import tidy
from tenure.models import bagging, classifiers, design, features, kernel, logit, network, scoring, target_stats, validation
from tenure.operators import columns, ranking, rates, reshape, sampling, tally
from tenure.plans import accounts, activity, cohort, dataset, flags, panel, support
from tenure.session import stage, staging_root
from tenure.sources import files
from tenure.sources.tables import load_sources
from verification import binding as b

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def once(run: Callable) -> Callable:
    """What ``run`` returns for a session and folder, kept: a model is fitted once for all queries about it."""
    kept: dict[tuple[str, str], object] = {}

    @wraps(run)
    def found(spark: SparkSession, d: str) -> object:
        key = (spark.sparkContext.applicationId, d)
        if key not in kept:
            kept[key] = run(spark, d)
        return kept[key]

    return found


def _tidied(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            tidy(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- cohorts and labels -------------------------------------------------------


@query
def subscription_cohort(spark, d):
    return cohort.subscription_cohort(b.sources(spark, d), b.T)


@query
def cohort_via_users(spark, d):
    return cohort.subscription_cohort(
        b.sources(spark, d), b.T, plans=cohort.SCORED_PLANS, via_users=True,
        attributes=dataset.SCORING_ATTRIBUTES, label="did_churn",
    )


@query
def cohort_with_quantity(spark, d):
    return cohort.subscription_cohort(
        b.sources(spark, d), b.T, via_users=True,
        attributes=["customer_id", "user_id", "plan_id", "simplified_plan_id", "canceled_at",
                    "created_at", "quantity"],
    )


def _labelled(spark, d, as_of=b.T, churn_until="1998-10-01", created_until="1998-02-01"):
    labelled = cohort.snapshot_label(b.feature_file(spark, d), as_of, churn_until, created_until)
    return flags.derive_flags(labelled, as_of)


def _modelling(spark, d, **dates_):
    """Monthly rows with a named plan, as the models use them."""
    plan = F.col("simplified_plan_name")
    return _labelled(spark, d, **dates_).where(
        (F.col("billing_interval") == "month") & (plan != "reply") & plan.isNotNull() & (plan != "")
    )


@query
def snapshot_label(spark, d):
    return cohort.snapshot_label(b.feature_file(spark, d), b.T, "1998-06-01", "1998-02-01").select(
        "subscription_id", "did_churn", "was_active_end_of_year", "was_active_two_months"
    )


@query
def derived_flags(spark, d):
    df = flags.derive_flags(b.feature_file(spark, d), b.T)
    return _tidied(
        df.select(
            "subscription_id", "user_age", "subscription_age", "is_mobile_user", "is_idle",
            "updates_past_week", "number_of_profiles", "has_team_member", "has_failed_charge",
            "has_refunded_charge", "has_billing_actions", "has_analytics_actions", "no_updates",
        )
    )


@query
def modelling_rows(spark, d):
    """Category filter, then complete rows of the model columns only."""
    chosen = ["subscription_id", "did_churn", *features.LOGIT_REDUCED]
    return _tidied(_modelling(spark, d).select(*chosen).dropna())


# --- account features ---------------------------------------------------------


@query
def user_features(spark, d):
    src = b.sources(spark, d)
    return accounts.user_features(src["users"], stage(cohort.subscription_cohort(src, b.T)))


@query
def user_flags(spark, d):
    src = b.sources(spark, d)
    return accounts.user_flags(
        src["users"], src["user_team_member_facts"], src["user_client_facts"],
        b.all_users(spark, d),
    )


# --- activity features --------------------------------------------------------


@query
def action_features_prefix(spark, d):
    src = b.sources(spark, d)
    return activity.action_features(src["actions_taken"], b.all_users(spark, d), b.T_USAGE)


@query
def action_features_exact(spark, d):
    src = b.sources(spark, d)
    return activity.action_features(
        src["actions_taken"], b.all_users(spark, d), b.T_USAGE, match="exact", last_week=False
    )


def _weekly(spark, d):
    src = b.sources(spark, d)
    return activity.weekly_update_features(
        src["updates"], src["update_errors"], b.all_users(spark, d), b.T_USAGE
    )


@query
def weekly_update_features(spark, d):
    return _weekly(spark, d)


@query
def weekly_updates_shared_errors(spark, d):
    """One error id on several updates: it counts once for a user and week."""
    src = b.sources(spark, d)
    shared = src["update_errors"].withColumn("id", F.floor(F.col("id") / 40))
    return activity.weekly_update_features(src["updates"], shared, b.all_users(spark, d), b.T_USAGE)


@query
def weekly_updates_two_profiles(spark, d):
    """Every update under two profiles of its user: it stays one update."""
    src = b.sources(spark, d)
    second = F.col("user_id") * 10 + (F.col("profile_id") + 1) % 3
    twice = src["updates"].unionByName(src["updates"].withColumn("profile_id", second))
    return activity.weekly_update_features(
        twice, src["update_errors"], b.all_users(spark, d), b.T_USAGE, profiles=src["profiles"]
    )


@query
def weekly_updates_via_profiles(spark, d):
    src = b.sources(spark, d)
    return activity.weekly_update_features(
        src["updates"], src["update_errors"], b.all_users(spark, d), b.T_USAGE, sent_only=True,
        profiles=src["profiles"],
    )


@query
def wide_update_features(spark, d):
    return activity.wide_update_features(_weekly(spark, d), b.T_USAGE)


@query
def week_columns(spark, d):
    return reshape.week_columns(_weekly(spark, d), dates.week_numbers(b.T_USAGE))


@query
def window_span_counts(spark, d):
    wide = reshape.week_columns(_weekly(spark, d), dates.week_numbers(b.T_USAGE))
    return reshape.span_counts(wide, [c for c in wide.columns if c != "user_id"])


@query
def discovered_weeks(spark, d):
    return reshape.distinct_values(_weekly(spark, d), "week_number")


def _weekly_counts(spark, d):
    """Weekly counts, staged because trimming and completing read them several times."""
    updates = b.sources(spark, d)["updates"]
    return stage(activity.weekly_updates(updates, b.all_users(spark, d), b.T_USAGE))


@query
def trimmed_weeks(spark, d):
    return reshape.trim_edge_weeks(_weekly_counts(spark, d))


@query
def completed_grid(spark, d):
    trimmed = reshape.trim_edge_weeks(_weekly_counts(spark, d))
    return reshape.complete_grid(trimmed, "user_id", "week", "updates")


@query
def update_summary(spark, d):
    return activity.update_summary(b.sources(spark, d)["updates"], b.all_users(spark, d), b.T_USAGE)


@query
def update_growth(spark, d):
    return _tidied(
        activity.update_growth(b.sources(spark, d)["updates"], b.all_users(spark, d), b.T_USAGE)
    )


@query
def observed_week_slope(spark, d):
    """Per-user regression on the observed weeks only; one week has no slope."""
    return _tidied(
        _weekly_counts(spark, d)
        .groupBy("user_id")
        .agg(
            F.regr_slope(F.col("updates").cast("double"), dates.year_fraction(F.col("week"))).alias("slope"),
            (F.sum("updates") / F.count_distinct("week")).alias("per_week"),
        )
    )


@query
def update_recency(spark, d):
    return activity.update_recency(b.sources(spark, d)["updates"], b.all_users(spark, d), b.T_USAGE)


@query
def inactive_users(spark, d):
    return cohort.inactive_users(b.all_users(spark, d), b.sources(spark, d)["updates"])


@query
def inactive_users_preview(spark, d):
    absent = cohort.inactive_users(b.all_users(spark, d), b.sources(spark, d)["updates"])
    return absent.orderBy("user_id").limit(6)


@query
def support_emails(spark, d):
    return support.support_emails(b.sources(spark, d)["helpscout_conversations"])


@query
def support_email_features(spark, d):
    return support.support_email_features(
        b.sources(spark, d)["helpscout_conversations"], b.T_USAGE
    )


# --- assembled datasets -------------------------------------------------------


@query
def churn_dataset(spark, d):
    return dataset.churn_dataset(b.sources(spark, d), b.T, b.T_USAGE)


@query
def loaded_churn_dataset(spark, d):
    """The dataset from tables written to files and read in their declared types."""
    root = f"{staging_root(spark)}/tables-{uuid.uuid4().hex}"
    src = b.sources(spark, d)
    for name in src:
        src[name].write.parquet(f"{root}/{name}.parquet")
    return dataset.churn_dataset(load_sources(spark, root), b.T, b.T_USAGE)


@query
def scoring_dataset(spark, d):
    return _tidied(dataset.scoring_dataset(b.sources(spark, d), b.T, b.T_USAGE, growth=True))


@query
def clean_scoring_dataset(spark, d):
    df = dataset.scoring_dataset(b.sources(spark, d), b.T, b.T_USAGE, fill_recency=True)
    return _tidied(
        dataset.clean_scoring_dataset(df, b.T).select(
            "subscription_id", "user_age", "subscription_age", "has_refunded_charge",
            "has_failed_charge", "did_churn", "days_since_last_update", "is_idle",
        )
    )


@query
def feature_file_dataset(spark, d):
    """Flat export with its activity columns rebuilt from the logs."""
    file = b.feature_file(spark, d).drop(
        "days_since_last_update", "weeks_with_updates", "total_updates", "estimate",
        "billing_actions", "analytics_actions", "updates_per_week",
    )
    return _tidied(
        dataset.feature_file_dataset(
            file, b.sources(spark, d), as_of=b.T, active_from=b.T, churn_until="1998-10-01",
            created_until="1998-02-01", updates_since="2024-01-03", updates_until="2024-01-29",
            usage_t=b.T_USAGE,
        )
    )


@query
def train_and_validation_snapshots(spark, d):
    src = b.sources(spark, d)
    both = dataset.snapshots(lambda t: cohort.subscription_cohort(src, t), [b.T_EARLIER, b.T])
    return both.select(
        "snapshot", "subscription_id", "user_id", *cohort.CHARGE_COUNTS, "churned_in_next_two_months"
    )


@query
def snapshot_panel(spark, d):
    """Twelve overlapping snapshots, Sundays among them, from one pass over each source."""
    return panel.churn_panel(b.sources(spark, d), b.PANEL, b.PANEL_USAGE)


@query
def cohort_panel(spark, d):
    """Cohorts of three years by month; every subscription is seen at many dates."""
    months = [f"{year}-{month:02d}-01" for year in (1995, 1996, 1997) for month in range(1, 13)]
    found = panel.cohort_panel(b.sources(spark, d), months)
    return found.groupBy("snapshot").agg(
        F.count("*").alias("subscriptions"), F.count_distinct("user_id").alias("users"),
        *[F.sum(c).alias(c) for c in cohort.CHARGE_COUNTS], F.count_if("churned_in_next_two_months").alias("churned"),
    )


# --- scalar functions ---------------------------------------------------------


@query
def date_functions(spark, d):
    ts, ship = F.col("o_orderdate"), b.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(F.to_date(ts).cast("string"))
    return _tidied(
        ship.select(
            "o_orderkey",
            dates.week_start(ts).alias("week"),
            dates.week_number(ts, b.T).alias("week_number"),
            F.to_date(ts).alias("day"),
            (ts + F.expr("INTERVAL '2' MONTH")).alias("plus_two_months"),
            (ts - F.expr("INTERVAL 8 WEEKS")).alias("minus_eight_weeks"),
            dates.days_between(ts, dates.snapshot_date(b.T)).alias("days"),
            dates.parse_date(text).alias("parsed"),
            dates.year_fraction(F.to_date(ts)).alias("year_fraction"),
        )
    )


@query
def value_functions(spark, d):
    price, name = F.col("c_acctbal"), F.col("c_name")
    code = F.when(F.col("c_custkey") % 3 == 0, "t").when(F.col("c_custkey") % 3 == 1, "f")
    number = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(
        F.format_number(F.floor(price * 10).cast("long"), 0)
    )
    whole = F.floor(F.abs(price)).cast("long")
    return _tidied(
        b.table(spark, d, "customer").select(
            "c_custkey",
            values.digest(name).alias("name_hash"),
            values.joined_text(name, F.lit(" "), values.empty_to_null(code)).alias("joined"),
            F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
            values.spelled_flag(code, "t", "f").alias("flag"),
            values.grouped_number(number).alias("number"),
            values.log_or_zero(price).alias("log_balance"),
            F.log1p(F.abs(price)).alias("log1p_balance"),
            F.when(price >= 0, F.sqrt(F.abs(price))).alias("root_balance"),
            F.round(price / 7, 2).alias("rounded"),
            whole.cast("int").alias("whole"),
            code.isNotNull().alias("has_code"),
            F.coalesce(F.nullif(code, F.lit("t")), F.lit("none")).alias("code_or_none"),
            values.hash_uniform(F.col("c_custkey"), seed=7).alias("uniform"),
        )
    )


@query
def standardized(spark, d):
    return _tidied(
        tally.standardized(_labelled(spark, d), "subscription_age", "age_scaled").select(
            "subscription_id", "age_scaled"
        )
    )


# --- exploration --------------------------------------------------------------


@query
def class_balance(spark, d):
    return _tidied(tally.share(_labelled(spark, d), ["did_churn"]))


def _flag_share(flag):
    def run(spark, d):
        return _tidied(tally.positive_share(_labelled(spark, d), flag, "did_churn"))

    return run


for _flag in ("is_mobile_user", "updates_past_week", "has_failed_charge", "has_refunded_charge"):
    REGISTRY[f"share_by_{_flag}"] = _flag_share(_flag)


@query
def share_within_label(spark, d):
    return _tidied(
        tally.share(
            _labelled(spark, d), ["did_churn", "weeks_with_updates"], within=["did_churn"],
            distinct="subscription_id",
        )
    )


def _measures(spark, d):
    return b.table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").alias("returned")
    )


@query
def density_raw(spark, d):
    return _tidied(
        tally.density_profile(_measures(spark, d), F.col("l_quantity"), "returned", 0.0, 40.0, 40)
    )


@query
def density_log(spark, d):
    return _tidied(
        tally.density_profile(_measures(spark, d), F.log1p("l_extendedprice"), "returned", 0.0, 12.0, 48)
    )


@query
def density_root(spark, d):
    """Square root of a signed measure: negative values have no root and drop out."""
    x = F.sqrt(F.col("estimate"))
    return _tidied(tally.density_profile(_labelled(spark, d), x, "did_churn", -10.0, 10.0, 40))


@query
def density_scaled(spark, d):
    scaled = tally.standardized(_labelled(spark, d), "subscription_age", "age_scaled")
    return _tidied(tally.density_profile(scaled, F.col("age_scaled"), "did_churn", -4.0, 4.0, 32))


@query
def density_smooth(spark, d):
    profile = tally.density_profile(_measures(spark, d), F.col("l_quantity"), "returned", 0.0, 50.0, 50)
    return _tidied(tally.smooth_density(profile, "returned", 0.0, 50.0, 64))


@query
def histogram(spark, d):
    return tally.histogram(_labelled(spark, d), F.col("number_of_profiles"), 250.0, low=0.0, high=8000.0)


@query
def ecdf(spark, d):
    return _tidied(tally.ecdf(_labelled(spark, d), "days_since_last_update", "did_churn"))


@query
def ecdf_continuous(spark, d):
    return _tidied(tally.ecdf(_measures(spark, d), "l_extendedprice", "returned"))


@query
def label_correlations(spark, d):
    profiles, updates, days = (
        F.col(c) for c in ("number_of_profiles", "total_updates", "days_since_last_update")
    )
    measures = {
        "profiles": profiles, "log_profiles": F.ln(profiles),
        "updates": updates, "log_updates": values.log_or_zero(updates),
        "days": days, "log_days": F.log1p(days),
    }
    return _tidied(tally.label_correlations(_labelled(spark, d), measures, "did_churn"))


@query
def moments_by_label(spark, d):
    return _tidied(
        _measures(spark, d).groupBy("returned").agg(
            F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")
        )
    )


@query
def deciles(spark, d):
    q = tally.exact_quantiles(_measures(spark, d), "l_extendedprice", rates.DECILES)
    return _tidied(q.select(F.posexplode("quantiles").alias("decile", "value")))


@query
def deciles_by_label(spark, d):
    q = tally.exact_quantiles(_measures(spark, d), "l_extendedprice", rates.DECILES, ["returned"])
    return _tidied(q.select("returned", F.posexplode("quantiles").alias("decile", "value")))


@query
def growth_extremes(spark, d):
    users, updates = b.all_users(spark, d), b.sources(spark, d)["updates"]
    slopes = activity.update_growth(updates, users, b.T_USAGE).select(
        "user_id", F.round("estimate", 6).alias("estimate")
    )
    trimmed = reshape.trim_edge_weeks(_weekly_counts(spark, d))
    return _tidied(tally.growth_extremes(slopes, trimmed))


# --- splits, one-variable models, evaluation ----------------------------------


def _split(spark, d):
    """Documents with quality labels: a score, a label and a key."""
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = b.table(spark, d, "labels")
    return labels.join(docs, "doc_id").withColumn("bad", F.col("quality") == 0)


@query
def hash_split(spark, d):
    train, test = sampling.hash_split(b.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 11)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def hash_split_missing_keys(spark, d):
    """Rows without a key are in exactly one part."""
    key = F.col("o_orderkey")
    rows = b.table(spark, d, "orders").select(F.when(key % 7 != 0, key).alias("k"), key.alias("row"))
    train, test = sampling.hash_split(rows, "k", 0.8, 11)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def stratified_folds(spark, d):
    rows = _labelled(spark, d).select("subscription_id", "did_churn")
    return sampling.stratified_folds(rows, "subscription_id", "did_churn", 5, 1)


@query
def three_way_holdout(spark, d):
    earlier = _labelled(spark, d, as_of=b.T_EARLIER, churn_until="1998-04-01", created_until="1997-11-01")
    later = _labelled(spark, d)
    chosen = ["subscription_id", "did_churn"]
    return sampling.holdout(earlier.select(*chosen), later.select(*chosen), "subscription_id", seed=3)


@query
def random_baseline(spark, d):
    rows = _labelled(spark, d).select("subscription_id", "did_churn")
    train, test = sampling.hash_split(rows, "subscription_id", 0.8, 5)
    return sampling.random_baseline(train, test, "subscription_id", "did_churn", 9)


@query
def level_rates(spark, d):
    return _tidied(rates.fit_rate_table(_labelled(spark, d), "signup_client_name", "did_churn"))


@query
def categorical_rate_model(spark, d):
    rows = _labelled(spark, d).select("subscription_id", "signup_client_name", "did_churn")
    train = rows.where(F.coalesce("signup_client_name", F.lit("")) != "client 3")
    table = rates.fit_rate_table(train, "signup_client_name", "did_churn")
    return _tidied(
        rates.apply_rate_table(rows, table, "signup_client_name").select("subscription_id", "prediction")
    )


@query
def binned_rate_model(spark, d):
    rows = _labelled(spark, d).select("subscription_id", "total_updates", "days_since_last_update", "did_churn")
    train, _ = sampling.hash_split(rows, "subscription_id", 0.8, 2)
    train = stage(train)
    cuts, table = rates.fit_binned_rate(train, "days_since_last_update", "did_churn")
    scored = rates.apply_binned_rate(rows, cuts, table, "days_since_last_update")
    return _tidied(scored.select("subscription_id", "prediction"))


@query
def single_variable_report(spark, d):
    rows = _labelled(spark, d).withColumn(
        "is_train", values.hash_uniform(F.col("subscription_id"), seed=4) <= 0.8
    )
    return _tidied(
        rates.single_variable_report(
            rows,
            features.SINGLE_CATEGORICAL,
            features.SINGLE_NUMERIC,
            "did_churn",
        )
    )


@query
def sketched_deciles(spark, d):
    """Deciles from merged sketches of parts: values below and up to each estimate enclose the wanted rank."""
    rows = stage(b.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"))
    names = ["l_quantity", "l_extendedprice"]
    parts = tally.quantile_sketches(rows, names, ["l_returnflag", "l_linestatus"])
    found = tally.sketched_quantiles(parts, rates.DECILES, ["l_returnflag"])
    # One row for each flag, variable and decile, so the broadcast is bounded.
    points = found.select("l_returnflag", "variable", "n", F.posexplode("quantiles").alias("i", "q"))
    values = rows.select("l_returnflag", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("x")) for c in names])))
    ranked = values.join(F.broadcast(points), ["l_returnflag", "variable"]).groupBy("l_returnflag", "variable", "i", "n").agg(
        F.count_if(F.col("x") < F.col("q")).alias("below"), F.count_if(F.col("x") <= F.col("q")).alias("up_to")
    )
    p = F.col("i") / 10
    close = (F.col("below") / F.col("n") <= p + 0.01) & (F.col("up_to") / F.col("n") >= p - 0.01)
    return ranked.select("l_returnflag", "variable", p.alias("p"), "n", close.alias("close"))


@query
def sketched_report(spark, d):
    """One-variable models whose cuts come from sketches rank nearly like the exact ones.

    A decile may fall on a neighbouring value, which moves the area a little where values are few.
    """
    rows = stage(_labelled(spark, d).withColumn("is_train", values.hash_uniform(F.col("subscription_id"), seed=4) <= 0.8))
    exact, near = (
        rates.single_variable_report(rows, features.SINGLE_CATEGORICAL, features.SINGLE_NUMERIC, "did_churn", exact=e) for e in (True, False)
    )
    both = exact.join(near.select("variable", F.col("train_auc").alias("train"), F.col("test_auc").alias("test")), "variable")
    return both.select("variable", (F.abs(F.col("train_auc") - F.col("train")) < 0.05).alias("same_train"), (F.abs(F.col("test_auc") - F.col("test")) < 0.05).alias("same_test"))


@query
def support_emails_malformed(spark, d):
    """Documents that are cut off, empty, of another shape or missing have no fields."""
    talks = b.sources(spark, d)["helpscout_conversations"]
    broken = {c: F.when(F.col("id") % 6 == i, F.substring(c, 1, 9)).when(F.col("id") % 12 == i + 6, F.lit('[1, "x"]')).when(F.col("id") % 24 == 5, F.lit(None)).otherwise(F.col(c))
              for i, c in enumerate(("mailbox", "createdby", "customer"))}
    return support.support_emails(talks.withColumns(broken))


@query
def auc(spark, d):
    return _tidied(ranking.auc(_split(spark, d), "n_chars", "bad"))


@query
def auc_by_group(spark, d):
    return _tidied(ranking.auc(_measures(spark, d).withColumn("grp", F.floor(F.col("l_quantity") / 10)),
                               "l_extendedprice", "returned", ["grp"]))


@query
def roc_curve(spark, d):
    return _tidied(ranking.roc_curve(_split(spark, d), "n_chars", "bad"))


def _scored_lines(spark, d):
    return _measures(spark, d).withColumn("score", F.col("l_quantity") / 50)


@query
def confusion_matrix(spark, d):
    return ranking.confusion(_scored_lines(spark, d), "score", "returned", 0.2)


@query
def contingency_table(spark, d):
    return tally.contingency(_scored_lines(spark, d), F.col("score") >= 0.15, F.col("returned"))


@query
def threshold_metrics(spark, d):
    return _tidied(ranking.threshold_metrics(_scored_lines(spark, d), "score", "returned", 0.15))


# --- column sets, files and sinks ---------------------------------------------


@query
def one_hot_aligned(spark, d):
    """Training levels found in one part of the accounts applied to all of them."""
    users = b.sources(spark, d)["users"].select("id", "timezone", "twofactor_type", "is_approved")
    train = users.where(F.col("timezone") != "MACHINERY")
    levels = reshape.level_lists(reshape.find_levels(train, ["timezone", "twofactor_type"]))
    template = [*reshape.one_hot(train, levels).columns, "timezone_MARS"]
    aligned = reshape.align_columns(reshape.one_hot(users, levels), template)
    return aligned.withColumnsRenamed({c: c.lower() for c in aligned.columns})


@query
def sparse_levels(spark, d):
    """Indicator slots of a column with a level for every row and of one with few levels."""
    rows = b.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    names = ["c_name", "c_mktsegment"]
    coded = reshape.encode_levels(rows, reshape.find_levels(rows, names), names)
    return coded.select("c_custkey", F.element_at("slots", 1).alias("name_slot"), F.element_at("slots", 2).alias("segment_slot"))


@query
def column_operations(spark, d):
    """Star-except over a join, dropped range, renamed and cleaned names, filled blanks."""
    src = b.sources(spark, d)
    facts, users = src["user_team_member_facts"], src["users"].withColumnRenamed("id", "user_id")
    joined = users.join(facts, "user_id", "left").select(
        *columns.star_except(users, ["timezone"]), facts["number_of_team_members"]
    )
    kept = columns.drop_range(joined, "billing_stripe_customer_id", "has_verified_email")
    titled = kept.withColumnsRenamed({"twofactor_type": "Two-Factor Type", "created_at": "Created At"})
    return columns.fill_missing(columns.clean_names(titled))


@query
def csv_roundtrip(spark, d):
    rows = b.feature_file(spark, d).select(
        "subscription_id", "signup_date", "canceled_at", "signup_client_name", "number_of_profiles",
        "days_since_last_update", "estimate",
    )
    path = os.path.join(staging_root(spark), f"csv-{uuid.uuid4().hex}")
    files.write_csv(rows, path, compression="gzip")
    return _tidied(files.read_csv(spark, path, rows.schema))


@query
def csv_by_uri(spark, d):
    """Written to a store named by its URI, in parts; Hadoop's file systems decide where that is."""
    rows = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    root = staging_root(spark)
    root = root if ":/" in root else f"file://{os.path.abspath(root)}"
    path = f"{root}/export-{uuid.uuid4().hex}"
    files.write_csv(rows.repartition(3), path)
    return _tidied(files.read_csv(spark, path, rows.schema))


@query
def clustered_table(spark, d):
    path = os.path.join(staging_root(spark), f"table-{uuid.uuid4().hex}")
    files.materialize(cohort.subscription_cohort(b.sources(spark, d), b.T), path, "user_id")
    return spark.read.parquet(path).groupBy("user_id").agg(
        F.count("*").alias("subscriptions"), F.sum("successful_charges").alias("charges")
    )


@query
def upsert_predictions(spark, d):
    orders = b.table(spark, d, "orders")
    key = F.col("o_orderkey")
    old = orders.where(key % 3 != 0).select(key.alias("id"), F.col("o_totalprice").alias("p"))
    new = orders.where(key % 4 == 0).select(key.alias("id"), (F.col("o_totalprice") * 2).alias("p"))
    return _tidied(files.upsert(old, new, ["id"]))


@query
def upsert_missing_keys(spark, d):
    """A batch with repeated and missing keys; the larger version of a key stays."""
    orders, key = b.table(spark, d, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice")
    old = orders.where(key % 3 != 0).select(F.when(key % 50 != 1, key).alias("id"), price.alias("p"), F.lit(0).alias("version"))
    new = orders.where(key % 4 == 0).select(key.alias("id"), (price * 2).alias("p"), F.lit(1).alias("version"))
    again = new.withColumns({"p": F.col("p") + 1, "version": F.lit(2)})
    missing = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(-1.0).alias("p"), F.lit(3).alias("version"))
    batch = new.unionByName(again).unionByName(missing)
    return _tidied(files.upsert(old, batch, ["id"], latest_by="version"))


@query
def upsert_touched_partitions(spark, d):
    """Only the partitions that the batch touches are rewritten; the table stays whole."""
    orders, key = b.table(spark, d, "orders"), F.col("o_orderkey")
    rows = orders.select(key.alias("id"), F.col("o_totalprice").alias("p"), (key % 5).cast("int").alias("bucket"))
    path = f"{staging_root(spark)}/upserts-{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(path)
    batch = rows.where("bucket = 2").withColumn("p", F.col("p") * 2)
    return _tidied(files.upsert_partitions(spark, path, batch, ["id"], "bucket"))


@query
def upsert_missing_partition(spark, d):
    """A batch for the partition of rows without a bucket leaves their other rows alone."""
    orders, key = b.table(spark, d, "orders"), F.col("o_orderkey")
    bucket = F.when(key % 5 != 3, (key % 5).cast("int")).alias("bucket")
    rows = orders.select(key.alias("id"), F.col("o_totalprice").alias("p"), bucket)
    path = f"{staging_root(spark)}/upserts-{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(path)
    batch = rows.where("bucket is null and id % 2 = 0").withColumn("p", F.col("p") * 2)
    return _tidied(files.upsert_partitions(spark, path, batch, ["id"], "bucket"))


@query
def duplicate_keys(spark, d):
    return files.duplicate_keys(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- models -------------------------------------------------------------------


def _train_test(spark, d):
    return sampling.hash_split(stage(_modelling(spark, d)), "subscription_id", 0.8, 6)


@query
def logit_coefficients(spark, d):
    train, _ = _train_test(spark, d)
    fitted = logit.fit_logit(train, features.LOGIT_FULL, "did_churn", features.LOGIT_SCALED)
    return fitted.coefficients()


@query
def logit_fit_statistics(spark, d):
    train, _ = _train_test(spark, d)
    tables = []
    for name, chosen in LOGITS.items():
        scaled = [] if name == "final" else features.LOGIT_SCALED
        fitted = logit.fit_logit(train, chosen, "did_churn", scaled)
        tables.append(fitted.fit_statistics().withColumn("model", F.lit(name)))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


LOGITS = {"full": features.LOGIT_FULL, "reduced": features.LOGIT_REDUCED, "final": features.LOGIT_FINAL}


def _balance(spark, rows, chosen, scaled, name):
    """Totals of every term weighted with the fitted probability, over the rows of the fit."""
    rows = stage(rows.select(*chosen, "did_churn").dropna())
    scored = logit.predict_logit(logit.fit_logit(rows, chosen, "did_churn", scaled).pipeline, rows)
    text = [c for c in chosen if dict(rows.dtypes)[c] == "string"]
    numeric = {c: F.col(c).cast("double") for c in chosen if c not in text}
    terms = {"intercept": F.lit(1.0), **numeric}
    totals = scored.agg(*[F.sum(x * F.col("pred")).alias(term) for term, x in terms.items()])
    parts = [totals.unpivot([], list(terms), "term", "total")]
    for c in text:
        parts.append(scored.groupBy(F.concat(F.lit(f"{c} "), F.col(c)).alias("term")).agg(F.sum("pred").alias("total")))
    every = reduce(DataFrame.unionByName, parts)
    return every.select(F.lit(name).alias("model"), "term", F.round("total", 1).alias("total"))


@query
def logit_balance_equations(spark, d):
    """At the optimum the fitted probabilities reproduce every observed total, which fixes the coefficients."""
    rows = stage(_modelling(spark, d))
    parts = [
        _balance(spark, rows, chosen, [] if name == "final" else features.LOGIT_SCALED, name)
        for name, chosen in LOGITS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def scoring_balance_equations(spark, d):
    return _balance(spark, _scoring_data(spark, d), features.LOGIT_SCORING, [], "scoring")


@query
def logit_scores(spark, d):
    train, test = _train_test(spark, d)
    model = logit.fit_logit(train, features.LOGIT_REDUCED, "did_churn", features.LOGIT_SCALED)
    return logit.predict_logit(model.pipeline, test).select("subscription_id", "did_churn", "pred")


@once
def _out_of_time_scores(spark, d):
    earlier = stage(_modelling(spark, d, as_of=b.T_EARLIER, churn_until="1998-07-01", created_until="1997-11-01"))
    tagged = sampling.holdout(earlier, _modelling(spark, d), "subscription_id", seed=3)
    train = tagged.where("part = 'train'")
    model = logit.fit_logit(train, features.LOGIT_REDUCED, "did_churn", features.LOGIT_SCALED)
    return stage(logit.predict_logit(model.pipeline, tagged).select("part", "did_churn", "pred"))


def _out_of_time(spark, d):
    return validation.validate(_out_of_time_scores(spark, d), "pred", "did_churn", 0.15, ["part"])


@query
def out_of_time_validation(spark, d):
    """Model of the earlier snapshot evaluated on its test rows and on the later one."""
    return _out_of_time(spark, d)


def _rows_and_positives(metrics, *by):
    """What a table of outcomes says about the rows behind it."""
    return metrics.select(
        *by, (F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")).alias("n"), (F.col("fn") + F.col("tp")).alias("positives"),
        F.col("auc").between(0.0, 1.0).alias("valid_auc"),
    )


@query
def out_of_time_rows(spark, d):
    """The validation evaluates every complete row of each part once."""
    return _rows_and_positives(_out_of_time(spark, d), "part")


@once
def _scoring_data(spark, d):
    return scoring.scoring_batch(b.sources(spark, d), b.T, b.T_USAGE)


@once
def _scoring_job(spark, d):
    """The job twice over the same batch: fitted and saved, then loaded."""
    root = f"{staging_root(spark)}/job-{uuid.uuid4().hex}"
    src, run_ts, batch = b.sources(spark, d), "2024-02-01 06:00:00", _scoring_data(spark, d)
    scoring.run_scoring(
        spark, src, b.T, run_ts, (None, f"{root}/features1"), (None, f"{root}/predictions1"),
        save_model_to=f"{root}/model", usage_t=b.T_USAGE, batch=batch,
    )
    predictions = scoring.run_scoring(
        spark, src, b.T, run_ts, (f"{root}/features1", f"{root}/features2"),
        (f"{root}/predictions1", f"{root}/predictions2"), model_path=f"{root}/model", usage_t=b.T_USAGE, batch=batch,
    )
    return spark.read.parquet(f"{root}/features2"), predictions


@query
def scoring_job_features(spark, d):
    table, _ = _scoring_job(spark, d)
    return _tidied(
        table.select(
            "subscription_id", "user_age", "subscription_age", "has_refunded_charge", "has_failed_charge",
            "days_since_last_update", "is_idle", "features_created_at",
        )
    )


@query
def scoring_job_predictions(spark, d):
    """One valid prediction for each subscription, with the run's name and time."""
    _, predictions = _scoring_job(spark, d)
    p = F.col("churn_probability")
    return predictions.select(
        "subscription_id", "created_at", "model_name", "model_version", p.between(0.0, 1.0).alias("valid"),
        F.col("id").endswith("2024-02-01 06:00:00logistic_regression0.1").alias("named"),
    )


@query
def scored_subscriptions(spark, d):
    """The scoring job's model and output rows."""
    data = _scoring_data(spark, d)
    model = logit.fit_logit(data, features.LOGIT_SCORING, "did_churn").pipeline
    return scoring.score(model, data, "2024-02-01 06:00:00")


@query
@once
def forest_scores(spark, d):
    train, test = _train_test(spark, d)
    model = classifiers.fit_forest(train, features.FOREST_FULL, "did_churn")
    return classifiers.predict_classifier(model, test).select("subscription_id", "did_churn", "pred")


def _in_range(scored, margin=False):
    """Which rows of a test set have a valid score."""
    valid = F.col("pred").isNotNull() & (F.lit(margin) | F.col("pred").between(0.0, 1.0))
    return scored.select("subscription_id", "did_churn", valid.alias("scored"))


@query
def forest_scored_rows(spark, d):
    return _in_range(forest_scores(spark, d))


@query
def network_scored_rows(spark, d):
    return _in_range(network_scores(spark, d))


@query
def support_vector_scored_rows(spark, d):
    return _in_range(support_vector_scores(spark, d), margin=True)


@query
@once
def forest_importance(spark, d):
    train, _ = _train_test(spark, d)
    model = classifiers.fit_forest(train, features.FOREST_NO_PROFILES, "did_churn")
    return classifiers.importance(model, features.FOREST_NO_PROFILES)


@query
def forest_importance_total(spark, d):
    return forest_importance(spark, d).agg(
        F.count("feature").alias("n"), F.round(F.sum("importance"), 6).alias("total"), F.min(F.col("importance") >= 0).alias("valid")
    )


@query
def exchanged_columns(spark, d):
    """Exchanging a column between rows keeps the number of rows with each of its values."""
    _, test = _train_test(spark, d)
    chosen = features.FOREST_RECENCY
    rows = test.select("subscription_id", *chosen).dropna()
    other = stage(classifiers.exchanged_rows(rows, chosen, "subscription_id"))
    text = [c for c in chosen if dict(rows.dtypes)[c] == "string"]
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(f"other.{c}").cast("string" if c in text else "long").cast("string").alias("value"))
        for c in chosen
    ]
    return other.select(F.inline(F.array(*cells))).groupBy("name", "value").agg(F.count("*").alias("n"))


@query
def permutation_importance(spark, d):
    train, test = _train_test(spark, d)
    model = classifiers.fit_forest(train, features.FOREST_RECENCY, "did_churn")
    return classifiers.permutation_importance(
        model, test, features.FOREST_RECENCY, "did_churn", "subscription_id"
    )


@query
def forest_variants_auc(spark, d):
    """Exact test AUC of the four forest feature sets."""
    train, test = _train_test(spark, d)
    parts = []
    for name, chosen in {
        "full": features.FOREST_FULL, "no_profiles": features.FOREST_NO_PROFILES,
        "recency": features.FOREST_RECENCY, "signup": features.FOREST_SIGNUP,
    }.items():
        model = classifiers.fit_forest(train, chosen, "did_churn")
        scored = classifiers.predict_classifier(model, test)
        parts.append(scored.select(F.lit(name).alias("model"), "did_churn", "pred"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return ranking.auc(every, "pred", "did_churn", ["model"])


@once
def _folds(spark, d):
    """Five stratified folds of the one-hot flat file."""
    matrix = _flat_matrix(_labelled_file(spark, d))
    inputs = [c for c in matrix.columns if c not in ("id", "subscription_id", "did_churn", "was_active_end_of_year", "was_active_two_months")]
    return classifiers.cross_validate(matrix, inputs, "did_churn", "subscription_id")


@query
def forest_cross_validation(spark, d):
    return _folds(spark, d)


@query
def forest_cross_validation_folds(spark, d):
    return _folds(spark, d).select("fold", "n", "positives")


# Only the number of profiles starts at one.
POSITIVE_LOGS = ["number_of_profiles"]
ZERO_BASED_LOGS = [c for c in features.NETWORK_LOG if c not in POSITIVE_LOGS]


@query
def recipe_matrix(spark, d):
    """Log, indicator, centre and scale, unpacked to columns."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    inputs = features.NETWORK
    rows = stage(_modelling(spark, d).select("subscription_id", *inputs).dropna())
    stages, names = classifiers.fit_recipe(rows, inputs, ZERO_BASED_LOGS, POSITIVE_LOGS)
    matrix = PipelineModel(stages).transform(rows).select(
        "subscription_id", vector_to_array(design.FEATURES).alias("x")
    )
    return matrix.select(
        "subscription_id", *[tidy(F.col("x")[i]).alias(n.lower()) for i, n in enumerate(names)]
    )


@query
@once
def network_scores(spark, d):
    train, test = _train_test(spark, d)
    model = classifiers.fit_mlp(train, features.NETWORK, "did_churn", ZERO_BASED_LOGS, POSITIVE_LOGS)
    return classifiers.predict_classifier(model, test).select("subscription_id", "did_churn", "pred")


@query
@once
def support_vector_scores(spark, d):
    train, test = _train_test(spark, d)
    model = classifiers.fit_svc(train, features.LOGIT_REDUCED, "did_churn")
    return classifiers.predict_classifier(model, test).select("subscription_id", "did_churn", "pred")


def _export(spark, d, t, horizon=2):
    """Exported training file: booleans spelled t / f, five text categories."""
    src = b.sources(spark, d)
    cohort_ = cohort.subscription_cohort(src, t, horizon=horizon)
    users = accounts.user_features(src["users"], cohort_)
    df = cohort_.join(users, "user_id")
    spelled = {c: F.when(F.col(c), "t").otherwise("f") for c in features.EXPORT_FLAGS}
    return df.withColumns(spelled)


def _levels(df, names):
    return reshape.level_lists(reshape.find_levels(df, names))


@query
def prepared_export(spark, d):
    train, later = stage(_export(spark, d, b.T_EARLIER)), stage(_export(spark, d, b.T))
    prepared, aligned = validation.train_and_validation(train, later, _levels(train, features.EXPORT_CATEGORIES))
    both = prepared.withColumn("part", F.lit("train")).unionByName(
        aligned.withColumn("part", F.lit("validation"))
    )
    return columns.clean_names(both)


def _labelled_file(spark, d):
    return cohort.snapshot_label(b.feature_file(spark, d), b.T, "1998-10-01", "1998-02-01")


def _flat_matrix(file):
    """Flat feature file as the numeric matrix of the cross-validated forest."""
    file = file.withColumn("number_of_profiles", values.grouped_number(F.col("number_of_profiles")))
    matrix = validation.prepare_export(
        file, _levels(file, features.FLAT_CATEGORIES), flags=features.FLAT_FLAGS, spelling=("Yes", "No"),
        dropped=[c for c in features.FLAT_DROPPED if c != "subscription_id"],
    )
    return columns.clean_names(matrix)


@query
def flat_file_matrix(spark, d):
    return _tidied(_flat_matrix(b.feature_file(spark, d)))


@query
@once
def export_validation(spark, d):
    """Support vectors fitted on the earlier export, ranked on the later one.

    A one-year horizon leaves cancellations to learn from at every test scale.
    """
    exported = stage(_export(spark, d, b.T_EARLIER, 12))
    train, later = (
        columns.clean_names(df)
        for df in validation.train_and_validation(
            exported, stage(_export(spark, d, b.T, 12)), _levels(exported, features.EXPORT_CATEGORIES)
        )
    )
    label = "churned_in_next_two_months"
    inputs = [c for c in train.columns if c not in ("subscription_id", label)]
    model = classifiers.fit_svc(train, inputs, label)
    scored = stage(classifiers.predict_classifier(model, later).select(label, "pred"))
    return validation.validate(scored, "pred", label, 0.0)


@query
def export_validation_rows(spark, d):
    """The later export is evaluated row by row."""
    return _rows_and_positives(export_validation(spark, d))


# --- what follows from fitted models, computed a second time --------------------


def _agree(scored, label, threshold, by):
    """The library's metrics of staged scores next to the same ones from a plain SQL text.

    The second area is that of mean ranks. What the models decide themselves cannot be
    known here; sizes and positives are those of the rows, and the flags say that both agree.
    """
    spark, name = scored.sparkSession, f"scored_{uuid.uuid4().hex}"
    found = validation.validate(scored, "pred", label, threshold, [by])
    scored.createOrReplaceTempView(name)
    again = spark.sql(f"""
        with ranked as (
          select *, cast({label} as int) as y,
                 rank() over (partition by {by} order by pred) + (count(*) over (partition by {by}, pred) - 1) / 2.0D as place
          from {name} where pred is not null),
        counted as (
          select {by}, count(*) as rows, sum(y) as positives, sum(if(y = 1, place, 0)) as places,
                 count_if(pred >= {threshold} and y = 1) as hits, count_if(pred >= {threshold}) as flagged
          from ranked group by {by})
        select *, try_divide(places - positives * (positives + 1) / 2.0D, cast(positives as double) * (rows - positives)) as area from counted""")
    both = found.join(again, by)

    def near(x, y):
        return F.coalesce(F.abs(F.col(x) - y) < 1e-9, F.col(x).isNull() & y.isNull())

    return both.select(
        by, F.col("rows").alias("n"), "positives", near("auc", F.col("area")).alias("same_auc"),
        ((F.col("tp") == F.col("hits")) & (F.col("tp") + F.col("fp") == F.col("flagged")) & (F.col("tn") + F.col("fn") == F.col("rows") - F.col("flagged"))).alias("same_counts"),
        near("precision", F.try_divide("hits", "flagged")).alias("same_precision"), near("recall", F.try_divide("hits", "positives")).alias("same_recall"),
    )


@query
def classifier_metrics_agree(spark, d):
    """Forest, network and support vectors on the test rows."""
    parts = [
        _agree(stage(run(spark, d).withColumn("model", F.lit(name))), "did_churn", threshold, "model")
        for name, run, threshold in (("forest", forest_scores, 0.3), ("network", network_scores, 0.3), ("support vectors", support_vector_scores, 0.0))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def out_of_time_metrics_agree(spark, d):
    return _agree(_out_of_time_scores(spark, d), "did_churn", 0.15, "part")


@once
def _bagged(spark, d):
    train, _ = _train_test(spark, d)
    return bagging.fit_bagged(train, features.FOREST_RECENCY, "did_churn", "subscription_id", trees=BAGGED_TREES, depth=6)


BAGGED_TREES = 10


@query
def forest_bags(spark, d):
    """How often each row is in the bags of ten trees, and of how many it is out."""
    rows = _modelling(spark, d).select("subscription_id")
    bags = [bagging.bag_count(F.col("subscription_id"), t) for t in range(BAGGED_TREES)]
    return rows.select(
        "subscription_id", reduce(lambda x, y: x + y, bags).cast("long").alias("times"),
        reduce(lambda x, y: x + y, [(n == 0).cast("long") for n in bags]).alias("trees_out"),
    )


@query
def out_of_bag_votes(spark, d):
    """Every training row is judged by the trees that have not seen it, and by no others."""
    votes = _bagged(spark, d).out_of_bag_votes()
    return votes.select("subscription_id", F.col("did_churn").cast("int").alias("did_churn"), "trees_out", F.col("votes").between(0, F.col("trees_out")).alias("valid"))


@query
def out_of_bag_importance(spark, d):
    """Mean decrease in accuracy when a feature is exchanged among out-of-bag rows."""
    return _bagged(spark, d).importance()


def _rate_rows(spark, d):
    orders, key = b.table(spark, d, "orders"), F.col("o_orderkey")
    rows = orders.select(key.alias("id"), F.when(key % 17 != 0, F.col("o_custkey")).alias("who"), (F.col("o_orderstatus") == "F").alias("done"), "o_orderpriority")
    return rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")


@query
def target_rates(spark, d):
    """Rates of a column with a level for every customer and of one with few, for fitted and for later rows."""
    train, later = _rate_rows(spark, d)
    stats = target_stats.fit_target_stats(train, ["who", "o_orderpriority"], "done", "id")
    return _tidied(stats.encode(train, training=True).unionByName(stats.encode(later)))


def _with_dependent(spark, d):
    return _modelling(spark, d).withColumns({"twice": 2 * F.col("weeks_with_updates"), "together": F.col("subscription_age") + F.col("estimate")})


DEPENDENT = ["weeks_with_updates", "twice", "subscription_age", "estimate", "together", "total_updates"]


@query
def logit_dependent_balance(spark, d):
    """Terms that depend on earlier ones do not disturb the fit: all totals are reproduced, theirs as well."""
    return _balance(spark, _with_dependent(spark, d), DEPENDENT, [], "dependent")


@query
def logit_dependent_terms(spark, d):
    fitted = logit.fit_logit(_with_dependent(spark, d), DEPENDENT, "did_churn").coefficients()
    return fitted.select("term", F.col("estimate").isNotNull().alias("fitted"), F.col("p_value").between(0, 1).alias("tested"))


FOURIER = {"size": 6, "gamma": 0.5, "seed": 4}


@query
def fourier_features(spark, d):
    """Random Fourier features of two columns; directions and phases follow from hashes of the seed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("u"), F.col("l_discount").alias("v"))
    joined = VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(rows)
    made = kernel.RandomFourier(inputCol="x", outputCol="z", inputs=2, **FOURIER).transform(joined)
    z = vector_to_array("z")
    return made.select("l_orderkey", "l_linenumber", *[tidy(z[j]).alias(f"z{j}") for j in range(FOURIER["size"])])


@query
@once
def radial_support_vector_scores(spark, d):
    train, test = _train_test(spark, d)
    model = classifiers.fit_svc(train, features.LOGIT_REDUCED, "did_churn", 30, kernel="radial", components=64)
    return classifiers.predict_classifier(model, test).select("subscription_id", "did_churn", "pred")


@query
@once
def rectified_network_scores(spark, d):
    train, test = _train_test(spark, d)
    fitted = network.fit_network(train, features.NETWORK, "did_churn", "subscription_id", ZERO_BASED_LOGS, POSITIVE_LOGS, epochs=5, batches=4)
    return fitted.predict(test).select("subscription_id", "did_churn", "pred")


@query
def later_classifier_metrics_agree(spark, d):
    """Radial support vectors and the network with dropout on the test rows."""
    parts = [
        _agree(stage(run(spark, d).withColumn("model", F.lit(name))), "did_churn", threshold, "model")
        for name, run, threshold in (("radial", radial_support_vector_scores, 0.0), ("rectified", rectified_network_scores, 0.3))
    ]
    return reduce(DataFrame.unionByName, parts)
