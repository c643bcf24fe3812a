"""Billing, account, activity and support tables derived from the shared test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.sources.tables import Sources

# Snapshot dates: the billing tables live in 1995-2001, the events in January 2024.
T = "1998-04-01"
T_EARLIER = "1998-01-01"
T_USAGE = "2024-01-31"
#: Snapshots of the panel and the cut-offs of their activity logs.
PANEL = [f"1997-{month:02d}-15" for month in range(1, 13)]
PANEL_USAGE = ["2024-01-04", "2024-01-07", "2024-01-10 12:30:00", "2024-01-14", "2024-01-19", "2024-01-24",
               "2024-01-31", "2024-02-11", "2024-02-29", "2024-03-05", "2024-03-14 06:00:00", "2024-03-24"]


# Declared schemas spare a schema-reading job per scan.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _number_in_props() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def subscriptions(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    paid = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N") & (F.col("l_returnflag") != "R")
    charges = (
        lineitem.where(paid)
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.count_distinct("l_linenumber", "l_partkey", "l_suppkey").alias("n"))
    )
    key, trial = F.col("o_orderkey"), F.col("o_orderkey") % 4 == 0
    described = orders.select(
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_custkey").alias("metadata_user_id"),
        F.col("o_orderpriority").alias("plan_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "business")
        .when(F.col("o_orderpriority") == "5-LOW", "reply")
        .otherwise("awesome").alias("simplified_plan_id"),
        F.when(key % 10 == 0, "year").otherwise("month").alias("billing_interval"),
        (1 + key % 3).alias("quantity"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + _days((key * 37) % 540)).alias("canceled_at"),
        F.when(trial, F.col("o_orderdate")).alias("trial_start_at"),
        F.when(trial, F.col("o_orderdate") + F.expr("INTERVAL 14 DAYS")).alias("trial_end_at"),
    )
    return described.join(charges, "id", "left").select(
        *described.columns, F.coalesce("n", F.lit(0)).alias("successful_charges")
    )


def invoices(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("date"),
        F.sum("l_extendedprice").alias("amount_due"),
        F.bool_or(F.col("l_returnflag") != "N").alias("paid"),
    ).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("subscription_id"), "date", "amount_due", "paid",
    )


def charges(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("created"),
        (F.col("l_linestatus") == "F").alias("captured"),
        (F.col("l_returnflag") != "N").alias("paid"),
        (F.col("l_returnflag") == "R").alias("refunded"),
    )


def users(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("id"),
        F.date_add(F.to_date(F.lit("1994-01-01")), (key % 365).cast("int")).alias("created_at"),
        key.alias("billing_stripe_customer_id"),
        F.col("n_name").alias("locale_browser_language"),
        (key % 50 == 0).alias("is_suspended"),
        (key % 7 != 0).alias("is_approved"),
        (key % 2 == 0).alias("has_notifications_enabled"),
        (key % 3 != 0).alias("has_verified_email"),
        F.col("c_mktsegment").alias("timezone"),
        F.when(key % 5 == 0, "sms").alias("twofactor_type"),
        F.when(key % 9 != 0, key % 2).alias("number_of_bonus_profiles"),
        (key % 3).alias("number_of_bonus_team_members"),
        (key % 4).alias("number_of_default_profiles"),
        (key % 6).alias("number_of_password_resets"),
    )


def team_facts(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.where(key % 4 != 0).select(
        key.alias("user_id"), (key % 3).alias("number_of_team_members")
    )


def client_facts(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.where(key % 6 != 0).select(
        key.alias("user_id"),
        (key % 5 == 0).alias("is_ios_user"),
        F.when(key % 11 != 0, key % 7 == 0).alias("is_android_user"),
    )


def updates(events: DataFrame) -> DataFrame:
    k, event = _number_in_props(), F.col("event_id")
    return events.where("event_type in ('click', 'view')").select(
        event.alias("id"), "user_id", (F.col("user_id") * 10 + event % 3).alias("profile_id"),
        F.col("ts").alias("created_at"),
        F.when(k % 3 == 0, "Extension").otherwise("web").alias("client_type"),
        (k % 10 != 0).alias("was_sent_with_product"),
    )


def update_errors(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    return events.where("event_type = 'error'").select(
        event.alias("id"), (event - 1).alias("update_id")
    )


def actions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        F.when(kind == "purchase", "dashboard settings billing viewed")
        .when(kind == "view", "dashboard analytics posts viewed")
        .when(kind == "signup", "dashboard settings billing updated")
        .otherwise(F.concat(F.lit("dashboard posts "), kind)).alias("full_scope"),
    )


def profiles(events: DataFrame) -> DataFrame:
    owner = F.col("user_id") * 10 + F.col("event_id") % 3
    return events.select(owner.alias("id"), "user_id").distinct()


def conversations(events: DataFrame) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    return events.where("event_type in ('signup', 'error')").select(
        event.alias("id"), F.col("ts").alias("createdat"), (event % 13 == 0).alias("isdraft"),
        F.when(event % 5 == 0, "phone").otherwise("email").alias("type"),
        F.when(event % 17 == 0, '{"email":""}')
        .otherwise(F.concat(F.lit('{"email":"u'), user, F.lit('@example.com"}'))).alias("customer"),
        F.concat(
            F.lit('{"firstName":"F'), user, F.lit('","lastName":"", "type":"'),
            F.when(event % 4 == 0, "user").otherwise("customer"), F.lit('"}'),
        ).alias("createdby"),
        F.when(event % 19 == 0, '{"id":9}')
        .when(event % 3 == 0, '{"id":1,"name":"Tracking emails"}')
        .when(event % 7 == 0, '{"id":2,"name":"The Next Thing"}')
        .otherwise('{"id":3,"name":"Support"}').alias("mailbox"),
    )


# Each source table with the test tables it is derived from.
DERIVED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "stripe_subscriptions": (subscriptions, ("orders", "lineitem")),
    "stripe_invoices": (invoices, ("lineitem",)),
    "stripe_charges": (charges, ("lineitem",)),
    "users": (users, ("customer", "nation")),
    "user_team_member_facts": (team_facts, ("customer",)),
    "user_client_facts": (client_facts, ("customer",)),
    "updates": (updates, ("events",)),
    "update_errors": (update_errors, ("events",)),
    "actions_taken": (actions, ("events",)),
    "profiles": (profiles, ("events",)),
    "helpscout_conversations": (conversations, ("events",)),
}


class TestSources(Mapping[str, DataFrame]):
    """Source tables by name; a table is only described when a query asks for it."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        build, tables = DERIVED[name]
        return build(*(table(self._spark, self._dir, t) for t in tables))

    def __iter__(self) -> Iterator[str]:
        return iter(DERIVED)

    def __len__(self) -> int:
        return len(DERIVED)


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    return TestSources(spark, sf_dir)


def all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat feature file, one row per order, before any derived column."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    joined = (
        orders.join(customer, cust == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    return joined.select(
        cust.alias("id"),
        key.alias("subscription_id"),
        F.date_sub(F.to_date("o_orderdate"), (cust % 200).cast("int")).alias("signup_date"),
        F.to_date("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), ((key * 37) % 540).cast("int"))).alias("canceled_at"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("signup_option"),
        F.when(cust % 8 != 0, F.concat(F.lit("client "), cust % 5)).alias("signup_client_name"),
        F.when(key % 10 == 0, "year").otherwise("month").alias("billing_interval"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "business")
        .when(F.col("o_orderpriority") == "5-LOW", "reply")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "")
        .otherwise("awesome").alias("simplified_plan_name"),
        F.when(cust % 5 == 0, "Yes").otherwise("No").alias("ios_user"),
        F.when(cust % 7 == 0, "Yes").otherwise("No").alias("android_user"),
        F.when(cust % 4 != 0, cust % 3).alias("number_of_team_members"),
        F.when(key % 31 == 0, "abc").otherwise(F.format_number(F.floor(price / 50).cast("long"), 0)).alias("number_of_profiles"),
        F.when(key % 6 != 0, F.floor(price / 1000).cast("long") % 120).alias("days_since_last_update"),
        (F.floor(price).cast("long") % 9).alias("weeks_with_updates"),
        (F.floor(price / 10).cast("long") % 700).alias("total_updates"),
        ((F.floor(price / 7).cast("long") % 81) - 40).cast("double").alias("estimate"),
        (key % 5).alias("number_of_failed_charges"),
        (key % 2).alias("number_of_refunded_charges"),
        (1 + key % 3).alias("quantity"),
        F.col("o_orderpriority").alias("plan_id"),
        F.col("n_name").alias("locale_browser_language"),
        (key % 3).alias("number_of_twitter_profiles"),
        (key % 4).alias("number_of_facebook_personal_profiles"),
        (cust % 5).alias("number_of_facebook_pages"),
        (key % 2).alias("number_of_facebook_groups"),
        (cust % 2).alias("number_of_instagram_personal_profiles"),
        (key % 7).alias("number_of_instagram_business_profiles"),
        (key % 13).alias("number_of_successful_charges"),
        (F.floor(price / 9).cast("long") % 50).cast("double").alias("updates_per_week"),
        (key % 4).alias("billing_actions"),
        (cust % 3).alias("analytics_actions"),
    )
