"""Support e-mails per customer, from help-desk conversations with JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import Instant, in_lookback
from tenure.functions.values import digest, empty_to_null, joined_text, parsed, variant_text

# Mailboxes that do not hold customer requests.
OTHER_MAILBOXES = ["Tracking emails", "Join Us"]
OTHER_MAILBOX_PREFIX = "The Next"


def support_emails(conversations: DataFrame) -> DataFrame:
    """Customer e-mails with the sender's address replaced by its hash.

    Each JSON document is parsed once. One that is not JSON has no fields: without a sender
    the row is no customer's, without a mailbox name it counts as any other mailbox, without an
    address it has no hash.
    """
    documents = ("mailbox", "createdby", "customer")
    read = conversations.where("type = 'email' and isdraft = false").withColumns({c: parsed(F.col(c)) for c in documents})
    mailbox = variant_text(F.col("mailbox"), "name")
    sender = empty_to_null(variant_text(F.col("createdby"), "type"))
    fields = read.select(
        "id", "createdat", "type", mailbox.alias("mailbox_name"), sender.alias("sender"),
        empty_to_null(variant_text(F.col("createdby"), "firstName")).alias("first"),
        empty_to_null(variant_text(F.col("createdby"), "lastName")).alias("last"),
        empty_to_null(variant_text(F.col("customer"), "email")).alias("email"),
    )
    box = F.col("mailbox_name")
    wanted = fields.where(F.col("sender") == "customer").where(~box.isin(OTHER_MAILBOXES) & ~box.startswith(OTHER_MAILBOX_PREFIX))
    return wanted.select(
        "id",
        F.col("createdat").alias("created_at"),
        "type",
        "mailbox_name",
        digest(F.col("email")).alias("created_by_email_hash"),
        empty_to_null(F.trim(joined_text(F.col("first"), F.lit(" "), F.col("last")))).alias("created_by"),
        F.when(F.col("sender") == "user", "hero").otherwise("customer").alias("created_by_type"),
    )


def support_email_features(conversations: DataFrame, t: Instant, weeks: int = 8) -> DataFrame:
    """Distinct e-mails per hashed address; unknown addresses form one NULL group."""
    recent = conversations.where(in_lookback(F.col("createdat"), t, weeks))
    return (
        support_emails(recent)
        .groupBy("created_by_email_hash")
        .agg(F.count_distinct("id").cast("long").alias("hs_emails"))
    )
