"""Mailbox import and routing of inbound mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.grouping import first_k, fresh_keys

PART = "struct<mimeType:string,body:struct<data:string>>"
MAIL = (f"id bigint, org_id string, labels array<string>, internalDate bigint, "
        f"payload struct<mimeType:string,headers:array<struct<name:string,value:string>>,"
        f"body:struct<data:string>,parts:array<{PART}>>")

# fixed values
HIDDEN = ["SPAM", "TRASH"]


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAIL).json(path)


def header(name: str) -> Column:
    """Value of a header; a repeated header keeps its last value."""
    hits = F.filter("payload.headers", lambda h: h["name"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def body_text() -> Column:
    """Text of a plain message, else of its first plain part that has any."""
    plain_parts = F.filter(
        "payload.parts",
        lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""),
    )
    data = F.when(F.col("payload.mimeType") == "text/plain", F.col("payload.body.data")).otherwise(
        F.try_element_at(plain_parts, F.lit(1))["body"]["data"]
    )
    return F.coalesce(X.strip(X.decode_base64url(data)), F.lit(""))


def import_mailbox(raw: DataFrame, now: Column, since_hours: float = 24, cap: int | None = None) -> DataFrame:
    """The mails of the look-back, without empty ones; with ``cap``, the newest so many per organisation."""
    after = F.floor(F.unix_micros(now.cast("timestamp")) / 1000000 - since_hours * 3600) * 1000
    recent = raw.filter(
        (F.col("internalDate") >= after)
        & ~F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, HIDDEN)))
    )
    listed = recent if cap is None else first_k(recent, ["org_id"], [F.desc("internalDate"), F.asc("id")], cap)
    return (
        listed.select(
            "id", "org_id", F.coalesce(header("Subject"), F.lit("(no subject)")).alias("subject"),
            F.coalesce(header("From"), F.lit("")).alias("sender"), body_text().alias("body"),
            F.timestamp_millis(F.coalesce("internalDate", F.lit(0))).alias("timestamp"),
        )
        .filter(F.col("body") != "")
    )


def mail_text(sender: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Email from: "), sender, F.lit("\nSubject: "), subject, F.lit("\n\n"), body)


def mail_sources(mails: DataFrame) -> DataFrame:
    return mails.select(
        "id", "org_id", F.lit("email").alias("source_type"),
        mail_text(F.col("sender"), F.col("subject"), F.col("body")).alias("raw_content"),
        F.create_map(F.lit("sender"), "sender", F.lit("subject"), "subject").alias("source_metadata"),
        "timestamp",
    )


def route_inbound(mails: DataFrame, profiles: DataFrame) -> DataFrame:
    """Organisation and outcome of each inbound mail.

    An organisation is addressed by its id or by the first segment of it; the
    lowest profile id wins where several match.
    """
    ids = profiles.select("id", F.lower("org_uuid").alias("org_uuid"))
    addresses = (
        ids.select("id", F.col("org_uuid").alias("org"), F.explode(
            F.array("org_uuid", F.split_part("org_uuid", F.lit("-"), F.lit(1)))).alias("address"))
        .groupBy("address").agg(F.min_by("org", "id").alias("matched_org"))
    )
    stripped, plain = X.strip(F.coalesce("stripped_text", F.lit(""))), X.strip(F.coalesce("body_plain", F.lit("")))
    prepared = mails.withColumns({
        "address": F.lower(X.strip(F.split_part("recipient", F.lit("@"), F.lit(1)))),
        "body": F.when(stripped != "", stripped).otherwise(plain),
    })
    return (
        prepared.join(fresh_keys(addresses, "address"), "address", "left")
        .withColumn("outcome", F.when(F.col("matched_org").isNull(), "ignored: unknown recipient")
                    .when(F.col("body") == "", "ignored: empty body").otherwise("processed"))
        .select(
            "id", "recipient", "sender", "subject", "matched_org", "outcome",
            F.when(F.col("outcome") == "processed", mail_text(
                F.col("sender"), F.coalesce("subject", F.lit("")), F.col("body"))).alias("raw_content"),
        )
    )
