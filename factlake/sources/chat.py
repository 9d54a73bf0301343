"""Chat exports: messages, channels, memberships, and the raw index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import epoch_to_ts

MESSAGE = ("org_id string, channel_id string, type string, text string, user string, subtype string, "
           "ts string, thread_ts string")
CHANNEL = "org_id string, id string, name string, is_private boolean, members array<string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one message each; org and channel may be folder names (``org_id=…/channel_id=…``)."""
    return spark.read.schema(MESSAGE).json(path)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANNEL).json(path)


def list_channels(channels: DataFrame) -> DataFrame:
    return channels.select("org_id", "id", "name", F.coalesce("is_private", F.lit(False)).alias("is_private"))


def import_messages(
    raw: DataFrame, channels: DataFrame, profiles: DataFrame, now: Column, hours_back: float | None = 180 * 24
) -> DataFrame:
    """Messages with text inside the look-back (None: all), with time, link and channel flag.

    A message whose ``ts`` is no number has no time and is left out.

    Channels and workspace domains are joined as dimensions, so all channels of
    all organisations are read in one pass.
    """
    recent = F.col("timestamp").isNotNull()
    if hours_back is not None:
        recent = F.col("timestamp") >= now.cast("timestamp") - F.make_dt_interval(secs=F.lit(hours_back * 3600))
    flags = list_channels(channels).select("org_id", F.col("id").alias("channel_id"), F.col("is_private").alias("channel_is_private"))
    domains = profiles.select("org_id", "slack_workspace_domain")
    return (
        raw.filter((F.col("type") == "message") & (F.coalesce("text", F.lit("")) != ""))
        .withColumn("timestamp", epoch_to_ts(F.col("ts")))
        .filter(recent)
        .join(flags, ["org_id", "channel_id"], "left")
        .join(domains, "org_id", "left")
        .select(
            F.unix_micros("timestamp").alias("msg_id"), "org_id", "channel_id",
            F.coalesce("channel_is_private", F.lit(False)).alias("channel_is_private"),
            F.coalesce("user", F.lit("")).alias("user_id"), "subtype", "ts", "thread_ts",
            F.col("text").alias("content"), "timestamp",
            X.permalink(F.col("slack_workspace_domain"), F.col("channel_id"), F.col("ts")).alias("permalink"),
        )
    )


def message_metadata() -> Column:
    return F.map_filter(
        F.create_map(
            F.lit("channel_id"), F.col("channel_id"), F.lit("user"), F.col("user_id"), F.lit("ts"), F.col("ts"),
            F.lit("thread_ts"), F.col("thread_ts"), F.lit("subtype"), F.col("subtype"),
        ),
        lambda _, v: v.isNotNull(),
    )


def index_messages(messages: DataFrame, source_type: str, now: Column) -> DataFrame:
    """Source rows of messages: time defaults to ``now``, metadata to an empty map."""
    have = messages.columns
    ts = F.col("timestamp") if "timestamp" in have else F.lit(None).cast("timestamp")
    meta = F.col("metadata") if "metadata" in have else message_metadata()
    return messages.select(
        F.col("msg_id").alias("id"), "org_id", F.lit(source_type).alias("source_type"),
        F.col("content").alias("raw_content"),
        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("source_metadata"),
        F.coalesce(ts, now).alias("timestamp"),
        (F.col("permalink") if "permalink" in have else F.lit(None).cast("string")).alias("permalink"),
        "channel_id", F.coalesce("channel_is_private", F.lit(False)).alias("channel_is_private"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        *([F.col("part")] if "part" in have else []),
    )


def member_rows(channels: DataFrame) -> DataFrame:
    """Members listed with their channels, one per row."""
    return channels.select("org_id", F.col("id").alias("channel_id"), F.explode("members").alias("user_id"))


def import_memberships(channels: DataFrame, members: DataFrame, existing: DataFrame) -> DataFrame:
    """New members of private channels; ``members`` has one row per channel and user."""
    private = list_channels(channels).filter("is_private").select("org_id", F.col("id").alias("channel_id"))
    return insert_or_ignore(members.join(private, ["org_id", "channel_id"], "left_semi"), existing)


def insert_or_ignore(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct memberships that are not stored yet."""
    keys = ["org_id", "channel_id", "user_id"]
    return rows.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
