"""Channel access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_open() -> Column:
    """Visible to everyone in the organisation, whatever their channels."""
    return F.coalesce(~F.col("channel_is_private"), F.lit(False)) | F.col("channel_id").isNull()


def with_source(facts: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Facts with columns of their source; facts without one are kept."""
    side = sources.select(F.col("id").alias("src_id"), *columns)
    return facts.join(side, facts["source_id"] == side["src_id"], "left").drop("src_id")


def visible_to(rows: DataFrame, memberships: DataFrame, org_id: str, user_id: str) -> DataFrame:
    """Rows of one organisation that one user may see; rows carry channel columns."""
    mine = (
        memberships.filter((F.col("org_id") == org_id) & (F.col("user_id") == user_id))
        .select(F.col("channel_id").alias("my_channel")).distinct()
    )
    return (
        rows.filter(F.col("org_id") == org_id)
        .join(mine, F.col("channel_id") == F.col("my_channel"), "left")
        .filter(is_open() | F.col("my_channel").isNotNull())
        .drop("my_channel")
    )


def visible_pairs(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """Members-only rows with each user who may see them.

    Open rows are visible to every user and are not listed; combine with
    ``filter(is_open())``.
    """
    members = memberships.select(
        F.col("org_id").alias("m_org"), F.col("channel_id").alias("m_channel"), "user_id"
    ).distinct()
    closed = rows.filter(~is_open())
    return closed.join(
        members, (closed["org_id"] == members["m_org"]) & (closed["channel_id"] == members["m_channel"])
    ).drop("m_org", "m_channel")


def access_class() -> Column:
    """Group of rows with one audience: ``open``, or the members of a channel, whatever its id."""
    return F.when(is_open(), F.lit("open")).otherwise(F.concat(F.lit("in:"), "channel_id"))


def with_access_classes(questions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Each question once per audience its user belongs to."""
    mine = memberships.select(
        F.col("org_id").alias("m_org"), F.col("user_id").alias("m_user"),
        F.concat(F.lit("in:"), "channel_id").alias("access_class"),
    ).distinct()
    closed = questions.join(
        mine, (questions["org_id"] == mine["m_org"]) & (questions["user_id"] == mine["m_user"])
    ).drop("m_org", "m_user")
    return questions.withColumn("access_class", F.lit("open")).unionByName(closed)
